"""Canonical digests."""

from quizloom.llm import licences as L


def test_whole_texts_and_notices(spark):
    mit = next(t for n, k, t in L.KNOWN if n == "MIT" and k == "text")
    odd = "Copyright (c) 2020 Ann Bee\n\n" + mit.upper().replace("LICENSE", "LICENCE").replace('"AS IS"', "“AS IS”").replace(",", " , ") + "\nAll rights reserved.\n"
    rows = [(1, mit), (2, odd), (3, mit + " and more"), (4, "intro\n released UNDER the MIT licence\nLicensed under the Apache License, Version 2.0.\nReleased under the MIT License.\n"),
            (5, None), (5, " \n"), (None, "x " * 100_000), (6, "ReleasedunderTheMITLicense")]
    df = spark.createDataFrame([(*r, "d") for r in rows], "doc_id long, text string, digest string")
    got = [(r.doc_id, r.licence, r.notices) for r in L.scan(df).collect()]
    assert sorted(got, key=str) == sorted(
        [(1, "MIT", ""), (2, "MIT", ""), (3, None, ""), (4, None, "Apache-2.0 MIT"), (5, None, ""), (5, None, ""), (None, None, ""), (6, None, "")], key=str
    )
    assert L.scan(df.limit(0)).count() == 0
    assert "Python" not in L.scan(df)._jdf.queryExecution().toString()


def test_own_list(spark):
    known = L.known_licences(spark, [("B", "text", "Do what you like."), ("A", "text", "do WHAT you like"), ("N", "notice", "free to use"), ("E", "text", "")])
    df = spark.createDataFrame([(1, "Do what, you like"), (2, "a\nFree to use!"), (3, "")], "doc_id long, text string")
    assert {(r.doc_id, r.licence, r.notices) for r in L.scan(df, known).collect()} == {(1, "A", ""), (2, None, "N"), (3, None, "")}


def test_shipped_table(spark):
    from quizloom.llm import licence_table as T

    folder = T.Path(T.__file__).with_name("licence_texts")
    texts = {p.stem: p.read_text() for p in folder.glob("*.txt")}
    bsd = next(t for n, _, t in T.rows() if n == "BSD-2-Clause")
    grant = next(t for n, k, t in L.KNOWN if n == "MIT" and k == "text").split("\n\n", 1)[1].replace("\n", " ")
    rows = [(name, text) for name, text in sorted(texts.items())] + [("BSD-2-Clause", "Copyright (c) 2020, J. Doe\n" + bsd)]
    rows += [(n, t) for n, _, t in T._SHORT]
    # whole licences on one line
    rows += [("MIT", f"MIT License Copyright (c) 2020 J. Doe <j.doe@x.org> {grant}"), ("MIT", f"Copyright 2020 Foo, Inc. All rights reserved. {grant}")]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.licence for r in L.scan(df).collect()}
    assert [got[i] for i in range(len(rows))] == [n for n, _ in rows]


def test_standard_notices(spark):
    lines = [
        ("This project is licensed under the terms of the MIT license.", "MIT"), ("Released under GPL v3", "GPL-3.0"), ("SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause"),
        ("Distributed under the Mozilla Public License, v. 2.0", "MPL-2.0"), ("License: LGPL-2.1-or-later", "LGPL-2.1-or-later"), ("This work is licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"),
        ("This work is licensed under a Creative story", ""), ("He was released under the bridge", ""), ("Licensed under the MIT License. Copyright (c) 2020 Ann", "MIT"),
    ]
    df = spark.createDataFrame([(i, "intro\n" + t) for i, (t, _) in enumerate(lines)], "doc_id long, text string")
    assert [r.notices for r in L.scan(df).orderBy("doc_id").collect()] == [n for _, n in lines]
