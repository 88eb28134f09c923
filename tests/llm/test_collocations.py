"""Collocations against plain counting; the given tables are compared with SQL in ``test_queries``."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quizloom.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string"


def _brute(rows, least, top):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        text = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    often = {p: a for p, a in f.items() if a >= least}
    out = []
    for (lang, p), a in often.items():
        if len(p) < 2:
            continue
        around = [b for (v, q), b in often.items() if v == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= 80 * a for b in around):
            continue
        score, k = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), a, f[lang, p[:k]], f[lang, p[k:]], n[lang]))
    rank, found = Counter(), []
    for lang, score, _, phrase, a, left, right, words in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            found.append((lang, rank[lang], phrase.decode(), a, left, right, words, -score))
    return sorted(found)


def _rows():
    rng = random.Random(4)
    words = ["the", "The", "wind", "of", "change", "ß", "日", "a", "É", "x\x1cy", "\xa0"]
    rows = []
    for i in range(400):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))
        if i % 3 == 0:
            text += rng.choice([". ", "\n", "\t", " , "]) + "new york city hall"
        rows.append((i, text, rng.choice(["en", "en", "de", None, "und", ""])))
    rows += [(500, None, "en"), (501, "", "fr"), (502, "\n\t .,", "fr"), (None, "new york city hall", "en")]
    rows += [(600, "same words again. " * 50, "es")] * 3
    return rows + [(700, "run " * 3000 + "stop", "de")]


@pytest.mark.parametrize("least,top", [(5, 2000), (30, 7)])
def test_equals_plain_counting(spark, monkeypatch, least, top):
    monkeypatch.setattr(C, "_FLUSH", 500)
    rows = _rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumns({"words": F.lit(1), "phrase": F.lit("p"), "n": F.lit(2)})
    got = sorted(tuple(r) for r in C.collocations(docs, top, least).collect())
    assert got == _brute(rows, least, top)


def test_a_poor_sample_costs_passes_only(spark, monkeypatch):
    """A sample without any document proposes nothing; all is found on the border."""
    rows = [(i, t, v) for i, (_, t, v) in enumerate(_rows())]
    docs = spark.createDataFrame(rows, SCHEMA)
    passes = []
    counted = C._counted
    monkeypatch.setattr(C, "_counted", lambda *a: passes.append(a[1] is not None) or counted(*a))
    monkeypatch.setattr(C, "SAMPLE_PART", 10**9)
    assert sorted(tuple(r) for r in C.collocations(docs, 2000, 10).collect()) == _brute(rows, 10, 2000)
    assert sum(passes) <= C.LONGEST


def test_full_filter_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(C, "LEAST_BITS", 1 << 8)
    monkeypatch.setattr(C, "MOST_BITS", 1 << 8)
    rows = _rows()
    got = sorted(tuple(r) for r in C.collocations(spark.createDataFrame(rows, SCHEMA), 2000, 10).collect())
    assert got == _brute(rows, 10, 2000)


def test_empty_table(spark):
    assert C.collocations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_score_beyond_64_bits(spark):
    big = 9 * 10**12
    found = spark.createDataFrame([("en", 1, "a", big + 5), ("en", 1, "b", big + 7), ("en", 2, "a b", big)], "lang string, words int, phrase string, n long")
    row = C.scored(found).collect()[0]
    assert row.score == 2000000 * big // (2 * big + 12) and (row.l, row.r) == (big + 5, big + 7)


def test_two_passes_find_what_a_poor_sample_missed(spark, monkeypatch):
    rows = [(i, t, v) for i, (_, t, v) in enumerate(_rows())]
    passes, counted = [], C._counted
    monkeypatch.setattr(C, "_counted", lambda *a: passes.append(a[1] is not None) or counted(*a))
    monkeypatch.setattr(C, "SAMPLE_PART", 10**9)
    assert sorted(tuple(r) for r in C.collocations(spark.createDataFrame(rows, SCHEMA), 2000, 10).collect()) == _brute(rows, 10, 2000)
    assert sum(passes) == 2
