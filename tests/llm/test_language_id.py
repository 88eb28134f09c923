"""Language ID: held-out accuracy, back-off, and odd rows."""

from pyspark.sql import functions as F

from quizloom.llm import language_id as L


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = L.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    right, n = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 150 and right > 0.97


def test_known_word_then_longest_gram():
    m = L.Model(["a", "b"], {"der": (-1.0, -5.0)}, {"^ze": (-9.0, -2.0), "z": (-1.0, -8.0)})
    s = L.Scorer(m)
    assert s.word("der") == (-1.0, -5.0)
    assert s.word("zebra") == [-9.0, -2.0]
    assert s.word("yz") == [-1.0, -8.0]
    assert s.word("q") == [0.0, 0.0]


def test_odd_rows(spark):
    rows = [(1, "the cat the cat", "en", 5.0), (2, "le chat le chat", "fr", None), (3, None, "en", 1.0), (4, "12 !? ½²", None, 1.0),
            (5, "the chat " * 60_000, None, 1.0), (5, "the", None, 1.0), (None, "le", "fr", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    out = L.predict(df, L.train(df)).collect()
    assert [(r.lang_pred) for r in out][:4] == ["en", "fr", "und", "und"]
    assert out[2].score == 0.0 and all(0 <= r.score <= 1 for r in out)
    assert out[5].lang_pred == "en" and out[6].lang_pred == "fr"
    assert L.predict(df.limit(0), L.train(df)).count() == 0
    assert {r.lang_pred for r in L.predict(df, L.train(df.limit(0))).collect()} == {"und"}


def test_equals_plain_counting_and_scoring(spark):
    """Counts, log frequencies, back-off and scores, recounted without Spark."""
    import math
    import zlib
    from collections import Counter

    import regex

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()
    held = {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    letters = regex.compile(r"\p{L}+").findall
    seen = [r for r in rows if r.doc_id not in held and r.lang is not None and r.text is not None]
    langs = sorted({r.lang for r in seen})
    words = Counter((r.lang, w) for r in seen for w in letters(r.text.lower()))
    grams = Counter()
    for (lang, w), n in words.items():
        for size in range(1, 6):
            padded = f"^{w}$" if size > 1 else w
            for i in range(len(padded) - size + 1):
                grams[lang, padded[i : i + size]] += n

    def logs(counts, keep, size_of):
        total = Counter()
        for (lang, item), n in counts.items():
            total[lang, size_of(item)] += n
        items = {item for _, item in counts if sum(counts[v, item] for v in langs) > 1}
        assert len(items) <= keep
        return {i: [math.log((counts[v, i] + 0.1) / (total[v, size_of(i)] + 0.1 * keep)) for v in langs] for i in items}

    known, parts = logs(words, L.WORDS, lambda w: 0), logs(grams, L.GRAMS, len)

    def score(w):
        if w in known:
            return known[w]
        for size in range(5, 0, -1):
            padded = f"^{w}$" if size > 1 else w
            found = [parts[g] for g in (padded[i : i + size] for i in range(len(padded) - size + 1)) if g in parts]
            if found:
                return [sum(c) / len(found) for c in zip(*found)]
        return [0.0] * len(langs)

    got = {r.doc_id: r for r in L.identify(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()}
    for r in rows:
        found = letters((r.text or "").lower())
        sums = [sum(c) / max(1.0, len(found) / 20) for c in zip(*map(score, found))] or None
        have = got[r.doc_id]
        assert have.held_out == (r.doc_id in held)
        if sums is None:
            assert (have.lang_pred, have.score) == ("und", 0.0)
            continue
        p = [math.exp(s - max(sums)) for s in sums]
        assert abs(have.score - max(p) / sum(p)) < 1e-6 and have.lang_pred == langs[p.index(max(p))]
