"""The pipeline's stages, each judged on its own input."""

import corpus_pipeline as C
from test_ngram_join import _brute
from test_tokens import _check_packing

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert [n for n, _ in C.STAGES] == ["language ID", "quality classifier", "n-gram Jaccard join", "packing"]
    identified, good, unique, packed = (f for _, f in C.STAGES)
    extra = [(5000, None, "en", "s", 0), (5001, "12 ?!", "en", "s", 5)]
    one = C.saved(identified(spark, docs.unionByName(spark.createDataFrame(extra, docs.schema)), SF), "t")
    assert one.columns == docs.columns
    ids = {r.doc_id for r in one.collect()}
    assert not ids & {5000, 5001} and len(ids) >= 0.99 * docs.count()
    two = C.saved(good(spark, one, SF), "t")
    ids = {r.doc_id for r in two.collect()}
    clean = [i for i, r in labels.items() if r.quality == 1]
    junk = [i for i, r in labels.items() if r.quality == 0]
    assert sum(i in ids for i in clean) >= 0.99 * len(clean) and sum(i in ids for i in junk) <= 0.1 * len(junk)
    three = C.saved(unique(spark, two, SF), "t")
    rows = [(r.doc_id, r.text) for r in two.collect()]
    assert {r.doc_id for r in three.collect()} == {i for i, _, c in _brute(rows, 5, 80) if i == c}
    out = packed(spark, three, SF).collect()
    padded = _check_packing(out, [(r.doc_id, r.text) for r in three.collect()])
    assert padded < 0.02 * sum(r.length for r in out)


def test_run_is_its_stages(spark):
    out = C.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 100
