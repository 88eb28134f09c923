"""Co-training: held-out accuracy, exchange of labels, odd rows."""

import numpy as np
from pyspark.sql import functions as F

from quizloom.llm import quality as Q


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    seen = labels.where("doc_id % 3 <> 0")
    out = Q.classify(docs, seen).withColumnRenamed("quality", "got").join(labels.where("doc_id % 3 = 0"), "doc_id")
    bad, good = out.agg(
        F.avg(F.when(F.col("quality") == 0, (F.col("got") == 0).cast("double"))),
        F.avg(F.when(F.col("quality") == 1, F.col("got").cast("double"))),
    ).first()
    assert bad > 0.9 and good > 0.98


def test_views_teach_each_other():
    r = np.random.default_rng(1)
    y = r.integers(0, 2, 2000).astype(float)
    xt = np.stack((np.ones(2000), y + r.normal(0, 0.2, 2000)), 1)
    xm = np.stack((np.ones(2000), -y + r.normal(0, 0.3, 2000)), 1)
    known = np.where(np.arange(2000) < 24, y, -1)
    m = Q.fit(xt, xm, known)
    assert ((m.score(xt, xm)[2] > 0.5) == y).mean() > 0.98


def test_odd_rows(spark):
    schema = "doc_id long, text string, source string, lang string, n_chars long, score string"
    rows = [(1, None, None, None, None, "s"), (2, "", "a", "en", 0, "s"), (None, "good text here.", "a", "en", 3, "s"),
            (3, "one two three. " * 70_000, "b", None, -4, "s"), (3, "### $$$ %%%", None, "en", 5, None)]
    df = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(3, 1), (3, 0), (None, 1), (9, None)], "doc_id long, quality int")
    out = Q.classify(df, labels).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    assert [r.score for r in out if r.doc_id in (1, 2)] == [0.0, 0.0]
    assert Q.classify(df.limit(0), labels).count() == 0
    assert Q.classify(df, labels.limit(0)).where("quality = 1").count() == 3
    again = Q.score(df, Q.train(df, labels))
    assert again.columns == ["doc_id", "text", "source", "lang", "n_chars", "p_text", "p_meta", "score"]


def test_few_labels_in_a_large_table(spark, monkeypatch):
    """Labels are drawn from the labels, so the same ones teach the same in a table six times as large."""
    monkeypatch.setattr(Q, "POOL_ROWS", 300)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    many = docs
    for k in range(1, 6):
        many = many.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 100_000 * k))
    seen = labels.where("doc_id % 3 <> 0")
    out = Q.classify(many, seen).withColumn("base", F.col("doc_id") % 100_000).withColumnRenamed("quality", "got")
    out = out.join(labels.where("doc_id % 3 = 0").withColumnRenamed("doc_id", "base"), "base")
    bad, good = out.agg(
        F.avg(F.when(F.col("quality") == 0, (F.col("got") == 0).cast("double"))),
        F.avg(F.when(F.col("quality") == 1, F.col("got").cast("double"))),
    ).first()
    assert bad > 0.9 and good > 0.98
