"""Cell index: the rows of the plain search, from few cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quizloom.operators import cells as C
from quizloom.operators import vector as V

ROWS = "id bigint, vec array<double>, topic string, lang string"


def _clustered(seed, n, centers=40, d=16):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centers, d)) * 4
    of = rng.integers(0, centers, n)
    vec = middle[of] + rng.normal(size=(n, d)) * 0.3
    vec[: n // 3] = vec[0]  # a third of all rows are one vector
    of[: n // 3] = of[0]
    return [(i, v.tolist(), f"t{t}", "en" if i % 3 else "de") for i, (v, t) in enumerate(zip(vec, of))]


@pytest.fixture(scope="module")
def small_cells():
    before = C.CELL_ROWS, C.PART_ROWS
    C.CELL_ROWS, C.PART_ROWS = 50, 400
    yield
    C.CELL_ROWS, C.PART_ROWS = before


@pytest.fixture(scope="module")
def table(spark, small_cells):
    rows = _clustered(1, 3000)
    corpus = spark.createDataFrame(rows + [(9999, None, "t1", "en")], ROWS).withColumn("far_off", F.lit(1))
    return rows, corpus, C.build(corpus, ["topic", "lang"])


def _answer(df):
    return sorted((r.query_id, r["rank"], r.id, round(r.score, 6)) for r in df.collect())


def test_rows_of_the_plain_search(spark, table):
    rows, corpus, index = table
    rng = np.random.default_rng(4)
    asked = [(i, (np.array(rows[i * 37][1]) + rng.normal(size=16) * 0.1).tolist(), rows[i * 37][2], "de") for i in range(60)] + [(77, [0.0] * 16, "nowhere", "de")]
    queries = spark.createDataFrame(asked, "query_id bigint, vec array<double>, topic string, lang string")
    plain = corpus.where("vec IS NOT NULL")
    seen = {}
    assert _answer(C.search(index, queries, 7, seen=seen)) == _answer(V.top_k(plain, queries, 7))
    assert seen["pairs_read"] < 0.7 * seen["pairs"]
    assert _answer(C.search(index, queries, 5, ["topic"], seen)) == _answer(V.top_k(plain, queries, 5, ["topic"]))
    assert seen["pairs_read"] < 0.1 * seen["pairs"]
    few = V.metadata_filter(plain, lang="de", topic=["t1", "t2"])
    assert _answer(C.search(index, queries, 5, lang="de", topic=["t1", "t2"], seen=seen)) == _answer(V.top_k(few, queries, 5))
    assert seen["cells_read"] < 0.3 * seen["cells"]
    assert C.search(index, queries, 5, topic="unknown topic").count() == 0


def test_only_wanted_cells_are_in_the_scan(spark, table):
    _, _, index = table
    queries = spark.createDataFrame([(1, index.cells["centroid"][0].tolist())], "query_id bigint, vec array<double>")
    plan = C.search(index, queries, 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan


def test_hot_cell_is_stored_in_parts(spark, table):
    """Adaptive execution would join parts as small as these."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    index = C.build(table[1], [])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    hot = int(index.cells.loc[index.cells["n"].idxmax(), "cell"])
    assert index.rows.where(F.col("cell") == hot).select(F.input_file_name()).distinct().count() > 1


def test_more_queries_than_are_sent(spark, table, monkeypatch):
    _, corpus, index = table
    queries = corpus.where("id < 40 AND vec IS NOT NULL").select(F.col("id").alias("query_id"), "vec")
    want = _answer(C.search(index, queries, 3))
    monkeypatch.setattr(C, "MOST_PAIRS", 1)
    assert _answer(C.search(index, queries, 3)) == want


def test_a_query_travels_once(spark, table, monkeypatch):
    """However many cells a query reads, its vector is sent to the tasks once, not once for each cell."""
    _, corpus, index = table
    queries = corpus.where("id >= 2000 AND id < 2040 AND vec IS NOT NULL").select(F.col("id").alias("query_id"), "vec")
    sent, send = [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda value: sent.append(value) or send(value))
    seen = {}
    assert C.search(index, queries, 200, seen=seen).count() == 40 * 200
    assert seen["pairs_read"] > 40
    rows = [len(value[0]) if isinstance(value, tuple) else len(value) for value in sent]
    assert rows and max(rows) <= 40


def test_empty(spark):
    none = C.build(spark.createDataFrame([], ROWS), ["topic"])
    queries = spark.createDataFrame([(1, [1.0])], "query_id bigint, vec array<double>")
    assert C.search(none, queries, 3).count() == 0
    assert C.search(none, queries.limit(0), 3).count() == 0
