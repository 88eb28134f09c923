"""Shapes of plans: no cross products, pushed filters, group limits."""

import pytest
from pyspark.sql import functions as F

from quizloom.operators import balance as B
from quizloom.operators import bank as K
from quizloom.operators import vector as V
from quizloom.plans import registered

QUERIES = registered.queries()
JOINING = [
    "set_metrics", "jaccard_pairs", "cosine_pairs", "fuzzy_duplicates_in_set", "answer_leaks", "exact_duplicates", "append_new_questions",
    "answer_position_enforcement", "quota_acceptance", "slug_retrieval", "quality_pass", "stage_chain", "vector_upsert", "chapter_coverage",
]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", JOINING)
def test_no_cross_products(name, spark, sf_dir):
    plan = _plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "bank")
    spark.range(100).select(
        "id", (F.col("id") % 5).cast("int").alias("exam_set"), F.lit("easy").alias("difficulty"), F.lit("q").alias("question"), F.lit("x").alias("wide"),
    ).write.partitionBy("exam_set").parquet(path)
    plan = _plan(K.filter_bank(spark.read.parquet(path), exam_set=3, difficulty="easy").select("id"))
    assert "PushedFilters: [IsNotNull(difficulty), EqualTo(difficulty,easy)]" in plan
    assert "PartitionFilters: [isnotnull(exam_set" in plan and "wide" not in plan


def test_metadata_filter_reaches_the_scan(spark, sf_dir):
    emb = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    assert "EqualTo(label,3)" in _plan(V.metadata_filter(emb, label=3).select("vec_id"))
    assert "In(label, [1,2])" in _plan(V.metadata_filter(emb, label=[1, 2]).select("vec_id"))


def test_quota_keeps_few_rows_before_the_shuffle(spark):
    rows = spark.range(100).select("id", (F.col("id") % 3).cast("int").alias("g"))
    quotas = spark.createDataFrame([(1, 5)], "g int, quota bigint")
    assert "WindowGroupLimit" in _plan(B.accept_quota(rows, quotas, ["g"], "id"))


def test_page_and_newest_are_top_n(spark):
    rows = spark.range(100).select("id", F.lit(1).alias("exam_set"), F.col("id").alias("created_epoch"))
    assert "TakeOrderedAndProject" in _plan(K.page_after(rows, 1, 5))
    assert "TakeOrderedAndProject" in _plan(K.newest_log(rows, 10))
