"""A question bank derived from the driver tables, in Spark and in SQL.

Every column is arithmetic on ``doc_id`` or a look-up, so the view grows with
the tables and both engines give the same rows. The question is the whole text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import reference_values as R


_TEXT_KEYS = {"documents": "doc_id", "conversations": "conv_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table. A text table in fewer pieces than there are cores is spread by its
    key once, because what follows is CPU work on text; a large one stays as it is read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    key = _TEXT_KEYS.get(name)
    cores = spark.sparkContext.defaultParallelism
    if key and df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores, key)
    return df


DISPLAY = [
    "Introduction to Computer",
    "Operating System",
    "Word Processing",
    "Spreadsheet",
    "Presentation",
    "Introduction to Internet and WWW",
    "Email, Social Networking and e-Governance Services",
    "Digital Financial Tools and Applications",
    "Overview of Futureskills and Cyber Security",
]

# Looked up by place, so that a column never repeats the expression it is made of.
_SPANS = [9, 7, 17, 14, 6, 11, 11, 11, 19]
_DIGITS = "".join(str(i + 1) * n for i, n in enumerate(_SPANS))
_CHAPTER_NO = f"CAST(substring('{_DIGITS}', s + 1, 1) AS INT)"


def _nth(values: list[str]) -> str:
    return "element_at(array(" + ", ".join(f"'{v}'" for v in values) + "), chapter_no)"


_DISPLAY = _nth(DISPLAY)
_KEY = _nth([b[0] for b in R.BLUEPRINT])
_CHAPTER = (
    "CASE WHEN doc_id % 41 = 0 THEN 'Unlisted Topic' WHEN doc_id % 5 = 1 THEN upper(display) "
    "WHEN doc_id % 5 = 2 THEN concat('Unit: ', display, ' (revised)') ELSE display END"
)

# (name, expression) shared by both engines; later ones may use earlier ones.
_STEPS = [
    {
        "exam_set": "CAST(floor(doc_id / 100) AS INT) + 1",
        "position": "CAST(doc_id % 100 AS INT) + 1",
    },
    {"s": "position - 1 + CASE WHEN exam_set % 3 = 0 THEN 5 ELSE 0 END"},
    {"chapter_no": _CHAPTER_NO},
    {"display": _DISPLAY, "chapter_key": _KEY},
    {
        "chapter": _CHAPTER,
        "difficulty": "CASE WHEN (doc_id * 7) % 20 < 8 THEN 'easy' WHEN (doc_id * 7) % 20 < 16 THEN 'medium' ELSE 'hard' END",
        "bloom_level": "CASE CAST(floor(doc_id / 7) AS INT) % 4 WHEN 0 THEN 'remember' WHEN 1 THEN 'understand' WHEN 2 THEN 'apply' ELSE 'analyze' END",
        "question_type": "CASE doc_id % 7 WHEN 0 THEN 'standard' WHEN 1 THEN 'assertion_reason' WHEN 2 THEN 'statement_based' WHEN 3 THEN 'scenario_based' WHEN 4 THEN 'fill_blank' WHEN 5 THEN 'match_following' ELSE 'sequence_order' END",
        "correct_answer": "CASE WHEN doc_id % 37 = 0 THEN 'n/a' WHEN doc_id % 4 = 0 THEN option_a WHEN doc_id % 4 = 1 THEN option_b WHEN doc_id % 4 = 2 THEN option_c ELSE option_d END",
        "validation_status": "CASE WHEN quality = 1 THEN 'approved' WHEN quality = 0 THEN 'rejected' ELSE 'pending' END",
        "retry_count": "CAST(floor(doc_id / 9) AS INT) % 4",
        "generation_time": "CASE WHEN doc_id % 11 = 0 THEN CAST(0 AS DOUBLE) ELSE n_chars / CAST(1000 AS DOUBLE) END",
        "tag_1": "concat('t', CAST(doc_id % 5 AS STRING))",
        "tag_2": "concat('u', CAST(doc_id % 3 AS STRING))",
        "tag_3": "concat('v', CAST(doc_id % 2 AS STRING))",
        "created_epoch": "1704067200 + doc_id * 60",
        "question_uuid": "concat('q-', CAST(doc_id AS STRING))",
    },
]


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("question"), "n_chars")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    # Four neighbouring parts are the options of one question: one join instead of four.
    quad = F.floor(F.col("p_partkey") / 4).alias("quad")
    quads = (
        part.groupBy(quad)
        .agg(
            *[
                F.max(F.when(F.col("p_partkey") % 4 == i, F.col("p_name"))).alias(f"option_{n}")
                for i, n in enumerate("abcd")
            ],
            F.count("*").alias("n_in_quad"),
        )
        .where("n_in_quad = 4")
        .drop("n_in_quad")
    )
    n_quads = part.agg(F.floor(F.count("*") / 4)).scalar()
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    df = (
        docs.withColumn("quad", F.col("doc_id") % n_quads)
        .join(quads, "quad")
        .join(labels, "doc_id", "left")
    )
    for step in _STEPS:
        df = df.withColumns({k: F.expr(v) for k, v in step.items()})
    return df.select(
        F.col("doc_id").alias("id"), "question_uuid", "exam_set", "position", "question",
        F.array("option_a", "option_b", "option_c", "option_d").alias("options"),
        "correct_answer", "difficulty", "bloom_level", "chapter_no", "chapter_key", "display", "chapter",
        "question_type", "validation_status", "retry_count", "generation_time",
        F.array("tag_1", "tag_2", "tag_3").alias("tags"), "created_epoch", "quality", "n_chars",
    )


def _duck(expr: str) -> str:
    return expr.replace("AS STRING", "AS VARCHAR").replace("element_at(array(", "list_extract(list_value(")


def _nested_sql() -> str:
    inner = (
        "SELECT d.doc_id, d.text AS question, d.n_chars, q.option_a, q.option_b, q.option_c, q.option_d, l.quality "
        "FROM documents d JOIN quads q ON q.quad = d.doc_id % (SELECT count(*) // 4 FROM part) "
        "LEFT JOIN labels l ON l.doc_id = d.doc_id"
    )
    for step in _STEPS:
        cols = ", ".join(f"{_duck(v)} AS {k}" for k, v in step.items())
        inner = f"SELECT *, {cols} FROM ({inner})"
    return inner


ITEMS_SQL = (
    "quads AS (SELECT p_partkey // 4 AS quad, "
    + ", ".join(
        f"max(CASE WHEN p_partkey % 4 = {i} THEN p_name END) AS option_{n}" for i, n in enumerate("abcd")
    )
    + " FROM part GROUP BY 1 HAVING count(*) = 4), items AS (SELECT *, doc_id AS id, "
    "[option_a, option_b, option_c, option_d] AS options, [tag_1, tag_2, tag_3] AS tags FROM ("
    + _nested_sql()
    + "))"
)


def blueprint_sql() -> str:
    rows = ", ".join(
        f"({i + 1}, '{k}', {lo}, {hi}, {e}::DOUBLE, {m}::DOUBLE, {h}::DOUBLE)"
        for i, (k, lo, hi, e, m, h) in enumerate(R.BLUEPRINT)
    )
    return f"blueprint(chapter_no, chapter_key, min_q, max_q, easy, medium, hard) AS (VALUES {rows})"


def alias_sql() -> str:
    rows = ", ".join(
        f"('{d}', {i}, '{R.BLUEPRINT[n - 1][0]}')" for i, (d, n) in enumerate(R.CHAPTER_ALIASES)
    )
    return f"aliases(display, alias_order, chapter_key) AS (VALUES {rows})"
