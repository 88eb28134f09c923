"""File sources and sinks. Every read has an explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..operators.bank import answer_key_documents, set_documents


def _status(spark: SparkSession, path: str, ask: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return getattr(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), ask)(p)


def exists(spark: SparkSession, path: str) -> bool:
    """Is there such a path on whatever file system it names?"""
    return _status(spark, path, "exists")


def is_folder(spark: SparkSession, path: str) -> bool:
    """Is there such a path, and is it a folder?"""
    return _status(spark, path, "isDirectory")


def read_chapters(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per topic of every chapter: a file is one JSON document, or one a line."""
    docs = spark.read.schema(S.CHAPTER_CONTENT).option("multiLine", not lines).json(path)
    return docs.select("course", "chapter", "summary", F.posexplode("topics").alias("place", "t")).select(
        "course", "chapter", "summary", "place", "t.topic", "t.notes"
    )


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Good records and quarantined raw lines; blank lines are neither.

    The file is read as text and parsed once, so both results come from one scan.
    """
    with_bad = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(
        "value", F.from_json("value", with_bad, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}).alias("r")
    )
    good = parsed.where("r._bad IS NULL").select("r.*").drop("_bad")
    return good, parsed.where("r._bad IS NOT NULL").select("value")


def read_raw_chunks(spark: SparkSession, json_path: str, markdown_path: str) -> tuple[DataFrame, str]:
    """Raw chunks from JSON lines if they exist, else from Markdown; the schema is the same.

    Numbers restart in every Markdown file, so ``document`` (null for JSON lines) names the file a chunk is from.
    """
    from ..operators.segment import heading_islands

    if exists(spark, json_path):
        chunks = read_json_lines(spark, json_path, S.RAW_CHUNK)[0]
        return chunks.withColumn("document", F.lit(None).cast("string")), json_path.rsplit("/", 1)[-1]
    if not exists(spark, markdown_path):
        raise FileNotFoundError(f"neither {json_path} nor {markdown_path}")
    docs = spark.read.text(markdown_path, wholetext=True).select(
        F.input_file_name().alias("doc_id"), F.col("value").alias("text")
    )
    none = F.lit(None).cast("string")
    chunks = heading_islands(docs).select(
        "id", "text", "book", "chapter", "content_type", "section",
        *[none.alias(n) for n in ("subsection", "question_no", "question_type", "term")],
        F.regexp_extract("doc_id", "[^/]+$", 0).alias("document"),
    )
    return chunks, markdown_path.rsplit("/", 1)[-1]


def read_slug_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.SLUG_CHUNK).json(path)


def read_slug_rules(spark: SparkSession, path: str) -> DataFrame:
    """The user's ordered tag rules: ``chapter_id``, ``ordinal``, ``pattern``, ``slug``, levels."""
    return spark.read.schema(S.SLUG_RULE).json(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


_QUESTION = T.StructType(
    [
        T.StructField("q_no", T.LongType()), T.StructField("id", T.LongType()),
        T.StructField("question", T.StringType()), T.StructField("options", S.STRINGS),
        T.StructField("correct_answer", T.StringType()), T.StructField("difficulty", T.StringType()),
        T.StructField("bloom_level", T.StringType()), T.StructField("chapter", T.StringType()),
        T.StructField("validation_status", T.StringType()), T.StructField("tags", S.STRINGS),
    ]
)
_EXPORT = T.StructType(
    [
        T.StructField("exam_set", T.IntegerType()), T.StructField("part", T.IntegerType()),
        T.StructField("n_parts", T.IntegerType()),
        T.StructField("course", T.StringType()), T.StructField("total_questions", T.LongType()),
        T.StructField("generated_epoch", T.LongType()), T.StructField("questions", T.ArrayType(_QUESTION)),
    ]
)


def write_sets(bank: DataFrame, path: str) -> None:
    """One document per set (numbered parts beyond the normal size), one folder per set."""
    set_documents(bank).write.mode("overwrite").partitionBy("exam_set").json(path)


def write_answer_keys(bank: DataFrame, path: str) -> None:
    answer_key_documents(bank).write.mode("overwrite").partitionBy("exam_set").json(path)


def read_sets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_EXPORT).json(path)


def list_sets(exported: DataFrame) -> DataFrame:
    """Number, size and date of every exported set, counted from its documents."""
    return exported.groupBy("exam_set").agg(
        F.sum(F.size("questions")).alias("total_questions"), F.max("generated_epoch").alias("generated_epoch")
    )


def questions_of(exported: DataFrame) -> DataFrame:
    return exported.select("exam_set", F.inline("questions"))


def append_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").partitionBy("chapter").parquet(path)


