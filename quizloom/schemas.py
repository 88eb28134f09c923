"""Explicit schemas; nothing in this package infers one."""

from __future__ import annotations

from pyspark.sql import types as T

from . import reference_values as R

STRINGS = T.ArrayType(T.StringType())

QUESTION_BANK = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("question_uuid", T.StringType()),
        T.StructField("question_hash", T.StringType()),
        T.StructField("exam_set", T.IntegerType()),
        T.StructField("question", T.StringType()),
        T.StructField("options", STRINGS),
        T.StructField("correct_answer", T.StringType()),
        T.StructField("difficulty", T.StringType()),
        T.StructField("bloom_level", T.StringType()),
        T.StructField("chapter", T.StringType()),
        T.StructField("validation_status", T.StringType()),
        T.StructField("tags", STRINGS),
        T.StructField("weightage", T.DecimalType(4, 2)),
        T.StructField("question_type", T.StringType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("prompt_version", T.StringType()),
        T.StructField("generation_time", T.DecimalType(10, 4)),
        T.StructField("retry_count", T.ShortType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

VALIDATION_LOG = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("created_epoch", T.LongType()),
        T.StructField("question_uuid", T.StringType()),
        T.StructField("exam_set", T.IntegerType()),
        T.StructField("chapter", T.StringType()),
        T.StructField("question_text", T.StringType()),
        T.StructField("correct_answer", T.StringType()),
        T.StructField("difficulty", T.StringType()),
        T.StructField("validator_failed", T.StringType()),
        T.StructField("reason", T.StringType()),
    ]
)

CHAPTER_CONTENT = T.StructType(
    [
        T.StructField("course", T.StringType()),
        T.StructField("chapter", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField(
            "topics",
            T.ArrayType(
                T.StructType(
                    [T.StructField("topic", T.StringType()), T.StructField("notes", T.StringType())]
                )
            ),
        ),
    ]
)

RAW_CHUNK = T.StructType(
    [
        T.StructField(n, T.StringType())
        for n in (
            "id", "text", "book", "chapter", "content_type",
            "section", "subsection", "question_no", "question_type", "term",
        )
    ]
)

SLUG_CHUNK = T.StructType(
    [
        T.StructField("chunk_id", T.StringType()),
        T.StructField("chapter_id", T.StringType()),
        T.StructField("chapter_name", T.StringType()),
        T.StructField("section_heading", T.StringType()),
        T.StructField("topic_slug", T.StringType()),
        T.StructField("concept_id", T.StringType()),
        T.StructField("book_id", T.StringType()),
        T.StructField("chunk_type", T.StringType()),
        T.StructField("bloom_levels", STRINGS),
        T.StructField("difficulty", STRINGS),
        T.StructField("keywords", STRINGS),
        T.StructField("used_in_sets", STRINGS),
        T.StructField("q_count", T.IntegerType()),
        T.StructField("home_chapter", T.StringType()),
        T.StructField("cross_ref", STRINGS),
        T.StructField("text", T.StringType()),
    ]
)

SLUG_RULE = T.StructType(
    [
        T.StructField("chapter_id", T.StringType()),
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("pattern", T.StringType()),
        T.StructField("slug", T.StringType()),
        T.StructField("bloom_levels", STRINGS),
        T.StructField("difficulty", STRINGS),
    ]
)

VERDICT = T.StructType(
    [
        T.StructField("is_correct", T.BooleanType()),
        T.StructField("reasoning", T.StringType()),
        T.StructField("suggested_answer", T.StringType()),
        T.StructField("independent_answer", T.StringType()),
    ]
)


def blueprint(spark):
    """Nine rows, one per chapter, so a broadcast of it has a fixed size."""
    rows = [
        (i + 1, key, lo, hi, e, m, h) for i, (key, lo, hi, e, m, h) in enumerate(R.BLUEPRINT)
    ]
    return spark.createDataFrame(
        rows,
        "chapter_no int, chapter_key string, min_q int, max_q int, easy double, medium double, hard double",
    )


def chapter_aliases(spark):
    """Sixteen rows: known display names in look-up order."""
    rows = [(d, i, R.BLUEPRINT[n - 1][0]) for i, (d, n) in enumerate(R.CHAPTER_ALIASES)]
    return spark.createDataFrame(rows, "display string, alias_order int, chapter_key string")
