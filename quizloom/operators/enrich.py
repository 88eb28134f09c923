"""Metadata and passage texts attached to questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import reference_values as R
from ..functions import text as X
from .metrics import with_blueprint


def enrich(bank: DataFrame, chapters: DataFrame, model: str, prompt_version: str = "v2") -> DataFrame:
    """Tags (first five topics of the chapter), weight, model, version; marks rows approved.

    ``chapters`` has one row per blueprint chapter; how it is joined is left to its size.
    """
    limits = with_blueprint(bank.sparkSession.range(1)).select("chapter_no", "min_q")
    dim = chapters.select("chapter_no", F.slice("topics", 1, 5).alias("_tags")).join(limits, "chapter_no")
    return bank.join(dim, "chapter_no").withColumns(
        {
            "tags": F.col("_tags"),
            "weightage": F.bround(F.col("min_q") / 100, 2),
            "model_name": F.lit(model),
            "prompt_version": F.lit(prompt_version),
            "generation_time": F.bround("generation_time", 4),
            "validation_status": F.lit("approved"),
        }
    ).drop("_tags", "min_q")


def passage_blocks(passages: DataFrame, key: str) -> DataFrame:
    """All passages of a key, numbered by ``rank``, each with a breadcrumb."""
    crumb = F.concat_ws(" › ", F.nullif("section", F.lit("")), F.nullif("subsection", F.lit("")))
    head = F.concat(
        F.lit("[Passage "), F.col("rank").cast("string"), F.lit("]"),
        F.when(crumb != "", F.concat(F.lit(" ("), crumb, F.lit(")"))).otherwise(""),
    )
    line = F.concat(head, F.lit("\n"), X.strip(F.col("text")))
    return passages.select(key, "rank", line.alias("line")).groupBy(key).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n\n").alias("block")
    )


def topic_list(topics: Column) -> Column:
    return F.array_join(F.transform(topics, lambda t: F.concat(F.lit("• "), t["topic"], F.lit(": "), t["notes"])), "\n")


def slug_metadata(chunks: DataFrame, book_id: str = "book_v1") -> DataFrame:
    """Stored metadata of a tagged chunk with its defaults; text cut to 2000 characters."""
    c = F.col
    strings = "array<string>"
    return chunks.select(
        "chunk_id", "chapter_id", "chapter_name", "topic_slug", "chunk_type",
        F.concat_ws(":", "chapter_id", "topic_slug").alias("concept_id"),
        F.coalesce(c("book_id"), F.lit(book_id)).alias("book_id"),
        F.coalesce(c("bloom_levels"), F.array(F.lit("remember"))).alias("bloom_levels"),
        F.coalesce(c("difficulty"), F.array(F.lit("easy"))).alias("difficulty"),
        F.coalesce(c("keywords"), F.array().cast(strings)).alias("keywords"),
        F.coalesce(c("used_in_sets"), F.array().cast(strings)).alias("used_in_sets"),
        F.coalesce(c("q_count"), F.lit(0)).alias("q_count"),
        F.coalesce(c("home_chapter"), c("chapter_id")).alias("home_chapter"),
        F.coalesce(c("cross_ref"), F.array().cast(strings)).alias("cross_ref"),
        X.cut(c("text"), 2000).alias("text"),
        F.coalesce(c("section_heading"), F.lit("")).alias("section_heading"),
    )


def question_vector_metadata(bank: DataFrame) -> DataFrame:
    return bank.select("question_uuid", X.cut(F.col("question"), 500).alias("question_text"), "exam_set", "chapter")


def embedding_text(text: Column) -> Column:
    """What goes to the embedding service: at most 8000 characters."""
    return X.cut(text, 8000)


def seed_phrase(exam_set: Column) -> Column:
    """Phrase that varies a chapter's retrieval query from set to set."""
    phrases = F.array(*[F.lit(p) for p in R.SEED_PHRASES])
    return F.element_at(phrases, (F.pmod(exam_set - 1, F.lit(len(R.SEED_PHRASES))) + 1).cast("int"))


def chapter_lookup(bank: DataFrame) -> DataFrame:
    """Chapter id, snake-case name and book title by blueprint key."""
    rows = [
        (b[0], i, n, t) for b, (i, n), t in zip(R.BLUEPRINT, R.CHAPTER_IDS, R.BOOK_TITLES)
    ]
    dim = bank.sparkSession.createDataFrame(rows, "chapter_key string, chapter_id string, chapter_name string, book_title string")
    return bank.join(F.broadcast(dim), "chapter_key", "left")
