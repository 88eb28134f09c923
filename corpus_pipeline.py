"""Corpus pipeline: each stage takes what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quizloom.llm import language_id, ngram_join, packing, quality
from quizloom.llm.common import read, saved

#: A document is rejected if good quality is less probable than this: clean ones are to stay.
LEAST_QUALITY = 0.3
#: A document whose best language has a smaller share than this is rejected, as are texts without letters.
SURE_LANGUAGE = 0.5


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is told with confidence stay."""
    known = docs.where(~language_id.held_out()).where("doc_id is not null")
    scored = language_id.predict(docs, language_id.train(known))
    return scored.where((scored.lang_pred != language_id.UNKNOWN) & (scored.score >= SURE_LANGUAGE)).select(docs.columns)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality stay."""
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.where(scored.score >= LEAST_QUALITY).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five words, 0.8 or more)."""
    return ngram_join.one_per_group(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", identified),
    ("quality classifier", good),
    ("n-gram Jaccard join", near_duplicates),
    ("packing", packed),
]

#: The learnt stages have no SQL; ``tests/llm/test_pipeline.py`` compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
