"""Answers that another question of the set gives away.

The test "one string contains the other" becomes an equi-join: whatever is contained
starts with some three (two, one) characters, and the container has these characters
somewhere. Facts and answers are folded per set first, and only the two best
sources of every answer are kept, because a row needs at most one that is not itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import cut_lineage
from .ordered import first_n


def _grams(s: Column, n: int) -> Column:
    return F.when(
        F.length(s) >= n,
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - n + 1), lambda i: F.substring(s, i, n))),
    ).otherwise(F.array().cast("array<string>"))


def _contained(inner: DataFrame, outer: DataFrame, si: str, so: str) -> DataFrame:
    """(set, fact key, answer key) where ``si`` of inner lies inside ``so`` of outer."""
    i = inner.where(F.length(si) >= 1).withColumn("g", F.substring(F.col(si), 1, 3))
    o = outer.withColumn("g", F.explode(F.concat(_grams(F.col(so), 3), _grams(F.col(so), 2), _grams(F.col(so), 1))))
    return i.join(o, ["exam_set", "g"]).where(F.contains(F.col(so), F.col(si)))


def answer_leaks(bank: DataFrame, least_answer: int = 1) -> DataFrame:
    """Leaked rows: ``id``, ``anchor`` (smallest of the best source), ``source_id``.

    Answers shorter than ``least_answer`` characters take no part."""
    text = F.concat_ws(" ", F.col("question"), F.array_join("options", " "))
    # The one-element explode keeps the text from being put together again for every pattern.
    texts = bank.select("exam_set", "id", F.explode(F.array(text)).alias("text"))
    found = texts.select("exam_set", "id", F.explode(X.anchors(F.col("text"))).alias("anchor"))
    # A fact with two sources leaks to everyone; one with a single source spares it.
    facts = (
        found.groupBy("exam_set", "anchor")
        .agg(F.min("id").alias("s1"), F.max("id").alias("s2"))
        .withColumns(
            {
                "au": F.regexp_replace(F.upper("anchor"), " ", ""),
                "al": F.col("anchor"),
            }
        )
    )
    answers = (
        bank.where(F.length(X.strip(F.col("correct_answer"))) >= least_answer)
        .select("exam_set", "correct_answer").distinct()
        .withColumns(
            {
                "cu": F.regexp_replace(F.upper("correct_answer"), " ", ""),
                "cl": X.collapse(F.col("correct_answer")),
            }
        )
    )
    # Four joins read these two small tables: the texts must not be searched four times.
    facts, answers = cut_lineage(facts), cut_lineage(answers)
    keep = ["exam_set", "correct_answer", "anchor", "s1", "s2"]
    hits = (
        _contained(facts, answers, "au", "cu").select(keep)
        .unionByName(_contained(answers, facts, "cu", "au").select(keep))
        .unionByName(_contained(facts, answers, "al", "cl").select(keep))
        .unionByName(_contained(answers, facts, "cl", "al").select(keep))
    )
    # Best two (anchor, source) of every answer, each source with its smallest fact.
    key = ["exam_set", "correct_answer"]
    per_source = (
        hits.select(*key, "anchor", F.explode(F.array_distinct(F.array("s1", "s2"))).alias("src"))
        .groupBy(*key, "src")
        .agg(F.min("anchor").alias("anchor"))
    )
    two = first_n(per_source, key, [F.col("anchor"), F.col("src")], 2)
    pair = F.struct("anchor", "src")
    best = two.groupBy(*key).agg(
        F.max(F.when(F.col("rank_no") == 1, pair)).alias("m1"), F.max(F.when(F.col("rank_no") == 2, pair)).alias("m2")
    )
    pick = F.when(F.col("m1.src") != F.col("id"), F.col("m1")).otherwise(F.col("m2"))
    return (
        bank.select("exam_set", "id", "correct_answer")
        .join(best, ["exam_set", "correct_answer"])
        .withColumn("p", pick)
        .where("p IS NOT NULL")
        .select("exam_set", "id", F.col("p.anchor").alias("anchor"), F.col("p.src").alias("source_id"))
    )
