"""Quality metrics of all exam sets in one plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import reference_values as R
from ..functions import text as X
from ..schemas import blueprint as blueprint_rows
from .setjoin import jaccard_pair_counts, overlap_pair_counts

JACCARD_LIMIT = 0.55
TAG_OVERLAP_LIMIT = 0.8


def answer_in_options() -> Column:
    return F.array_contains("options", F.col("correct_answer"))


def bloom_fits() -> Column:
    """True when the Bloom level is one of those expected for the difficulty."""
    fits = F.lit(False)
    for level, allowed in R.BLOOM_FOR.items():
        fits = fits | ((F.col("difficulty") == level) & F.col("bloom_level").isin(allowed))
    return F.coalesce(fits, F.lit(False))


def percent(part: Column, whole: Column) -> Column:
    return F.bround(part / whole * 100, 1)


def counts_per_set(bank: DataFrame) -> DataFrame:
    """Everything a single aggregation gives: counts, not ratios."""
    one = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    timed = F.col("generation_time") > 0
    return bank.groupBy("exam_set").agg(
        F.count("*").alias("total_questions"),
        one(F.col("validation_status") == "approved").alias("approved"),
        one(answer_in_options()).alias("answer_ok"),
        F.sum("retry_count").cast("bigint").alias("retries"),
        one(bloom_fits()).alias("bloom_ok"),
        F.sum(F.when(timed, F.col("generation_time"))).alias("time_sum"),
        one(timed).alias("time_n"),
        *[one(F.col("difficulty") == d).alias(f"n_{d}") for d in R.BLOOM_FOR],
        *[
            one(F.col("bloom_level") == b).alias(f"n_{b}")
            for b in ("remember", "understand", "apply", "analyze")
        ],
    )


def simple_metrics(bank: DataFrame) -> DataFrame:
    """Accuracies, rejection rate, Bloom accuracy and generation averages per set."""
    n = F.col("total_questions")
    return counts_per_set(bank).select(
        "exam_set",
        "total_questions",
        percent(F.col("approved"), n).alias("question_accuracy"),
        percent(F.col("answer_ok"), n).alias("answer_accuracy"),
        F.when(n + F.col("retries") > 0, percent(F.col("retries"), n + F.col("retries")))
        .otherwise(0.0)
        .alias("rejection_rate"),
        percent(F.col("bloom_ok"), n).alias("bloom_accuracy"),
        F.when(F.col("time_n") > 0, F.bround(F.col("time_sum") / F.col("time_n"), 3))
        .otherwise(0.0)
        .alias("avg_generation_time"),
        F.bround(F.col("retries") / n, 2).alias("avg_retry_count"),
        *[f"n_{d}" for d in R.BLOOM_FOR],
        *[f"n_{b}" for b in ("remember", "understand", "apply", "analyze")],
    )


def _pair_total(n: Column) -> Column:
    return n * (n - 1) / 2


def uniqueness(bank: DataFrame, above: float = JACCARD_LIMIT) -> DataFrame:
    """Share of question pairs of a set that are no near duplicates by word sets."""
    sizes = bank.groupBy("exam_set").agg(F.count("*").alias("n"))
    pairs = jaccard_pair_counts(bank, ["exam_set"], "id", X.word_set(F.col("question")), above)
    total = _pair_total(F.col("n"))
    near = F.coalesce("pairs", F.lit(0))
    return sizes.join(pairs, "exam_set", "left").select(
        "exam_set",
        near.alias("near_dup_pairs"),
        F.when(total > 0, F.bround((1 - near / total) * 100, 1)).otherwise(100.0).alias("semantic_uniqueness"),
    )


def concept_overlap(bank: DataFrame, at_least: float = TAG_OVERLAP_LIMIT) -> DataFrame:
    """Share of question pairs of a set whose tags overlap."""
    sizes = bank.groupBy("exam_set").agg(F.count("*").alias("n"))
    pairs = overlap_pair_counts(bank, ["exam_set"], F.col("tags"), at_least)
    total = _pair_total(F.col("n"))
    hit = F.coalesce("pairs", F.lit(0))
    return sizes.join(pairs, "exam_set", "left").select(
        "exam_set",
        hit.alias("overlap_pairs"),
        F.when(total > 0, percent(hit, total)).otherwise(0.0).alias("concept_overlap"),
    )


def resolve_chapters(names: DataFrame) -> DataFrame:
    """Chapter key for every distinct ``chapter``: equal, equal letters, contained, else itself."""
    known = F.array(
        *[
            F.struct(F.lit(i).alias("o"), F.lit(d).alias("d"), F.lit(R.BLUEPRINT[n - 1][0]).alias("k"))
            for i, (d, n) in enumerate(R.CHAPTER_ALIASES)
        ]
    )
    c = F.col("chapter")
    d = F.col("a.d")
    tier = (
        F.when(c == d, 1)
        .when(X.name_key(c) == X.name_key(d), 2)
        .when(F.contains(F.lower(c), F.lower(d)) | F.contains(F.lower(d), F.lower(c)), 3)
    )
    best = (
        names.select("chapter").distinct()
        .select("chapter", F.explode(known).alias("a"))
        .groupBy("chapter")
        .agg(F.min(F.when(tier.isNotNull(), F.struct(tier.alias("t"), F.col("a.o"), F.col("a.k")))).alias("m"))
    )
    return best.select("chapter", F.coalesce("m.k", "chapter").alias("resolved_key"), F.coalesce("m.t", F.lit(4)).alias("tier"))


def chapter_counts(bank: DataFrame) -> DataFrame:
    """Questions per set, resolved chapter and difficulty; names are resolved after counting."""
    raw = bank.groupBy("exam_set", "chapter", "difficulty").agg(F.count("*").alias("n"))
    return (
        raw.join(resolve_chapters(raw), "chapter")
        .groupBy("exam_set", "resolved_key", "difficulty")
        .agg(F.sum("n").alias("n"))
    )


def _blueprint_array() -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("chapter_no"), F.lit(k).alias("chapter_key"),
                F.lit(lo).alias("min_q"), F.lit(hi).alias("max_q"),
                F.lit(e).alias("easy"), F.lit(m).alias("medium"), F.lit(h).alias("hard"),
            )
            for i, (k, lo, hi, e, m, h) in enumerate(R.BLUEPRINT)
        ]
    )


def with_blueprint(sets: DataFrame) -> DataFrame:
    """Nine rows for every row of ``sets``."""
    return sets.select("*", F.inline(_blueprint_array()))


def chapter_coverage(bank: DataFrame) -> DataFrame:
    """Actual count, limits and verdict of every blueprint chapter, empty ones included."""
    levels = ("easy", "medium", "hard")
    per_key = (
        chapter_counts(bank)
        .groupBy("exam_set", F.col("resolved_key").alias("chapter_key"))
        .agg(
            F.sum("n").alias("actual"),
            *[F.sum(F.when(F.col("difficulty") == d, F.col("n")).otherwise(0)).alias(f"n_{d}") for d in levels],
        )
    )
    sets = bank.select("exam_set").distinct()
    full = with_blueprint(sets).join(per_key, ["exam_set", "chapter_key"], "left")
    actual = F.coalesce("actual", F.lit(0))
    balance = reduce(
        lambda x, y: x + y,
        [1 - F.abs(F.coalesce(f"n_{d}", F.lit(0)) / F.col("actual") - F.col(d)) for d in levels],
    )
    return full.select(
        "exam_set", "chapter_no", "chapter_key", "min_q", "max_q",
        actual.alias("actual"),
        actual.between(F.col("min_q"), F.col("max_q")).alias("in_range"),
        F.when(actual > 0, balance).otherwise(0.0).alias("score_sum"),
        F.when(actual > 0, 3).otherwise(1).alias("score_n"),
    )


def difficulty_balance(bank: DataFrame) -> DataFrame:
    """Mean closeness of difficulty shares to their targets; an empty chapter is one zero.

    Only chapters with questions are looked at: each gives three scores, and the
    blueprint chapters that are missing add one zero each to the divisor.
    """
    levels = ("easy", "medium", "hard")
    limits = F.broadcast(blueprint_rows(bank.sparkSession))
    per_key = (
        chapter_counts(bank)
        .groupBy("exam_set", F.col("resolved_key").alias("chapter_key"))
        .agg(
            F.sum("n").alias("actual"),
            *[F.sum(F.when(F.col("difficulty") == d, F.col("n")).otherwise(0)).alias(f"n_{d}") for d in levels],
        )
        .join(limits, "chapter_key", "left")
    )
    known = F.col("min_q").isNotNull()
    score = reduce(lambda x, y: x + y, [1 - F.abs(F.col(f"n_{d}") / F.col("actual") - F.col(d)) for d in levels])
    in_range = known & F.col("actual").between(F.col("min_q"), F.col("max_q"))
    present = F.sum(F.when(known, 1).otherwise(0))
    return per_key.groupBy("exam_set").agg(
        F.bround(
            F.coalesce(F.sum(F.when(known, score)), F.lit(0.0)) / (present * 3 + (len(R.BLUEPRINT) - present)) * 100, 1
        ).alias("difficulty_balance"),
        F.sum(F.when(in_range, 1).otherwise(0)).alias("chapters_in_range"),
    )


def set_metrics(bank: DataFrame) -> DataFrame:
    """One row of metrics for every set."""
    group = ["exam_set"]
    near = jaccard_pair_counts(bank, group, "id", X.word_set(F.col("question")), JACCARD_LIMIT)
    tags = overlap_pair_counts(bank, group, F.col("tags"), TAG_OVERLAP_LIMIT)
    total = _pair_total(F.col("total_questions"))
    joined = (
        simple_metrics(bank)
        .join(difficulty_balance(bank), group)
        .join(near.withColumnRenamed("pairs", "_near"), group, "left")
        .join(tags.withColumnRenamed("pairs", "_tags"), group, "left")
    )
    hit = lambda c: F.coalesce(c, F.lit(0))
    return joined.withColumns(
        {
            "semantic_uniqueness": F.when(total > 0, F.bround((1 - hit("_near") / total) * 100, 1)).otherwise(100.0),
            "concept_overlap": F.when(total > 0, percent(hit("_tags"), total)).otherwise(0.0),
        }
    ).drop("_near", "_tags")


def metric_status(metrics: DataFrame) -> DataFrame:
    """Traffic light of every metric of every set."""
    names = [m for m, *_ in R.METRIC_LIMITS]
    long = metrics.unpivot("exam_set", names, "metric", "value")
    status = F.lit("green")
    for name, warn, crit, lower in R.METRIC_LIMITS:
        v = F.col("value")
        bad, poor = (v >= crit, v >= warn) if lower else (v < crit, v < warn)
        status = F.when(F.col("metric") == name, F.when(bad, "red").when(poor, "amber").otherwise("green")).otherwise(status)
    return long.withColumn("status", status)


def shares(bank: DataFrame, column: str) -> DataFrame:
    """Count and rounded percentage of every value per set; few values, so the window is tiny."""
    counts = bank.groupBy("exam_set", column).agg(F.count("*").alias("n"))
    totals = counts.groupBy("exam_set").agg(F.sum("n").alias("total"))
    return counts.join(totals, "exam_set").select(
        "exam_set", F.col(column).alias("value"), "n", F.floor(F.col("n") / F.col("total") * 100 + 0.5).alias("pct")
    )


def option_position() -> Column:
    """1-based place of the answer among the options, null when it is not there."""
    return F.nullif(F.array_position("options", F.col("correct_answer")), F.lit(0).cast("bigint"))


def answer_skew(bank: DataFrame, keys: list[str], least: int = 8, limit: float = 0.5) -> DataFrame:
    """Does one answer position hold more than its share; first such position is named."""
    pos = option_position()
    counts = bank.groupBy(*keys).agg(
        F.count("*").alias("n"),
        *[F.sum(F.when(pos == i + 1, 1).otherwise(0)).alias(f"n_{p}") for i, p in enumerate("abcd")],
    )
    total = F.col("n_a") + F.col("n_b") + F.col("n_c") + F.col("n_d")
    over = F.coalesce(*[F.when(F.col(f"n_{p}") / total > limit, p.upper()) for p in "abcd"])
    return counts.withColumn("skewed_option", F.when((F.col("n") >= least) & (total > 0), over))
