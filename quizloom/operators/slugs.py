"""Slug retrieval: unused slugs per chapter, difficulty quotas, one chunk per slug."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import reference_values as R
from ..functions import text as X
from .vector import DEFAULT_TOP_K, dot, metadata_filter, retrieve

LEVELS = ("easy", "medium", "hard")


def available_slugs(pool: DataFrame, questions: DataFrame, sets: DataFrame) -> DataFrame:
    """Best chunk of every slug that a set has not used yet; all slugs where none is left.

    ``pool`` has ``chapter_no``, ``topic_slug``, ``used_in_sets``, ``vec``; ``questions`` has one
    vector per chapter. Chunks are first folded per (chapter, slug, usage), so only
    slugs, not chunks, meet the sets.
    """
    scored = pool.join(
        questions.select("chapter_no", F.col("vec").alias("qv")), "chapter_no"
    ).withColumn("score", F.round(dot(F.col("qv"), F.col("vec")), 6))
    folded = scored.groupBy("chapter_no", "topic_slug", F.sort_array("used_in_sets").alias("used_in_sets")).agg(
        F.max(F.struct("score", (-F.col("id")).alias("neg"))).alias("b")
    )
    # The chapters are those of the blueprint's questions, a short list.
    numbers = [F.lit(r.chapter_no) for r in questions.select("chapter_no").distinct().collect()]
    chapters = sets.select("exam_set", F.explode(F.array(*numbers)).alias("chapter_no"))
    met = folded.join(chapters, "chapter_no").withColumn(
        "unused", ~F.array_contains("used_in_sets", F.col("exam_set").cast("string"))
    )
    any_unused = met.groupBy("exam_set", "chapter_no").agg(F.max("unused").alias("some"))
    usable = met.join(any_unused, ["exam_set", "chapter_no"]).where("unused OR NOT some")
    best = usable.groupBy("exam_set", "chapter_no", "topic_slug").agg(F.max("b").alias("b"))
    chosen = best.select("exam_set", "chapter_no", "topic_slug", (-F.col("b.neg")).alias("id"), F.col("b.score").alias("score"))
    return chosen.join(pool.select("id", "difficulty"), "id")


def difficulty_quota(n: Column, easy: Column, medium: Column, hard: Column) -> dict[str, Column]:
    """Rounded shares (half to even); what rounding leaves over goes to easy."""
    q = {"easy": F.bround(easy * n), "medium": F.bround(medium * n), "hard": F.bround(hard * n)}
    rest = n - (q["easy"] + q["medium"] + q["hard"])
    q["easy"] = q["easy"] + rest
    return {k: v.cast("int") for k, v in q.items()}


def sample_by_difficulty(available: DataFrame, quotas: DataFrame) -> DataFrame:
    """Slugs sampled per set and chapter by difficulty quota, missing ones borrowed.

    A slug belongs to the first difficulty it lists. Inside a bucket the order is a
    hash; easy, medium, hard are served in turn, and each fills its own shortage
    from the other buckets in the same order. Takes are plain arithmetic on three
    bucket sizes and three quotas; rows are then cut by rank range.
    """
    keys = ["exam_set", "chapter_no"]
    level = F.get(F.filter("difficulty", lambda d: d.isin(list(LEVELS))), F.lit(0))
    pool = available.withColumn("bucket", level).where("bucket IS NOT NULL").withColumn(
        "seed", X.stable_number("exam_set", "chapter_no", "topic_slug")
    )
    w = Window.partitionBy(*keys, "bucket").orderBy("seed", "topic_slug")
    limit = quotas.agg(F.max("n_questions")).scalar()
    ranked = pool.withColumn("r", F.row_number().over(w)).where(F.col("r") <= 3 * limit)
    sizes = pool.groupBy(*keys).agg(
        *[F.sum(F.when(F.col("bucket") == b, 1).otherwise(0)).alias(f"have_{b}") for b in LEVELS]
    )
    plan = sizes.join(quotas, keys)
    left = {b: F.col(f"have_{b}") for b in LEVELS}
    step = 0
    df = plan.withColumns({f"left_{b}": c for b, c in left.items()})
    for b in LEVELS:
        order = [b, *[o for o in LEVELS if o != b]]
        df = df.withColumn("need", F.col(f"quota_{b}"))
        for o in order:
            step += 1
            df = (
                df.withColumn("take", F.greatest(F.least("need", f"left_{o}"), F.lit(0)))
                .withColumn(f"cut_{step}", F.struct(
                    F.lit(o).alias("bucket"), (F.col(f"have_{o}") - F.col(f"left_{o}")).alias("after"),
                    F.col("take").alias("take"), F.lit(b).alias("served"), F.lit(step).alias("step"),
                ))
                .withColumn(f"left_{o}", F.col(f"left_{o}") - F.col("take"))
                .withColumn("need", F.col("need") - F.col("take"))
            )
    cuts = df.select(*keys, F.inline(F.array(*[f"cut_{i + 1}" for i in range(step)]))).where("take > 0")
    hit = (F.col("r") > F.col("after")) & (F.col("r") <= F.col("after") + F.col("take"))
    return ranked.join(cuts, [*keys, "bucket"]).where(hit).select(
        *keys, "topic_slug", "id", F.col("bucket").alias("target_difficulty"), F.col("served").alias("served_quota"), "step", "r", "score"
    )


def chunk_for_slug(sampled: DataFrame, pool: DataFrame, questions: DataFrame) -> DataFrame:
    """Best chunk of every sampled slug by the similarity to its slug's query vector."""
    slugs = sampled.select("chapter_no", "topic_slug").distinct()
    scored = (
        pool.join(slugs, ["chapter_no", "topic_slug"], "left_semi")
        .join(questions.select("chapter_no", F.col("vec").alias("qv")), "chapter_no")
        .withColumn("fit", F.round(dot(F.col("qv"), F.col("vec")), 6))
    )
    best = scored.groupBy("chapter_no", "topic_slug").agg(
        F.max(F.struct(F.col("fit"), (-F.col("id")).alias("neg"))).alias("b")
    ).select("chapter_no", "topic_slug", (-F.col("b.neg")).alias("chunk_id"), F.col("b.fit").alias("chunk_score"))
    return sampled.join(best, ["chapter_no", "topic_slug"])


def mark_used(pool: DataFrame, accepted: DataFrame) -> DataFrame:
    """Add the accepting sets to each chunk and count its questions.

    ``accepted`` has ``id`` (chunk) and ``exam_set``; a chunk's set list is as long as the
    number of sets that used it.
    """
    per_set = accepted.groupBy("id", "exam_set").agg(F.count("*").alias("n"))
    per_chunk = per_set.groupBy("id").agg(
        F.sort_array(F.collect_set(F.col("exam_set").cast("string"))).alias("new_sets"), F.sum("n").alias("new_count")
    )
    merged = pool.join(per_chunk, "id", "left")
    none = F.array().cast("array<string>")
    return merged.withColumns(
        {
            "used_in_sets": F.array_distinct(F.array_union("used_in_sets", F.coalesce("new_sets", none))),
            "q_count": (F.col("q_count") + F.coalesce("new_count", F.lit(0))).cast("bigint"),
        }
    ).drop("new_sets", "new_count")


def pair_by_rank(passages: DataFrame, accepted: DataFrame, keys: list[str]) -> DataFrame:
    """The i-th accepted question uses the i-th passage; both sides carry ``place``."""
    return accepted.join(passages, [*keys, "place"])


def unserved(slug_passages: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted keys without any slug passage."""
    return wanted.select(*keys).join(slug_passages.select(*keys).distinct(), keys, "left_anti")


def fallback_passages(missing: DataFrame, asks: DataFrame, corpus: DataFrame, k: int = DEFAULT_TOP_K, content_type: str = "content") -> DataFrame:
    """Plain retrieval for sets and chapters (``exam_set``, ``chapter_no``) without slug passages.

    A set asks with the seed phrase of its number: ``asks`` has ``chapter_no``, ``seed_no`` (from 0) and ``vec``. Only
    rows of the chapter and of the content type (``corpus``: ``id``, ``vec``, ``text``, ``chapter_no``, ``content_type``) are
    candidates, and the best are re-ranked. Sets that share chapter and seed share one search, and what no key
    misses is not searched.
    """
    seeded = missing.withColumn("seed_no", F.pmod(F.col("exam_set") - 1, F.lit(len(R.SEED_PHRASES))).cast("int"))
    needed = asks.join(seeded.select("chapter_no", "seed_no").distinct(), ["chapter_no", "seed_no"], "left_semi")
    queries = needed.withColumn("query_id", (F.col("chapter_no") * len(R.SEED_PHRASES) + F.col("seed_no")).cast("bigint"))
    found = retrieve(metadata_filter(corpus, content_type=content_type), queries, k, ["chapter_no"])
    of = queries.select("query_id", "chapter_no", "seed_no")
    return found.join(of, "query_id").join(seeded, ["chapter_no", "seed_no"]).select("exam_set", "chapter_no", "id", "score", "mmr_score", "place")


def chunk_passages(chunks: DataFrame) -> DataFrame:
    """Passage rows as the question writer expects them; slug passages are not re-ranked, so both scores are one."""

    def listed(name: str, *default: str) -> Column:
        return F.coalesce(name, F.array(*[F.lit(d) for d in default]).cast("array<string>")).alias(name)

    metadata = F.struct(
        "text", F.col("chapter_id").alias("chapter"), F.coalesce("section_heading", F.lit("")).alias("section"), "topic_slug",
        listed("bloom_levels", "remember"), listed("difficulty", "easy"), listed("keywords"),
    )
    return chunks.select(
        "exam_set", "chapter_no", F.col("chunk_id").alias("id"), F.col("chunk_score").alias("score"),
        F.col("chunk_score").alias("mmr_score"), metadata.alias("metadata"),
    )
