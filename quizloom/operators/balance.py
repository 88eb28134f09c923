"""Quotas, answer balance, allocation.

The balance rules read like loops over accepted questions, but each has a closed
form. Let c be the accepted count, f_j a limit that never falls along the order, and
let row j be accepted when c + 1 <= f_j, starting from c = start. Then

    c_j = min(c_(j-1) + 1, max(start, f_j)) = j + min(start, min over i <= j of (max(start, f_i) - i))

so row j is refused exactly when its own gap max(start, f_j) - j lies below start and
below every earlier gap: a running minimum. Running values are spread over buckets
of the order (see ``ordered``), so one huge group is not one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import reference_values as R
from ..functions import text as X
from .metrics import option_position, with_blueprint
from .ordered import first_n, row_numbers, running

MIN_BATCH = 8
POSITION_SHARE = 0.45
A_START = 3


def _refused(late: DataFrame, keys: list[str], start: str, limit: Column, place: str, width: int) -> DataFrame:
    """Rows of ``late`` whose acceptance would break the limit (``place`` counts from 1)."""
    gap = late.withColumn("_gap", (F.greatest(F.col(start), limit) - F.col(place)).cast("bigint"))
    low = running(gap, keys, "order", {"_low": ("min_before", F.col("_gap"))}, width)
    return low.where(F.col("_gap") < F.least(F.col(start), F.col("_low")))


def _with_flags(rows: DataFrame, refused: DataFrame, keys: list[str]) -> DataFrame:
    fallen = refused.select(*keys, "order", F.lit(True).alias("flagged"))
    joined = rows.join(fallen, [*keys, "order"], "left")
    return joined.withColumn("flagged", F.coalesce("flagged", F.lit(False))).drop("order")


def enforce_answer_positions(bank: DataFrame, keys: list[str], order: str, width: int = 4096) -> DataFrame:
    """Flag surplus answers of an over-represented position, in order.

    A row falls when its position already holds 45% of the group and would exceed 55%
    of the rows seen so far; a fallen row still counts as seen. Adds
    ``answer_position`` and ``flagged``.
    """
    rows = bank.withColumns({"order": F.col(order), "answer_position": option_position()})
    narrow = rows.select(*keys, "order", "answer_position")
    sizes = narrow.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= MIN_BATCH)
    seen = row_numbers(narrow, keys, "order", "_seen", width).join(sizes, keys)
    by_position = [*keys, "answer_position"]
    ranked = row_numbers(seen.where("answer_position IS NOT NULL"), by_position, "order", "_k", width)
    start = F.ceil(F.col("_n") * F.lit(POSITION_SHARE))
    late = ranked.withColumns({"_start": start, "_place": F.col("_k") - start}).where("_place > 0")
    limit = F.floor(F.col("_seen") * 11 / 20)
    return _with_flags(rows, _refused(late, by_position, "_start", limit, "_place", width), keys)


def is_first_option_reason() -> Column:
    """Answer of an assertion-reason question that names option A."""
    low = X.dedup_key(F.col("correct_answer"))
    return (
        (F.col("question_type") == "assertion_reason")
        & low.startswith("both a and r are true")
        & low.contains("correct explanation of a")
    )


def enforce_assertion_balance(bank: DataFrame, keys: list[str], order: str, width: int = 4096) -> DataFrame:
    """Flag assertion-reason questions that push option A above 40% after the first three."""
    rows = bank.withColumn("order", F.col(order))
    ar = rows.where("question_type = 'assertion_reason'").select(*keys, "order", is_first_option_reason().alias("_a"))
    one = F.when(F.col("_a"), 1).otherwise(0)
    numbered = running(
        ar, keys, "order",
        {"_r": ("sum", F.lit(1)), "_as": ("sum", one), "_bs": ("sum", 1 - one)}, width,
    )
    starts = numbered.where(F.col("_r") <= A_START).groupBy(*keys).agg(F.max("_as").alias("_start"))
    late = (
        numbered.where((F.col("_r") > A_START) & F.col("_a"))
        .join(starts, keys)
        .withColumn("_place", F.col("_as") - F.col("_start"))
    )
    limit = F.floor(F.col("_bs") * 2 / 3)
    return _with_flags(rows, _refused(late, keys, "_start", limit, "_place", width), keys)


def accept_quota(survivors: DataFrame, quotas: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First ``quota`` survivors of every group, numbered by ``place``.

    The largest quota is read first: with a literal bound every task keeps only that
    many rows per group before the shuffle.
    """
    most = quotas.agg(F.max("quota")).first()[0] or 0
    ranked = first_n(survivors, keys, [F.col(order)], most, "place")
    return ranked.join(quotas, keys).where("place <= quota").drop("quota")


def shortages(accepted: DataFrame, quotas: DataFrame, keys: list[str]) -> DataFrame:
    """What the next round has to supply; every quota row appears."""
    have = accepted.groupBy(*keys).agg(F.count("*").alias("accepted"))
    got = F.coalesce("accepted", F.lit(0))
    return quotas.join(have, keys, "left").select(
        *keys, "quota", got.alias("accepted"), (F.col("quota") - got).alias("shortage"),
        oversample(F.col("quota") - got).alias("next_batch"),
    )


def oversample(n: Column) -> Column:
    """How many to ask for: half as many again, three more at least; none if none is short."""
    return F.when(n > 0, F.greatest(n + 3, F.floor(n * 1.5))).otherwise(0).cast("bigint")


def allocate(sets: DataFrame, size: int = R.SET_SIZE) -> DataFrame:
    """Questions per chapter for every set: minimum, hash-seeded extra, then filled up in order.

    A fold over the nine chapters inside each set's row; sets stay independent.
    """
    n_min = sum(b[1] for b in R.BLUEPRINT)
    per_set = with_blueprint(sets.select("exam_set")).withColumns(
        {
            "seed": X.stable_number(F.lit("order"), "exam_set", "chapter_no"),
            "draw": X.stable_number(F.lit("draw"), "exam_set", "chapter_no"),
            "room": F.col("max_q") - F.col("min_q"),
        }
    )
    arrays = per_set.groupBy("exam_set").agg(
        F.sort_array(F.collect_list(F.struct("seed", "draw", "room", "chapter_no"))).alias("c")
    )
    start = F.struct(F.lit(size - n_min).cast("bigint").alias("left"), F.expr("CAST(map() AS MAP<INT, BIGINT>)").alias("extra"))

    def grant(acc: Column, x: Column) -> Column:
        most = F.least(x["room"].cast("bigint"), acc["left"])
        add = F.when(most > 0, x["draw"] % (most + 1)).otherwise(F.lit(0).cast("bigint"))
        return F.struct(
            (acc["left"] - add).alias("left"),
            F.map_concat(acc["extra"], F.create_map(x["chapter_no"], add)).alias("extra"),
        )

    given = arrays.select("exam_set", F.aggregate("c", start, grant).alias("g"))
    rooms = F.array(*[F.lit(hi - lo) for _, lo, hi, *_ in R.BLUEPRINT])
    spare = F.transform(rooms, lambda r, i: r - F.element_at(F.col("g.extra"), i + 1))

    def fill(acc: Column, r: Column) -> Column:
        add = F.least(r, acc["left"])
        return F.struct((acc["left"] - add).alias("left"), F.concat(acc["out"], F.array(add)).alias("out"))

    filled = F.aggregate(
        spare, F.struct(F.col("g.left").alias("left"), F.expr("CAST(array() AS ARRAY<BIGINT>)").alias("out")), fill
    )
    done = given.withColumn("f", filled["out"])
    return with_blueprint(done).select(
        "exam_set", "chapter_no", "chapter_key", "min_q", "max_q",
        (F.col("min_q") + F.element_at("g.extra", F.col("chapter_no")) + F.element_at("f", F.col("chapter_no")))
        .cast("bigint").alias("quota"),
    )


def allocation_report(allocation: DataFrame) -> DataFrame:
    """Allocation rows and one total row per set."""
    return (
        allocation.groupingSets(
            [["exam_set", "chapter_key", "min_q", "max_q"], ["exam_set"]],
            "exam_set", "chapter_key", "min_q", "max_q",
        )
        .agg(F.sum("quota").alias("quota"))
        .withColumn("chapter_key", F.coalesce("chapter_key", F.lit("TOTAL")))
    )


def difficulty_counts(allocation: DataFrame) -> DataFrame:
    """Rounded difficulty counts per chapter (half to even); the drift goes to medium."""
    with_shares = allocation.join(F.broadcast(with_blueprint(
        allocation.sparkSession.range(1)).select("chapter_no", "easy", "medium", "hard")), "chapter_no")
    r = {d: F.bround(F.col(d) * F.col("quota")).cast("bigint") for d in ("easy", "medium", "hard")}
    drift = F.col("quota") - (r["easy"] + r["medium"] + r["hard"])
    return with_shares.select(
        "exam_set", "chapter_no", "quota", r["easy"].alias("easy"), (r["medium"] + drift).alias("medium"), r["hard"].alias("hard")
    )


def format_counts(allocation: DataFrame) -> DataFrame:
    """Rounded counts per question type; the drift goes to standard, never below zero."""
    r = {t: F.bround(F.lit(s) * F.col("quota")).cast("bigint") for t, s in R.FORMAT_MIX}
    total = sum(r.values(), F.lit(0))
    r["standard"] = F.greatest(r["standard"] + F.col("quota") - total, F.lit(0))
    return allocation.select("exam_set", "chapter_no", "quota", *[c.alias(t) for t, c in r.items()])


def in_blueprint_order(accepted: DataFrame) -> DataFrame:
    """One table of all chapters, ordered by chapter and acceptance, shuffled per set by hash."""
    return accepted.withColumns(
        {
            "blueprint_chapter": F.col("chapter_no"),
            "blueprint_place": F.col("place"),
            "shuffle_key": X.stable_number("question_uuid", "exam_set"),
        }
    )
