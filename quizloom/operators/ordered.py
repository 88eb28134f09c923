"""Running values over an order, without one task per group.

A plain window sends a whole group through one task. Here the order is cut into
fixed-width buckets: a bucket's total is aggregated with map-side combine, only
these totals run through a window of the group, and rows are ordered inside their
bucket. A group holding a third of all rows is spread over its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_AGG = {"sum": F.sum, "min": F.min, "max": F.max}
_BEFORE = "_before"


def _combine(kind: str, earlier: Column, here: Column) -> Column:
    if kind == "sum":
        return F.coalesce(earlier, F.lit(0)) + F.coalesce(here, F.lit(0))
    return F.least(earlier, here) if kind == "min" else F.greatest(earlier, here)


def running(
    df: DataFrame,
    keys: list[str],
    order: str,
    values: dict[str, tuple[str, Column]],
    width: int = 4096,
) -> DataFrame:
    """Add running ``sum`` / ``min`` / ``max`` columns along ``order``.

    A kind ending in ``_before`` leaves the row itself out (null where nothing precedes).
    ``order`` is a non-null whole number, unique inside a group. ``width`` suits dense
    numbers; for sparse ones take ``bucket_width``, or every row is its own bucket.
    """
    bucket = "_bucket"
    at = F.floor(F.col(order) / width)
    fn = {name: _AGG[kind.removesuffix(_BEFORE)] for name, (kind, _) in values.items()}
    totals = df.groupBy(*keys, at.alias(bucket)).agg(
        *[fn[name](expr).alias(f"_t_{name}") for name, (_, expr) in values.items()]
    )
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col(bucket).alias("_k_bucket"),
        *[fn[name](f"_t_{name}").over(before).alias(f"_b_{name}") for name in values],
    )
    match = F.col(bucket) == F.col("_k_bucket")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    ordered = Window.partitionBy(*keys, bucket).orderBy(order)
    joined = df.withColumn(bucket, at).join(carried, match)
    out = joined.withColumns(
        {
            name: _combine(
                kind.removesuffix(_BEFORE),
                F.col(f"_b_{name}"),
                fn[name](expr).over(ordered.rowsBetween(Window.unboundedPreceding, -1 if kind.endswith(_BEFORE) else 0)),
            )
            for name, (kind, expr) in values.items()
        }
    )
    return out.select(*df.columns, *values.keys())


def bucket_width(df: DataFrame, order: str, rows: int = 4096) -> int:
    """Width that puts about ``rows`` rows of the whole table into one bucket."""
    lo, hi, n = df.agg(F.min(order), F.max(order), F.count(order)).first()
    return max(1, (hi - lo + 1) * rows // n) if n else rows


def row_numbers(df: DataFrame, keys: list[str], order: str, name: str = "row_no", width: int = 4096) -> DataFrame:
    """1-based number of every row in its group."""
    return running(df, keys, order, {name: ("sum", F.lit(1))}, width)


def batch_numbers(df: DataFrame, keys: list[str], order: str, size: int, name: str = "batch_no") -> DataFrame:
    """0-based fixed-size batch of every row and the 1-based place in it."""
    numbered = row_numbers(df, keys, order, "_n")
    return numbered.withColumns(
        {
            name: F.floor((F.col("_n") - 1) / size).cast("int"),
            "item_no": ((F.col("_n") - 1) % size + 1).cast("int"),
        }
    ).drop("_n")


def first_n(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "rank_no") -> DataFrame:
    """First ``n`` rows per group; the literal bound lets every task keep only ``n``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)
