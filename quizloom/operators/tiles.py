"""Pair comparisons inside blocks, spread over bounded tiles.

Some comparisons have no equi-join key: cosine or edit similarity inside a block.
A block is cut into tiles of about ``tile_rows`` rows by a hash of the row id; every
pair of tiles is one small group that compares its two tiles with arrays and emits
only the pairs that pass. No pair is emitted before it is verified, a task never
holds more than two tiles, and a block holding a third of all rows becomes many
tiles on many executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _type_of(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def _tiled(df: DataFrame, block: list[str], row_id: str, tile_rows: int | Column, tile: str, count: str) -> DataFrame:
    """``tile_rows`` may depend on the row: where rows are long, a tile has fewer."""
    many = F.count("*") / tile_rows if isinstance(tile_rows, int) else F.round(F.sum(1 / tile_rows), 6)
    sizes = df.groupBy(*block).agg(F.ceil(many).cast("int").alias(count))
    # Blocks of more than one tile are no more than there are tiles of rows, so they may be sent to all tasks.
    many = df.dropna(subset=block).join(F.broadcast(sizes.where(F.col(count) > 1)), block, "left")
    return many.withColumn(count, F.coalesce(count, F.lit(1))).withColumn(
        tile, F.pmod(F.xxhash64(row_id), F.col(count)).cast("int")
    )


def _each_tile(df: DataFrame, block: list[str], keys: list[str], run: Callable, schema: str) -> DataFrame:
    """``run`` on the frame of each tile pair gives arrays of left ids, right ids and scores. The work is CPU, not
    bytes, so the partition count is named: adaptive execution would otherwise merge the small groups into few tasks.

    Rows are sorted by their keys and read in batches of many groups, so that a block of a few rows costs a
    comparison, not a frame of its own each way. What is held is a batch and the group that its end cuts.
    """
    keys = [*block, *keys]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def results(frame: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        found = [run(frame.iloc[i:j].reset_index(drop=True)) for i, j in zip(starts, [*starts[1:], len(frame)])]
        at = np.repeat(starts, [len(f[0]) for f in found])
        out = {name: frame[name].to_numpy()[at] for name in block}
        for place, name in enumerate(("left_id", "right_id", "score")):
            hits = [f[place] for f in found if len(f[0])]
            out[name] = np.concatenate(hits) if hits else np.empty(0)
        return pd.DataFrame(out)

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            frame = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if not len(frame):
                continue
            before = frame[keys].shift()
            new = ((frame[keys] != before) & ~(frame[keys].isna() & before.isna())).any(axis=1).to_numpy()
            new[0] = True
            starts = np.flatnonzero(new)
            rest = frame.iloc[starts[-1] :]
            if len(starts) > 1:
                yield results(frame.iloc[: starts[-1]], starts[:-1])
        if rest is not None:
            yield results(rest, np.zeros(1, np.int64))

    return df.repartition(n, *keys).sortWithinPartitions(*keys).mapInPandas(stream, schema)


def pairs_within(
    df: DataFrame,
    block: list[str],
    row_id: str,
    payload: list[str],
    compare: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    tile_rows: int | Column = 1024,
) -> DataFrame:
    """Verified pairs of a block: block columns, ``left_id`` < ``right_id``, ``score``.

    ``compare`` gets two frames and returns positions ``i``, ``j`` and ``score``.
    """
    rows = df.select(*block, row_id, *payload)
    placed = _tiled(rows, block, row_id, tile_rows, "_tile", "_tiles")
    spread = (
        placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
        .withColumn("_lo", F.least("_tile", "_other"))
        .withColumn("_hi", F.greatest("_tile", "_other"))
        .drop("_tiles", "_other")
    )
    id_type = _type_of(df, row_id)
    schema = ", ".join(
        [f"`{b}` {_type_of(df, b)}" for b in block]
        + [f"left_id {id_type}", f"right_id {id_type}", "score double"]
    )

    def run(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lo, hi = pdf["_lo"].iat[0], pdf["_hi"].iat[0]
        left = pdf if lo == hi else pdf[pdf["_tile"] == lo].reset_index(drop=True)
        right = left if lo == hi else pdf[pdf["_tile"] == hi].reset_index(drop=True)
        hit = compare(left, right)
        a = left[row_id].to_numpy()[hit["i"].to_numpy()]
        b = right[row_id].to_numpy()[hit["j"].to_numpy()]
        score = hit["score"].to_numpy()
        swap = a > b
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        keep = a != b
        a, b, score = a[keep], b[keep], score[keep]
        if lo == hi and len(a):
            once = ~pd.DataFrame({"a": a, "b": b}).duplicated().to_numpy()
            a, b, score = a[once], b[once], score[once]
        return a, b, score

    return _each_tile(spread, block, ["_lo", "_hi"], run, schema)


def matches_across(
    left: DataFrame,
    right: DataFrame,
    block: list[str],
    left_id: str,
    right_id: str,
    payload: list[str],
    compare: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    left_rows: int | Column = 1024,
    right_rows: int | Column = 8192,
) -> DataFrame:
    """Verified matches of two tables that share a block: block, ``left_id``, ``right_id``, ``score``."""
    a = _tiled(left.select(*block, F.col(left_id).alias("_id"), *payload), block, "_id", left_rows, "_lt", "_ln")
    b = _tiled(right.select(*block, F.col(right_id).alias("_id"), *payload), block, "_id", right_rows, "_rt", "_rn")
    a_sizes = a.select(*block, "_ln").distinct()
    b_sizes = b.select(*block, "_rn").distinct()
    a_all = a.join(b_sizes, block).select(
        *block, F.lit(0).alias("_side"), "_id", *payload, "_lt",
        F.explode(F.sequence(F.lit(0), F.col("_rn") - 1)).alias("_rt"),
    )
    b_all = b.join(a_sizes, block).select(
        *block, F.lit(1).alias("_side"), "_id", *payload,
        F.explode(F.sequence(F.lit(0), F.col("_ln") - 1)).alias("_lt"), "_rt",
    )
    schema = ", ".join(
        [f"`{n}` {_type_of(left, n)}" for n in block]
        + [f"left_id {_type_of(left, left_id)}", f"right_id {_type_of(right, right_id)}", "score double"]
    )

    def run(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = pdf[pdf["_side"] == 0].reset_index(drop=True)
        y = pdf[pdf["_side"] == 1].reset_index(drop=True)
        hit = compare(x, y) if len(x) and len(y) else pd.DataFrame({"i": [], "j": [], "score": []}, dtype="int64")
        left, right = (t["_id"].to_numpy()[hit[c].to_numpy(dtype="int64")] for t, c in ((x, "i"), (y, "j")))
        return left, right, hit["score"].to_numpy(dtype="float64")

    return _each_tile(a_all.unionByName(b_all), block, ["_lt", "_rt"], run, schema)
