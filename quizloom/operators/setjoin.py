"""Exact set-similarity counts inside groups, without emitting all pairs.

Equal sets are folded into one weighted representative first, so copies cost
nothing however many there are. For Jaccard the representatives of a group that fits a
task (an exam set, say) are counted there as arrays, so a set travels once and its elements never
become rows. Those of a larger group meet through a
prefix index (size, prefix and position filters of the published all-pairs /
PPJoin family): tokens are ranked rare-first inside their group, so a token that a
third of a group shares is the last to be indexed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

_EPS = 1e-9
#: Distinct sets, and elements of them, that a task counts as arrays; a group beyond either takes the prefix index.
GROUP_SETS, GROUP_ELEMENTS = 512, 1_000_000
#: Cells of an incidence matrix held at once.
_CELLS = 2**22


def _hashes(elements: Column) -> Column:
    return F.sort_array(F.array_distinct(F.transform(elements, lambda x: F.xxhash64(x))))


def weighted_sets(df: DataFrame, group: list[str], row_id: str, elements: Column) -> DataFrame:
    """One row per distinct non-empty set of a group: ``rep``, ``copies``, ``hs`` (element hashes).

    The text is read and split once; from here on only hashes travel.
    """
    # A one-element explode keeps the optimizer from repeating the expression in the filter
    # and in each signature: the text is split once per row.
    once = F.explode(F.array(_hashes(elements)))
    rows = df.select(*group, F.col(row_id).alias("rep"), once.alias("hs")).where(F.size("hs") > 0)
    signature = (F.xxhash64("hs").alias("sig"), F.hash("hs").alias("sig2"), F.size("hs").alias("n"))
    return (
        rows.groupBy(*group, *signature)
        .agg(F.min("rep").alias("rep"), F.count("*").alias("copies"), F.any_value("hs").alias("hs"))
        .drop("sig", "sig2")
    )


def jaccard_pairs(df: DataFrame, group: list[str], row_id: str, elements: Column, above: float) -> DataFrame:
    """Pairs of distinct sets of a group with Jaccard strictly above the limit.

    Columns: group, ``left_rep``, ``right_rep``, ``left_copies``, ``right_copies``,
    ``shared``, ``joined`` (sizes of intersection and union).
    """
    return _pairs_of(cut_lineage(weighted_sets(df, group, row_id, elements)), group, above)


def _pairs_of(sets: DataFrame, group: list[str], above: float) -> DataFrame:
    """``sets`` is read several times: a checkpoint."""
    sets = sets.dropna(subset=[*group, "rep"])
    sizes = sets.groupBy(*group).agg(F.count("*").alias("sets"), F.sum("n").alias("elements"))
    # Each holds more than GROUP_SETS rows or GROUP_ELEMENTS elements, so they are few and may be sent to all tasks.
    large = F.broadcast(sizes.where((F.col("sets") > GROUP_SETS) | (F.col("elements") > GROUP_ELEMENTS)).select(*group))
    small = _counted_pairs(sets.join(large, group, "left_anti"), group, above)
    return small.unionByName(_indexed_pairs(sets.join(large, group, "left_semi"), group, above))


def shared_elements(lengths: np.ndarray, elements: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all sets, which follow each other in ``elements``: incidence times its transpose."""
    _, place, users = np.unique(elements, return_inverse=True, return_counts=True)
    met = users > 1
    keep = met[place]
    row, column = np.repeat(np.arange(len(lengths)), lengths)[keep], (np.cumsum(met) - 1)[place[keep]]
    total, width = int(met.sum()), max(1, _CELLS // max(1, len(lengths)))
    shared = np.zeros((len(lengths), len(lengths)), np.int64)
    for start in range(0, total, width):
        here = (column >= start) & (column < start + width)
        incidence = np.zeros((len(lengths), min(width, total - start)), np.float32)
        incidence[row[here], column[here] - start] = 1
        shared += (incidence @ incidence.T).astype(np.int64)
    return shared


def _counted_pairs(sets: DataFrame, group: list[str], above: float) -> DataFrame:
    """The pairs of groups that fit a task."""
    keys = ", ".join(f"`{g}` {sets.schema[g].dataType.simpleString()}" for g in group)
    rep = sets.schema["rep"].dataType.simpleString()
    schema = f"{keys}, left_rep {rep}, right_rep {rep}, left_copies long, right_copies long, shared int, joined int"

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep").combine_chunks()
        hs = table["hs"].chunk(0)
        n, reps = table["n"].to_numpy().astype(np.int64), table["rep"].to_numpy()
        shared = shared_elements(n, hs.flatten().to_numpy())
        joined = n[:, None] + n[None, :] - shared
        i, j = np.nonzero(np.triu(shared / joined > above, 1))
        apart = reps[i] < reps[j]
        i, j = i[apart], j[apart]
        left, right = table.select([*group, "rep", "copies"]).take(pa.array(i)), table.take(pa.array(j))
        columns = [left[g] for g in group] + [left["rep"], right["rep"], left["copies"], right["copies"]]
        columns += [pa.array(x[i, j], pa.int32()) for x in (shared, joined)]
        return pa.Table.from_arrays(columns, [*group, "left_rep", "right_rep", "left_copies", "right_copies", "shared", "joined"])

    # The work is CPU, not bytes: a named number of parts is not merged by adaptive execution.
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = sets.select(*group, "rep", "copies", "n", "hs").repartition(parts, *group)
    return rows.groupBy(*group).applyInArrow(run, schema)


def _indexed_pairs(sets: DataFrame, group: list[str], above: float) -> DataFrame:
    tokens = sets.select(*group, "rep", "copies", "n", F.explode("hs").alias("h"))
    usage = tokens.groupBy(*group, "h").agg(F.count("*").alias("users")).where("users > 1")
    # Tokens of a single set cannot make a pair: they only take the first prefix places.
    ranked = (
        tokens.join(usage, [*group, "h"])
        .groupBy(*group, "rep", "copies", "n")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("users", "h"))), lambda x: x["h"]).alias("hs"))
        .withColumn("alone", F.col("n") - F.size("hs"))
    )
    prefix_len = F.col("n") - F.ceil(F.col("n") * above - _EPS) + 1
    open_places = F.greatest(prefix_len - F.col("alone"), F.lit(0)).cast("int")
    index = ranked.select(
        *group, "rep", "n", "alone", F.posexplode(F.slice("hs", 1, open_places)).alias("at", "h")
    ).select(*group, "rep", "n", (F.col("alone") + F.col("at")).alias("at"), "h")
    a, b = index.alias("a"), index.alias("b")
    same = F.col("a.h") == F.col("b.h")
    for g in group:
        same = same & (F.col(f"a.{g}") == F.col(f"b.{g}"))
    needed = F.ceil((F.col("a.n") + F.col("b.n")) * (above / (1 + above)) - _EPS)
    possible = 1 + F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at")) - 1
    candidates = (
        a.join(
            b,
            same
            & (F.col("a.rep") < F.col("b.rep"))
            & (F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * above - _EPS)
            & (possible >= needed),
        )
        .select(
            *[F.col(f"a.{g}").alias(g) for g in group],
            F.col("a.rep").alias("left_rep"), F.col("b.rep").alias("right_rep"),
        )
        .distinct()
    )
    side = ranked.select(*group, "rep", "copies", "n", "hs")
    left = side.withColumnsRenamed({"rep": "left_rep", "copies": "left_copies", "n": "left_n", "hs": "left_hs"})
    right = side.withColumnsRenamed({"rep": "right_rep", "copies": "right_copies", "n": "right_n", "hs": "right_hs"})
    met = candidates.join(left, [*group, "left_rep"]).join(right, [*group, "right_rep"])
    shared = F.size(F.array_intersect("left_hs", "right_hs"))
    return (
        met.withColumn("shared", shared)
        .withColumn("joined", F.col("left_n") + F.col("right_n") - F.col("shared"))
        .where(F.col("shared") / F.col("joined") > above)
        .select(*group, "left_rep", "right_rep", "left_copies", "right_copies", "shared", "joined")
    )


def jaccard_pair_counts(df: DataFrame, group: list[str], row_id: str, elements: Column, above: float) -> DataFrame:
    """Number of row pairs per group with Jaccard above the limit, copies included."""
    sets = cut_lineage(weighted_sets(df, group, row_id, elements))
    found = _pairs_of(sets, group, above)
    across = found.select(*group, (F.col("left_copies") * F.col("right_copies")).alias("pairs"))
    own = sets.select(*group, (F.col("copies") * (F.col("copies") - 1) / 2).cast("bigint").alias("pairs"))
    return across.unionByName(own).groupBy(*group).agg(F.sum("pairs").alias("pairs"))


def overlap_pair_counts(df: DataFrame, group: list[str], elements: Column, at_least: float) -> DataFrame:
    """Row pairs per group whose overlap coefficient reaches the limit.

    Works on distinct sets weighted by their copies and meets them through shared
    elements, so its cost follows the number of different sets, not of rows.
    """
    sets = (
        df.select(*group, F.sort_array(F.array_distinct(elements)).alias("elements"))
        .where(F.size("elements") > 0)
        .groupBy(*group, "elements")
        .agg(F.count("*").alias("m"))
        .withColumn("key", F.array_join("elements", "\u001f"))
    )
    index = sets.select(
        *group, "key", "m", F.size("elements").alias("n"), F.explode("elements").alias("e")
    )
    a, b = index.alias("a"), index.alias("b")
    same = (F.col("a.e") == F.col("b.e")) & (F.col("a.key") < F.col("b.key"))
    for g in group:
        same = same & (F.col(f"a.{g}") == F.col(f"b.{g}"))
    across = (
        a.join(b, same)
        .groupBy(*[F.col(f"a.{g}").alias(g) for g in group], F.col("a.key"), F.col("b.key"))
        .agg(
            (F.count("*") / F.least(F.first("a.n"), F.first("b.n"))).alias("share"),
            (F.first("a.m") * F.first("b.m")).alias("pairs"),
        )
        .where(F.col("share") >= at_least)
        .select(*group, "pairs")
    )
    own = sets.select(*group, (F.col("m") * (F.col("m") - 1) / 2).cast("bigint").alias("pairs"))
    return across.unionByName(own).groupBy(*group).agg(F.sum("pairs").alias("pairs"))
