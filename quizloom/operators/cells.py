"""Stored cell index of a vector table: exact nearest neighbours that read few cells.

Rows are dealt to cells by the nearest of some centroids and stored by cell. A small table tells of each cell
its centroid, its radius (no row is farther from the centroid) and, for each filter column, a bitmap of the hashed values that
occur. A filter skips cells without its values. A query first reads the most promising cells that hold enough rows; its k-th score there
then skips every cell whose bound, centroid score plus radius times length of the query, lies below.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import kernels as K
from ..session import scratch_path
from . import vector as V
from .ordered import first_n

#: Most cells of an index; their centroids go to every task.
MOST_CELLS = 1024
#: Rows a cell should hold on average, as long as there are no more than ``MOST_CELLS``.
CELL_ROWS = 1000
#: Rows of a stored part of a cell (expected number), so that a cell with a third of all rows is many tasks.
PART_ROWS = 1_000_000
#: Bits of a filter bitmap, as words of 64.
FILTER_WORDS = 4
#: (query, cell) pairs whose bounds the driver holds at once.
MOST_PAIRS = 1 << 24
#: Rows that meet the centroids, and queries that meet a cell's rows, at once in a task.
_PLACED_ROWS, _SCORED_QUERIES = 512, 64


def _bit(value: Column) -> Column:
    return F.pmod(F.xxhash64(value.cast("string")), F.lit(64 * FILTER_WORDS))


def _bitmap(name: str) -> list[Column]:
    """The words of the bitmap of a column's values."""
    at = _bit(F.col(name))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(at, F.lit(64)).cast("int"))
    return [F.bit_or(F.when(F.floor(at / 64) == w, bit).otherwise(F.lit(0).cast("bigint"))).alias(f"{name}_{w}") for w in range(FILTER_WORDS)]


@dataclass
class CellIndex:
    """An index below ``path`` with its cell table, at most ``MOST_CELLS`` rows: centroids, radii, sizes, bitmaps."""

    spark: SparkSession
    path: str
    filters: list[str]
    schema: StructType
    cells: pd.DataFrame

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")


def build(corpus: DataFrame, filters: list[str], path: str | None = None) -> CellIndex:
    """Index ``corpus`` (``id``, ``vec`` and other columns) below ``path`` (a new folder of the shared one if none is named).

    Centroids are rows drawn by a hash of the id. Rows without a vector are left out.
    """
    spark = corpus.sparkSession
    path = path or scratch_path(spark, "cells")
    rows = corpus.where("vec IS NOT NULL")
    n = rows.count()
    many = int(min(MOST_CELLS, max(1, n // CELL_ROWS)))
    # About four times as many rows as needed are drawn before the sort, so it stays small.
    drawn = rows.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 20)) < F.lit(max(1, int((1 << 20) * min(1.0, 4 * many / max(1, n)))))) if n > 4 * many else rows
    picks = drawn.select("vec", F.xxhash64("id", F.lit(7)).alias("h")).orderBy("h").limit(many).toPandas()
    centroids = K.matrix(picks["vec"]) if len(picks) else np.zeros((1, 1))
    sent = spark.sparkContext.broadcast(centroids)

    @F.pandas_udf("cell int, far double")
    def place(vectors: pd.Series) -> pd.DataFrame:
        if not len(vectors):
            return pd.DataFrame({"cell": pd.Series(dtype="int32"), "far": pd.Series(dtype="float64")})
        x, c = K.matrix(vectors), sent.value
        long = (c * c).sum(1)
        # A few rows at a time: a whole batch against all centroids would be large.
        near = np.concatenate([(2 * x[i : i + _PLACED_ROWS] @ c.T - long).argmax(1) for i in range(0, len(x), _PLACED_ROWS)])
        return pd.DataFrame({"cell": near.astype("int32"), "far": np.sqrt(((x - c[near]) ** 2).sum(1))})

    parts = max(1, n // PART_ROWS)
    placed = rows.withColumn("_p", place("vec")).select("*", "_p.cell", "_p.far").drop("_p")
    dealt = placed.repartition(F.col("cell"), F.pmod(F.xxhash64("id"), F.lit(parts)))
    # Rows of a filter value stand together, so a pushed filter also skips parts of a cell's files.
    dealt.sortWithinPartitions("cell", *filters, "id").write.partitionBy("cell").parquet(f"{path}/rows")
    stored = spark.read.schema(placed.schema).parquet(f"{path}/rows")
    about = stored.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"), *[b for name in filters for b in _bitmap(name)]).toPandas()
    about["centroid"] = [centroids[c] for c in about["cell"]]
    return CellIndex(spark, path, filters, placed.schema, about.sort_values("cell", ignore_index=True))


def _bits_of(spark: SparkSession, values: list) -> dict:
    """Bit of each value, by the same expression that made the bitmaps."""
    distinct = list(dict.fromkeys(values))
    if not distinct:
        return {}
    row = spark.range(1).select(*[_bit(F.lit(v)).alias(f"v{i}") for i, v in enumerate(distinct)]).first()
    return dict(zip(distinct, row))


def _has(cells: pd.DataFrame, name: str, bit: int) -> np.ndarray:
    word = cells[f"{name}_{bit // 64}"].to_numpy(np.int64).view(np.uint64)
    return (word >> np.uint64(bit % 64)) & np.uint64(1) == 1


def _best_of_cells(
    batches: Iterator[pd.DataFrame], asked: pd.DataFrame, vectors: np.ndarray, cells: np.ndarray, wanted: np.ndarray, k: int, block: list[str]
) -> Iterator[pd.DataFrame]:
    """Task: the ``k`` best rows of its batches for every query (``left_id``, ``right_id``, ``score``), from the cells wanted
    for it. A query's vector and its best rows are held once, however many cells it reads."""
    column = {int(c): i for i, c in enumerate(cells)}
    qid = asked["query_id"].to_numpy()
    alike = {v if isinstance(v, tuple) else (v,): at for v, at in asked.groupby(block, sort=False).indices.items()} if block else {}
    best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for pdf in batches:
        cm, cid = K.matrix(pdf["vec"]), pdf["id"].to_numpy()
        for value, mine in pdf.reset_index(drop=True).groupby(["cell", *block], sort=False).indices.items():
            cell, *same = value if isinstance(value, tuple) else (value,)
            of = wanted[:, column[int(cell)]]
            at = np.nonzero(of)[0] if not block else (lambda n: n[of[n]])(alike.get(tuple(same), np.empty(0, int)))
            for start in range(0, len(at), _SCORED_QUERIES):
                some = at[start : start + _SCORED_QUERIES]
                scores = np.round(vectors[some] @ cm[mine].T, 6)
                for row, n in enumerate(some):
                    old = best.get(n)
                    sc = scores[row] if old is None else np.concatenate([old[0], scores[row]])
                    ids = cid[mine] if old is None else np.concatenate([old[1], cid[mine]])
                    keep = K.best_rows(sc, ids, k)
                    best[n] = (sc[keep], ids[keep])
    for n, (sc, ids) in best.items():
        yield pd.DataFrame({"left_id": [qid[n]] * len(sc), "right_id": ids, "score": sc})


def _read(index: CellIndex, asked: pd.DataFrame, wanted: np.ndarray, k: int, block: list[str], conditions: dict, schema: str) -> DataFrame:
    """Best ``k`` rows of each query in the cells ``wanted`` (query, cell) for it: only those cells' files are read."""
    places = np.nonzero(wanted.any(0))[0]
    cells = index.cells["cell"].to_numpy()[places]
    kept = V.metadata_filter(index.rows.where(F.col("cell").isin([int(c) for c in cells])), **conditions)
    names = asked[[*block, "query_id"]].reset_index(drop=True)
    sent = index.spark.sparkContext.broadcast((names, K.matrix(asked["vec"]), cells, wanted[:, places]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _best_of_cells(batches, *sent.value, k, block)

    return kept.select(*block, "cell", "id", "vec").mapInPandas(run, schema)


def search(index: CellIndex, queries: DataFrame, k: int, block: list[str] | None = None, seen: dict | None = None, **conditions) -> DataFrame:
    """The ``k`` nearest indexed rows of every query: ``query_id``, ``id``, ``score``, ``rank``; the rows of ``vector.top_k``.

    ``block`` names filter columns that must be equal on both sides, ``conditions`` are those of ``vector.metadata_filter``; columns
    that the index has no bitmap for filter rows, not cells. Queries are measured first: ``V.SENT_QUERY_BYTES`` at most go to the
    tasks with their cells, larger batches (or ones of more than ``MOST_PAIRS``) are answered by ``vector.top_k`` without the index. ``seen`` receives the numbers of cells and of
    (query, cell) pairs, in all and read.
    """
    block, spark = block or [], index.spark
    size = queries.agg(F.sum(8 * F.size("vec") + 64).alias("n"), F.count("*").alias("many")).first()
    if (size.n or 0) > V.SENT_QUERY_BYTES or size.many * len(index.cells) > MOST_PAIRS:
        return V.top_k(V.metadata_filter(index.rows, **conditions), queries, k, block)
    asked = queries.select(*block, "query_id", "vec").where("vec IS NOT NULL").toPandas()
    schema = f"left_id {queries.schema['query_id'].dataType.simpleString()}, right_id {index.rows.schema['id'].dataType.simpleString()}, score double"
    none = spark.createDataFrame([], "query_id {}, id {}, score double, rank int".format(*[p.split(" ")[1] for p in schema.split(", ")[:2]]))
    cells = index.cells
    if not len(asked) or not len(cells):
        return none
    passes = np.ones(len(cells), bool)
    for name, value in conditions.items():
        if value is not None and name in index.filters:
            many = list(value) if isinstance(value, (list, tuple, set)) else [value]
            bits = _bits_of(spark, many)
            passes &= np.logical_or.reduce([_has(cells, name, b) for b in bits.values()] or [np.zeros(len(cells), bool)])
    q = K.matrix(asked["vec"])
    bound = q @ K.matrix(cells["centroid"]).T + np.linalg.norm(q, axis=1)[:, None] * cells["radius"].to_numpy() + 2e-6
    open_pairs = np.broadcast_to(passes, bound.shape).copy()
    for name in block:
        if name in index.filters:
            bits = _bits_of(spark, asked[name].tolist())
            has = {v: _has(cells, name, b) for v, b in bits.items()}
            open_pairs &= np.stack([has[v] for v in asked[name]])
    bound[~open_pairs] = -np.inf
    # First the most promising cells that hold k rows together, whatever their filters leave of them.
    order = np.argsort(-bound, axis=1, kind="stable")
    before = np.cumsum(cells["n"].to_numpy()[order], axis=1) - cells["n"].to_numpy()[order]
    first = np.zeros_like(open_pairs)
    np.put_along_axis(first, order, before < k, axis=1)
    first &= open_pairs

    found = first_n(_read(index, asked, first, k, block, conditions, schema), ["left_id"], [F.desc("score"), F.asc("right_id")], k, "rank").toPandas()
    full = found[found["rank"] == k].groupby("left_id")["score"].max()
    least = asked["query_id"].map(full).fillna(-np.inf).to_numpy(float)
    rest = open_pairs & ~first & (bound >= least[:, None])
    if seen is not None:
        seen.update(cells=len(cells), cells_read=int((first | rest).any(0).sum()), pairs=bound.size, pairs_read=int((first | rest).sum()))
    partial = spark.createDataFrame(found[["left_id", "right_id", "score"]], schema) if len(found) else none.toDF("left_id", "right_id", "score", "rank").drop("rank")
    if rest.any():
        partial = partial.unionByName(_read(index, asked, rest, k, block, conditions, schema))
    ranked = first_n(partial, ["left_id"], [F.desc("score"), F.asc("right_id")], k, "rank")
    return ranked.select(F.col("left_id").alias("query_id"), F.col("right_id").alias("id"), "score", "rank")
