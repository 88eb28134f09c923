"""Exact top-k search by inner product with M-trees.

Integer vectors get one more component that gives all the same length; the larger the inner
product, the smaller then the distance. Rows are dealt to the cells of a bounded number of pivots,
large cells are cut into pages, and every page is an M-tree: nodes hold routing vectors, covering
radii and distances to the parent. A search takes the nearest node first and skips nodes and rows,
often before computing their distance, by the triangle inequality. Each query first searches its
own cell; the score of its k-th hit there bounds the search of all other pages.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Rows of a page, queries of a block, and the largest number of pivots.
PAGE, QUERIES, PIVOTS = 4096, 1024, 1024
_LEAF = 512
_EXACT = 2.0**50
_NONE = -(2**63)


def usable(vector: str, scale: int) -> list:
    """Filter and value of the integer vectors: null vectors and those with a null or non-finite
    component take no part."""
    ok = F.col(vector).isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))
    )
    return [ok, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))]


class MTree:
    """Metric tree over the rows of ``x`` (integers); ``norm2`` is the common squared length."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, norm2: float):
        self.ids, self.x, self.norm2 = ids, x, norm2
        self.lift = np.sqrt(np.maximum(0.0, norm2 - (x * x).sum(1)))
        self.root = self._node(np.arange(len(x)), None)

    def _distance(self, rows: np.ndarray, centre: int) -> np.ndarray:
        d = self.x[rows] - self.x[centre]
        return np.sqrt((d * d).sum(1) + (self.lift[rows] - self.lift[centre]) ** 2)

    def _node(self, rows: np.ndarray, parent: int | None):
        """(vectors, their ids in a leaf, their distances to the parent, radii, children)."""
        away = self._distance(rows, parent) if parent is not None else np.zeros(len(rows))
        if len(rows) <= _LEAF:
            return self.x[rows], self.ids[rows], away, None, None
        centres = rows[np.linspace(0, len(rows) - 1, min(32, -(-len(rows) // _LEAF) * 2)).astype(int)]
        near = np.stack([self._distance(rows, c) for c in centres])
        own = near.argmin(0)
        groups = [(c, rows[own == i], near[i][own == i]) for i, c in enumerate(centres)]
        groups = [g for g in groups if len(g[1])]
        if len(groups) == 1:  # equal rows: cut by number
            c, _, d = groups[0]
            groups = [(c, rows[i : i + _LEAF], d[i : i + _LEAF]) for i in range(0, len(rows), _LEAF)]
        routing = np.array([c for c, _, _ in groups])
        radii = np.array([d.max() for _, _, d in groups])
        away = self._distance(routing, parent) if parent is not None else np.zeros(len(routing))
        return self.x[routing], None, away, radii, [self._node(r, c) for c, r, _ in groups]

    def search(self, q: np.ndarray, own: int, k: int, least: int) -> list[tuple[int, int]]:
        """Up to ``k`` best (-score, id) with a score of ``least`` or more, ``own`` id left out."""
        qq = float((q * q).sum())
        total = qq + self.norm2
        best: list[tuple[int, int]] = []  # a heap with the worst on top: (score, -id)
        reach = np.inf if least == _NONE else np.sqrt(max(0.0, total - 2.0 * least)) + 1e-6

        def limit() -> float:
            if len(best) < k:
                return reach
            return min(reach, np.sqrt(max(0.0, total - 2.0 * best[0][0])) + 1e-6)

        todo, n = [(0.0, 0, self.root, None)], 0
        while todo:
            low, _, (vectors, ids, away, radii, children), at = heapq.heappop(todo)
            now = limit()
            if low > now:
                break
            room = now if radii is None else now + radii
            live = None if at is None else np.flatnonzero(np.abs(at - away) <= room)
            if live is None or len(live) == len(away):
                live = np.arange(len(away))
                dots = vectors @ q
            elif len(live):
                dots = vectors[live] @ q
            else:
                continue
            if ids is not None:
                floor = best[0][0] if len(best) == k else least
                for i in np.flatnonzero(dots >= floor).tolist():
                    found = int(ids[live[i]])
                    if found == own:
                        continue
                    hit = (int(dots[i]), -found)
                    if len(best) < k:
                        heapq.heappush(best, hit)
                    elif hit > best[0]:
                        heapq.heapreplace(best, hit)
                continue
            far = np.sqrt(np.maximum(0.0, total - 2.0 * dots))
            for i, d in zip(live.tolist(), far.tolist()):
                lower = max(0.0, d - radii[i] - 1e-6)
                if lower <= now:
                    n += 1
                    heapq.heappush(todo, (lower, n, children[i], d))
        return [(s, -i) for s, i in best]


def _plain(ids, x, q, own, k, least):
    """All rows compared one by one, where products may exceed what floating point holds exactly."""
    hits = [(sum(a * b for a, b in zip(v, q)), i) for i, v in zip(ids, x) if i != own]
    return sorted((h for h in hits if h[0] >= least), key=lambda h: (-h[0], h[1]))[:k]


def _search(norm2: float, k: int):
    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(queries):
            ids = rows["vec_id"].to_numpy()
            exact = norm2 < _EXACT
            x = np.stack(rows["v"].to_list()).astype(float) if exact else [list(map(int, v)) for v in rows["v"]]
            tree = MTree(ids, x, norm2) if exact else None
            for own, q, least in zip(queries["query_id"].tolist(), queries["v"], queries["least"].tolist()):
                found = (
                    tree.search(np.asarray(q, float), own, k, least)
                    if exact
                    else _plain(ids.tolist(), x, list(map(int, q)), own, k, least)
                )
                out += [(own, i, s) for s, i in found]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


def _cells(pivots: np.ndarray):
    """Task: the nearest pivot of each row and the squared distance to it."""

    def run(batches):
        for b in batches:
            if len(b):
                x = np.stack(b["v"].to_list()).astype(float).reshape(len(b), -1)
                far = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T
                b["cell"] = far.argmin(1)
                yield b[["vec_id", "v", "cell"]]

    return run


def _same_length(rows: DataFrame, every: int, k: int) -> DataFrame:
    """Top-k over vectors of one length."""
    n, norm2 = rows.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))).first()
    norm2 = float(norm2 or 0.0)
    count = max(1, min(PIVOTS, -(-n // PAGE)))
    pivots = np.array([r.v for r in rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(count).collect()], float)
    celled = saved(rows.mapInPandas(_cells(pivots), "vec_id long, v array<long>, cell int"), "cells")
    pages = celled.groupBy("cell").agg(F.ceil(F.count("*") / PAGE).alias("pages"))
    paged = celled.join(F.broadcast(pages), "cell").withColumn("page", F.pmod(F.xxhash64("vec_id", "v"), "pages"))
    asked = saved(celled.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v", "cell"), "queries")
    blocks = max(1, -(-asked.count() // QUERIES))
    block = F.pmod(F.xxhash64("query_id", F.lit(3)), F.lit(blocks)).cast("int").alias("block")

    def searched(asked: DataFrame, cells: str) -> DataFrame:
        """Hits of the queries in the pages of ``cells`` (expression giving an array of cells)."""
        to = asked.select("query_id", "v", "least", block, F.explode(F.expr(cells)).alias("cell"))
        to = to.join(F.broadcast(pages), "cell").withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pages") - 1)))
        met = to.select("cell", "page", F.col("block").alias("for_block")).distinct()
        pages_of = paged.join(met, ["cell", "page"]).select("cell", "page", "for_block", "vec_id", "v")
        return pages_of.groupBy("cell", "page", "for_block").cogroup(to.groupBy("cell", "page", "block")).applyInPandas(_search(norm2, k), "query_id long, vec_id long, score long")

    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    top = lambda hits: hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    home = saved(top(searched(asked.withColumn("least", F.lit(_NONE)), "array(cell)")), "home")
    bounds = home.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    bounded = asked.join(bounds, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(_NONE)))
    rest = searched(bounded, f"filter(sequence(0, {count - 1}), c -> c <> cell)")
    return top(home.drop("rank").unionByName(rest)).select("query_id", "rank", "vec_id", "score")


def top_k(df: DataFrame, every: int = 20, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest inner products of each query.

    A component x counts as floor(scale * x). Queries are the rows whose id is divisible by
    ``every``; candidates all rows with another id, of the same number of components. Ties go to
    the smaller id. Rows without an id and unusable vectors take no part; equal rows count once; a
    query without candidates has no row. Other columns of ``df`` are ignored.
    """
    ok, value = usable(vector_col, scale)
    rows = df.where(ok & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), value.alias("v"))
    rows = saved(rows.distinct(), "vectors")
    lengths = [r[0] for r in rows.select(F.size("v")).distinct().collect()]
    if not lengths:
        schema = "query_id long, rank int, vec_id long, score long"
        return df.sparkSession.createDataFrame([], schema)
    out = None
    for n in sorted(lengths):
        one = _same_length(rows.where(F.size("v") == n), every, k)
        out = one if out is None else out.unionByName(one)
    if len(lengths) > 1:
        best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        out = out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return out
