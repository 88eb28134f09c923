"""Vector tables: nearest neighbours with metadata filters, re-ranking, namespaces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import text as X
from .ordered import first_n
from .tiles import matches_across

CANDIDATES = 20
#: A query batch is sent to the corpus up to this many bytes of vectors.
SENT_QUERY_BYTES = 64 * 2**20
DEFAULT_TOP_K = 8
RELEVANCE_WEIGHT = 0.6


def dot(a: Column, b: Column) -> Column:
    """Dot product in double; for unit vectors this is the cosine."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def vector_key(v: Column) -> Column:
    return F.sha2(F.array_join(v.cast("array<string>"), ","), 256)


def metadata_filter(corpus: DataFrame, **conditions) -> DataFrame:
    """``name=value`` or ``name=[values]``, applied before any scoring, so it reaches the scan."""
    for name, value in conditions.items():
        if value is not None:
            many = list(value) if isinstance(value, (list, tuple, set)) else [value]
            corpus = corpus.where(F.col(name).isin(many) if len(many) > 1 else F.col(name) == many[0])
    return corpus


def scan_best(batches: Iterator[pd.DataFrame], q: pd.DataFrame, k: int, block: list[str]) -> Iterator[pd.DataFrame]:
    """Task: the ``k`` best rows of its batches for every query of the same block (``left_id``, ``right_id``, ``score``)."""
    qm = K.matrix(q["vec"]) if len(q) else np.zeros((0, 0))
    qid = q["query_id"].to_numpy()
    best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def groups(df: pd.DataFrame) -> dict[tuple, np.ndarray]:
        """Places of the rows of each block; a batch is grouped once, however many blocks are asked for."""
        if not block:
            return {(): np.arange(len(df))}
        found = df[block].reset_index(drop=True).groupby(block, sort=False).indices
        return {v if isinstance(v, tuple) else (v,): at for v, at in found.items()}

    asked = groups(q)
    for pdf in batches:
        if not len(pdf) or not len(q):
            continue
        cm, cid = K.matrix(pdf["vec"]), pdf["id"].to_numpy()
        for value, mine in groups(pdf).items():
            at = asked.get(value)
            if at is None:
                continue
            s = np.round(qm[at] @ cm[mine].T, 6)
            for row, n in enumerate(at):
                old = best.get(n)
                sc = s[row] if old is None else np.concatenate([old[0], s[row]])
                ids = cid[mine] if old is None else np.concatenate([old[1], cid[mine]])
                keep = K.best_rows(sc, ids, k)
                best[n] = (sc[keep], ids[keep])
    for n, (sc, ids) in best.items():
        yield pd.DataFrame({"left_id": [qid[n]] * len(sc), "right_id": ids, "score": sc})


def _scan_top_k(corpus: DataFrame, queries: DataFrame, k: int, block: list[str]) -> DataFrame:
    """Few queries: they travel to the corpus, which is scanned once and not shuffled."""
    local = queries.select(*block, "query_id", "vec").toPandas()
    sent = corpus.sparkSession.sparkContext.broadcast(local)
    schema = ", ".join(
        [f"left_id {queries.schema['query_id'].dataType.simpleString()}",
         f"right_id {corpus.schema['id'].dataType.simpleString()}", "score double"]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from scan_best(batches, sent.value, k, block)

    return corpus.select(*block, "id", "vec").mapInPandas(run, schema)


def top_k(corpus: DataFrame, queries: DataFrame, k: int, block: list[str] | None = None) -> DataFrame:
    """The ``k`` nearest corpus rows of every query: ``query_id``, ``id``, ``score``, ``rank``.

    ``corpus`` has ``id`` and ``vec``, ``queries`` has ``query_id`` and ``vec``; ``block``
    names columns that must be equal on both sides. The size of the query batch is
    checked in bytes: a small one is sent to the corpus, a large one meets it tile by tile, with
    the same result.
    """
    block = block or []
    size = queries.agg(F.sum(8 * F.size("vec") + 64)).first()[0] or 0
    if size <= SENT_QUERY_BYTES:
        partial = _scan_top_k(corpus, queries, k, block)
    else:
        keys = block or ["_all"]
        if not block:
            corpus, queries = corpus.withColumn("_all", F.lit(0)), queries.withColumn("_all", F.lit(0))
        partial = matches_across(queries, corpus, keys, "query_id", "id", ["vec"], K.nearest(k)).select(
            "left_id", "right_id", "score"
        )
    ranked = first_n(partial, ["left_id"], [F.desc("score"), F.asc("right_id")], k, "rank")
    return ranked.select(F.col("left_id").alias("query_id"), F.col("right_id").alias("id"), "score", "rank")


def _overlap(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def diversify(candidates: DataFrame, k: int = DEFAULT_TOP_K, weight: float = RELEVANCE_WEIGHT) -> DataFrame:
    """Maximal marginal relevance per query over its candidates.

    Needs ``query_id``, ``id``, ``score``, ``rank``, ``text``; bigram sets are made on
    the JVM side, and a group holds the candidates of one query.
    """
    pool = candidates.select("query_id", "id", "score", "rank", X.bigrams(F.col("text")).alias("pairs"))
    q_type = candidates.schema["query_id"].dataType.simpleString()
    i_type = candidates.schema["id"].dataType.simpleString()

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank").reset_index(drop=True)
        if len(pdf) <= k:
            return pd.DataFrame(
                {"query_id": pdf["query_id"], "id": pdf["id"], "score": pdf["score"],
                 "mmr_score": pdf["score"], "place": np.arange(1, len(pdf) + 1)}
            )
        sets = [set(p) for p in pdf["pairs"]]
        worst = np.zeros(len(pdf))
        open_rows = list(range(len(pdf)))
        chosen, values = [], []
        for _ in range(k):
            gain = [weight * pdf["score"].iat[r] - (1 - weight) * worst[r] for r in open_rows]
            n = int(np.argmax(gain))
            r = open_rows.pop(n)
            chosen.append(r)
            values.append(round(gain[n], 6))
            for o in open_rows:
                worst[o] = max(worst[o], _overlap(sets[o], sets[r]))
        out = pdf.iloc[chosen]
        return pd.DataFrame(
            {"query_id": out["query_id"].to_numpy(), "id": out["id"].to_numpy(), "score": out["score"].to_numpy(),
             "mmr_score": values, "place": np.arange(1, k + 1)}
        )

    return pool.groupBy("query_id").applyInPandas(
        pick, f"query_id {q_type}, id {i_type}, score double, mmr_score double, place int"
    )


def retrieve(
    corpus: DataFrame, queries: DataFrame, k: int = DEFAULT_TOP_K, block: list[str] | None = None, candidates: int = CANDIDATES
) -> DataFrame:
    """Filtered nearest neighbours, then re-ranking, for all queries in one job."""
    if k > candidates:
        raise ValueError(f"{k} passages cannot be chosen from {candidates} candidates")
    near = top_k(corpus, queries, candidates, block)
    return diversify(near.join(corpus.select("id", "text"), "id"), k)


def upsert(store: DataFrame, incoming: DataFrame, batch_order: str = "batch_no") -> DataFrame:
    """Incoming vectors replace stored ones of the same namespace and id; the last batch wins."""
    newest = last_versions(incoming, batch_order).drop(batch_order)
    kept = store.join(newest.select("namespace", "id"), ["namespace", "id"], "left_anti")
    return kept.unionByName(newest)


def drop_namespace(store: DataFrame, namespace: str) -> DataFrame:
    return store.where(F.col("namespace") != namespace)


def describe(store: DataFrame) -> DataFrame:
    return store.groupBy("namespace").agg(F.count("*").alias("vectors"))


def ingest_plan(chunks: DataFrame) -> DataFrame:
    """What an ingest would write: chunks and distinct slugs per chapter."""
    cells = chunks.groupBy("chapter_id", "topic_slug").agg(F.count("*").alias("c"))
    return cells.groupBy("chapter_id").agg(F.sum("c").alias("chunks"), F.count("*").alias("slugs"))


def best_per_key(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Highest score per key, smallest id on ties; one aggregation with map-side combine."""
    best = scored.groupBy(*keys).agg(F.max(F.struct("score", (-F.col("id")).alias("neg"))).alias("b"))
    return best.select(*keys, (-F.col("b.neg")).alias("id"), F.col("b.score").alias("score"))


def distractor_scores(bank: DataFrame, vectors: DataFrame, fixed_types: list[str]) -> DataFrame:
    """Cosine of every wrong option with the answer, for types whose options are free.

    ``vectors`` maps ``text`` to ``vec``. Similarities are computed once per distinct
    (answer, option) pair.
    """
    wrong = (
        bank.where(~F.col("question_type").isin(fixed_types))
        .select("id", "correct_answer", F.posexplode("options").alias("place", "option"))
        .where(F.col("option") != F.col("correct_answer"))
    )
    pairs = wrong.select("correct_answer", "option").distinct()
    known = pairs.join(
        vectors.select(F.col("text").alias("correct_answer"), F.col("vec").alias("va")), "correct_answer"
    ).join(vectors.select(F.col("text").alias("option"), F.col("vec").alias("vb")), "option")
    sims = known.select("correct_answer", "option", F.round(dot(F.col("va"), F.col("vb")), 4).alias("sim"))
    return wrong.join(sims, ["correct_answer", "option"], "left")


def distractor_reason(scores: DataFrame, low: float = 0.30, high: float = 0.97) -> DataFrame:
    """First wrong option, by place, that is too far from the answer or too close to it."""
    what = F.when(F.col("sim") < low, "distant").when(F.col("sim") > high, "too_close")
    bad = F.when(what.isNotNull(), F.struct("place", what.alias("what")))
    return scores.groupBy("id").agg(F.min(bad).alias("m")).select(
        "id", F.when(F.col("m").isNotNull(), F.concat(F.lit("option_"), (F.col("m.place") + 1).cast("string"), F.lit("_"), F.col("m.what"))).alias("reason")
    )


def last_versions(rows: DataFrame, order: str = "version") -> DataFrame:
    """One row per (namespace, id): the last by ``order``; among equals a hash of the row decides,
    so a repeat gives the same row again."""
    whole = F.struct(*rows.columns)
    last = rows.groupBy("namespace", "id").agg(F.max_by(whole, F.struct(F.col(order), F.xxhash64(*rows.columns))).alias("r"))
    return last.select("r.*")
