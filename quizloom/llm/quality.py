"""Quality classifier by co-training.

Two logistic regressions see one document each their own way: the text (shape of its words, signs
and repeats) and the page's metadata (source, language, length). Over some rounds each labels the
rows of the unlabelled pool it is sure of for the other. Both are then calibrated on labelled rows
that neither was fitted to, and their calibrated odds are combined to score every document.
"""

from __future__ import annotations

import operator
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_kept_in_worker

#: Labelled documents that the classifier is fitted on, and documents of the unlabelled pool (expected
#: numbers: rows are taken by a hash of their id; all of them, if there are fewer).
LABELLED_ROWS, POOL_ROWS = 15_000, 15_000
ROUNDS = 3
#: A view hands on labels it gives at least this probability.
SURE = 0.97
KEEP_FROM = 0.5

_SIGNS = "#$%&*|<>{}[]=+~^_\\/@"
_SOURCES = 64


def text_view(text: str | None) -> list[float]:
    """Shape of a whole text; a null, empty or blank one is all zeros."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return [0.0] * 11
    chars = len(text)
    counted = Counter(words)
    signs = sum(map(text.count, _SIGNS))
    return [
        1.0,
        np.log1p(n),
        len(counted) / n,
        (max(counted.values()) - 1) / n,
        sum(map(operator.eq, words, words[1:])) / n,
        signs / chars,
        min(1.0, signs / n),
        min(2.0, text.count("|") / n),
        sum(map(text.count, "0123456789")) / chars,
        sum(map(text.count, ".!?")) / n,
        min(3.0, chars / n / 10),
    ]


def meta_view(source: str | None, lang: str | None, n_chars: int | None) -> list[float]:
    out = [0.0] * (_SOURCES + 8 + 2)
    if source is not None:
        out[zlib.crc32(source.encode()) % _SOURCES] = 1.0
    if lang is not None:
        out[_SOURCES + zlib.crc32(lang.encode()) % 8] = 1.0
    out[-2] = 1.0
    out[-1] = np.log1p(max(0, n_chars or 0)) / 10
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps with a small penalty."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = _sigmoid(x @ w)
        grad = x.T @ (p - y) + penalty * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    text: np.ndarray
    meta: np.ndarray
    platt: tuple[np.ndarray, np.ndarray]
    prior: float

    def score(self, xt: np.ndarray, xm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probability of each view, and of both together."""
        odds = []
        for x, w, (slope, base) in ((xt, self.text, self.platt[0]), (xm, self.meta, self.platt[1])):
            odds.append(slope * (x @ w) + base)
        return _sigmoid(odds[0]), _sigmoid(odds[1]), _sigmoid(odds[0] + odds[1] - self.prior)


def fit(xt: np.ndarray, xm: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> Model:
    """``y`` is 1, 0 or -1 (no label). Every fourth labelled row only calibrates."""
    labelled = np.flatnonzero(y >= 0)
    if not len(labelled) or len(set(y[labelled].tolist())) < 2:
        base = 10.0 if not len(labelled) or y[labelled[0]] == 1 else -10.0
        none = (np.zeros(xt.shape[1]), np.zeros(xm.shape[1]))
        return Model(*none, (np.array([0.0, base]), np.array([0.0, base])), base)
    check, train = labelled[::4], np.setdiff1d(labelled, labelled[::4])
    pool = np.flatnonzero(y < 0)
    views = (xt, xm)
    given = [dict(), dict()]  # labels that a view got from the other

    def fitted(v):
        rows = np.concatenate((train, np.array(list(given[v]), int)))
        return _fit(views[v][rows], np.concatenate((y[train], np.array(list(given[v].values()), float))))

    weights = [fitted(0), fitted(1)]
    for _ in range(rounds):
        for v in (0, 1):
            p = _sigmoid(views[v][pool] @ weights[v])
            sure = (p >= SURE) | (p <= 1 - SURE)
            given[1 - v].update(zip(pool[sure].tolist(), (p[sure] > 0.5).astype(float).tolist()))
        weights = [fitted(0), fitted(1)]
    platt = []
    for v in (0, 1):
        margin = views[v][check] @ weights[v]
        platt.append(_fit(np.stack((margin, np.ones(len(check))), 1), y[check], 0.01))
    share = (y[labelled].sum() + 0.5) / (len(labelled) + 1)
    return Model(*weights, tuple(platt), float(np.log(share / (1 - share))))


def train(df: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> Model:
    """Fit on a bounded sample of ``df`` (doc_id, text, source, lang, n_chars): labelled rows drawn from
    the labels, however few documents have one, and a pool drawn from all documents. Labels without an
    id or a quality are left out, of several labels of a document the lowest counts."""

    def drawn(share: float, seed: int):
        return F.pmod(F.xxhash64("_label_id", F.lit(seed)), F.lit(1 << 20)) < share * (1 << 20)

    marks = labels.where("doc_id is not null and quality is not null")
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("_label_id")).agg(F.min("quality").cast("int").alias("_quality"))
    marks = marks.where(drawn(min(1.0, LABELLED_ROWS / max(1, marks.count())), 1))
    rows = df.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("_label_id"), "text", "source", "lang", "n_chars")
    # The drawn labels are about LABELLED_ROWS rows of two numbers, so they may go to every task.
    rows = rows.join(F.broadcast(marks), "_label_id", "left")
    pool = drawn(min(1.0, POOL_ROWS / max(1, df.count())), 2)
    rows = rows.where(F.col("_quality").isNotNull() | pool).withColumn("_quality", F.coalesce("_quality", F.lit(-1)))

    def views(batches):
        drop_kept_in_worker()
        for b in batches:
            yield pd.DataFrame(
                {
                    "_label_id": b["_label_id"],
                    "t": [text_view(x) for x in b["text"]],
                    "m": [meta_view(s, v, None if pd.isna(n) else int(n)) for s, v, n in zip(b["source"], b["lang"], b["n_chars"])],
                    "y": b["_quality"],
                }
            )

    seen = rows.mapInPandas(views, "_label_id long, t array<double>, m array<double>, y int")
    got = sorted(seen.collect(), key=lambda r: (r[0], r.t))
    if not got:
        got = [(None, text_view(None), meta_view(None, None, None), -1)]
    return fit(np.array([r[1] for r in got]), np.array([r[2] for r in got]), np.array([r[3] for r in got]), rounds)


def score(df: DataFrame, model: Model) -> DataFrame:
    """Add ``p_text``, ``p_meta`` and ``score``, each the probability of good quality.

    A null, empty or blank text scores 0 whatever its metadata; nulls in other columns count as
    unknown. Columns of ``df`` with these names are replaced.
    """

    @F.pandas_udf("p_text double, p_meta double, score double")
    def both(text: pd.Series, source: pd.Series, lang: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
        drop_kept_in_worker()
        xt = np.array([text_view(t) for t in text]).reshape(len(text), -1)
        xm = np.array([meta_view(s, v, None if pd.isna(n) else int(n)) for s, v, n in zip(source, lang, n_chars)]).reshape(len(text), -1)
        pt, pm, p = model.score(xt, xm)
        blank = xt[:, 0] == 0
        return pd.DataFrame({"p_text": np.where(blank, 0.0, pt), "p_meta": pm, "score": np.where(blank, 0.0, p)})

    named = df.drop("p_text", "p_meta", "score")
    scored = named.withColumn("_both", both("text", "source", "lang", F.col("n_chars").cast("long")))
    return scored.select(*named.columns, "_both.*")


def classify(df: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, p_text, p_meta, score, quality`` of every row of ``df``."""
    rows = df.select(F.col("doc_id").cast("long"), "text", "source", "lang", "n_chars")
    out = score(rows, train(rows, labels))
    return out.select("doc_id", "p_text", "p_meta", "score", (F.col("score") >= KEEP_FROM).cast("int").alias("quality"))
