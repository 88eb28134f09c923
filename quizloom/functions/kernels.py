"""Small array helpers that run inside Spark tasks."""

from __future__ import annotations

from os.path import commonprefix

import numpy as np
import pandas as pd


def matrix(vectors) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.float64) for v in vectors], dtype=np.float64)


def cosine_at_least(limit: float, column: str = "vec"):
    """Pairs of unit vectors whose dot product reaches the limit."""

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        s = matrix(a[column]) @ matrix(b[column]).T
        i, j = np.nonzero(s >= limit)
        return pd.DataFrame({"i": i, "j": j, "score": s[i, j]})

    return compare


def best_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best: highest score at six digits, then smallest id."""
    if len(scores) > k:
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.nonzero(scores >= bar)[0]
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]


def nearest(k: int, column: str = "vec"):
    """The ``k`` best right rows of every left row."""

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        s = np.round(matrix(a[column]) @ matrix(b[column]).T, 6)
        ids = b["_id"].to_numpy()
        picks = [best_rows(s[r], ids, k) for r in range(len(a))]
        i = np.repeat(np.arange(len(a)), [len(p) for p in picks])
        j = np.concatenate(picks) if picks else np.empty(0, dtype="int64")
        return pd.DataFrame({"i": i, "j": j, "score": s[i, j]})

    return compare


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, one big-integer step per character."""
    if len(a) > len(b):
        a, b = b, a
    # A common start and end belong to it; near copies have little between.
    start = len(commonprefix((a, b)))
    a, b = a[start:], b[start:]
    end = len(commonprefix((a[::-1], b[::-1])))
    a, b = a[: len(a) - end], b[: len(b) - end]
    where: dict[str, int] = {}
    for at, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << at)
    mask = (1 << len(a)) - 1
    row = mask
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & mask
    return start + end + len(a) - row.bit_count()
