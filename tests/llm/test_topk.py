"""M-tree search against all inner products."""

import math
import random

import numpy as np
import pytest

from quizloom.llm import topk as T


def _brute(rows, every, k):
    vs = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        vs.setdefault(i, set()).add(tuple(math.floor(64 * float(x)) for x in v))
    flat = [(i, v) for i, s in vs.items() for v in s]
    out = set()
    for q, a in flat:
        if q % every == 0:
            hits = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in flat if i != q and len(a) == len(b))
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(hits[:k])}
    return out


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_equals_all_products(spark, monkeypatch, spread):
    monkeypatch.setattr(T, "PAGE", 64)
    monkeypatch.setattr(T, "QUERIES", 9)
    monkeypatch.setattr(T, "_LEAF", 8)
    r = np.random.default_rng(5)
    centres = r.normal(size=(6, 10))
    rows = [(i, (centres[i % 6] + spread * r.normal(size=10)).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(x) for x in T.top_k(df).collect()} == _brute(rows, 20, 20)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (20, [0.5]), (1, [1.0, None]), (2, None), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]),
            (5, [3.0, -1.0]), (6, [2.0]), (None, [1.0, 1.0]), (7, [1e7, 1e7]), (40, [2e7, -1e7]), (8, [3.0, -1.0]), (60, []), (61, [])]
    df = spark.createDataFrame([(*r, "v") for r in rows], "vec_id long, embedding array<double>, v string")
    assert {tuple(x) for x in T.top_k(df).collect()} == _brute(rows, 20, 20)
    assert T.top_k(df.limit(0)).count() == 0


def test_bounds_skip_work():
    r = np.random.default_rng(2)
    centres = r.normal(size=(8, 6)) * 100
    x = np.floor(np.concatenate([c + r.normal(size=(200, 6)) for c in centres]))
    norm2 = float((x * x).sum(1).max())
    tree = T.MTree(np.arange(len(x)), x, norm2)
    got = tree.search(x[5], 5, 10, T._NONE)
    want = sorted(((int(x[i] @ x[5]), i) for i in range(len(x)) if i != 5), key=lambda h: (-h[0], h[1]))[:10]
    assert sorted(got, key=lambda h: (-h[0], h[1])) == want
    assert tree.search(x[5], 5, 10, want[0][0] + 1) == []
