"""Similarity joins against brute force."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from quizloom.functions import kernels as K
from quizloom.functions import text as X
from quizloom.operators import dedup as D
from quizloom.operators import editjoin as E
from quizloom.operators import leaks as L
from quizloom.operators import setjoin as S
from quizloom.operators import tiles as T
from quizloom.operators import vector as V


def _unit(rng, n, d=8):
    m = rng.normal(size=(n, d))
    return (m / np.linalg.norm(m, axis=1, keepdims=True)).tolist()


def _texts(seed):
    rnd = random.Random(seed)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    out = []
    for n in (6, 9, 30, 33, 34, 60):
        base = " ".join(rnd.choice(words) for _ in range(n))
        out.append(base)
        for k in (1, 3, 8, 15, 25):
            chars = list(base)
            for _ in range(k):
                chars[rnd.randrange(len(chars))] = rnd.choice("abcxyz ")
            out.append("".join(chars))
        out.append(base)
    out += ["x" * 199, "x" * 198 + "y", "x" * 200, "x" * 199 + "y", "", "ab" * 100, "ba" * 100]
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize("seed,tile", [(1, 256), (2, 5)])
def test_fuzzy_first_match_equals_difflib(spark, seed, tile, monkeypatch):
    texts = _texts(seed)
    rows = [(i, i % 2, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id bigint, exam_set int, question string")
    monkeypatch.setattr(E, "TILE_ROWS", tile)
    got = {r.id: r.matched_id for r in D.fuzzy_first_match(df, ["exam_set"]).collect()}
    want = {}
    for i, s, t in rows:
        for j, s2, t2 in rows[:i]:
            # A row that has fallen flags nobody.
            if s == s2 and j not in want and SequenceMatcher(None, t.strip().lower(), t2.strip().lower()).ratio() >= 0.85:
                want[i] = j
                break
    assert got == want and want


def test_common_subsequence_is_an_upper_bound():
    rnd = random.Random(5)
    for _ in range(60):
        a = "".join(rnd.choice("abcd ") for _ in range(rnd.randint(0, 40)))
        b = "".join(rnd.choice("abcd ") for _ in range(rnd.randint(0, 40)))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert K.common_subsequence(a, b) == table[-1][-1]
        matched = sum(m.size for m in SequenceMatcher(None, a, b).get_matching_blocks())
        assert matched <= table[-1][-1]


def test_fuzzy_against_registry(spark):
    known = [(i, t) for i, t in enumerate(_texts(3))]
    asked = [(i, t) for i, t in enumerate(_texts(3)[::-1] + _texts(4))]
    schema = "id bigint, question string"
    got = {r.id: r.matched_id for r in D.fuzzy_against(spark.createDataFrame(asked, schema), spark.createDataFrame(known, schema)).collect()}
    want = {}
    for i, t in asked:
        hit = [j for j, u in known if SequenceMatcher(None, t.strip().lower(), u.strip().lower()).ratio() >= 0.85]
        if hit:
            want[i] = min(hit)
    assert got == want


@pytest.mark.parametrize("parts", [1, 5])
def test_jaccard_pairs_equal_brute_force(spark, parts):
    rnd = random.Random(parts)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(160):
        base = rnd.sample(vocabulary, rnd.randint(1, 14))
        rows.append((i, i % 3, " ".join(["the", "of", *base])))
        if i % 4 == 0:
            rows.append((1000 + i, i % 3, " ".join(["the", "of", *base[: max(1, len(base) - rnd.randint(0, 3))]])))
        if i % 5 == 0:
            rows.append((2000 + i, i % 3, " ".join(reversed(["the", "of", *base]))))
    # 11 shared of 20 joined is exactly the limit and must not count.
    rows.append((5000, 7, " ".join(f"x{i}" for i in range(15))))
    rows.append((5001, 7, " ".join(f"x{i}" for i in range(4, 20))))
    rows.append((5002, 7, ""))
    df = spark.createDataFrame(rows, "id bigint, g int, t string").repartition(parts)
    got = {r.g: r.pairs for r in S.jaccard_pair_counts(df, ["g"], "id", X.word_set(F.col("t")), 0.55).collect() if r.pairs}
    want = {}
    for i, (_, g, t) in enumerate(rows):
        for _, g2, t2 in rows[i + 1:]:
            a, b = set(t.lower().split()), set(t2.lower().split())
            if g == g2 and a and b and len(a & b) / len(a | b) > 0.55:
                want[g] = want.get(g, 0) + 1
    assert got == want


@pytest.mark.parametrize("sets, elements", [(512, 10**6), (40, 10**6), (512, 300), (0, 0)])
def test_jaccard_pairs_of_small_and_large_groups(spark, monkeypatch, sets, elements):
    """A group that fits a task is counted there, a larger one takes the index; the pairs are the same."""
    monkeypatch.setattr(S, "GROUP_SETS", sets)
    monkeypatch.setattr(S, "GROUP_ELEMENTS", elements)
    monkeypatch.setattr(S, "_CELLS", 500)
    rnd = random.Random(8)
    rows = [(i, i % 7 and 1, " ".join(rnd.sample([f"w{k}" for k in range(14)], rnd.randint(1, 9)))) for i in range(90)]
    rows += [(200 + i, None, "one two three") for i in range(3)] + [(300, 0, ""), (301, 0, None)]
    df = spark.createDataFrame(rows, "id bigint, g int, t string")
    got = S.jaccard_pairs(df, ["g"], "id", X.word_set(F.col("t")), 0.55)
    assert dict(got.dtypes)["shared"] == "int"
    folded = {}
    for i, g, t in rows:
        if g is not None and t:
            folded.setdefault((g, frozenset(t.split())), []).append(i)
    want = set()
    for (g, a), x in folded.items():
        for (h, b), y in folded.items():
            if g == h and min(x) < min(y) and len(a & b) / len(a | b) > 0.55:
                want.add((g, min(x), min(y), len(x), len(y), len(a & b), len(a | b)))
    assert want and sorted(map(tuple, got.collect())) == sorted(want)


def test_shared_elements_of_sets_beyond_one_block_of_cells(monkeypatch):
    monkeypatch.setattr(S, "_CELLS", 12)
    sets = [{1, 2, 3}, {2, 3, 4, 9}, {7}, {1, 2, 3, 4, 5, 6, 9}]
    got = S.shared_elements(np.array(list(map(len, sets))), np.array([x for s in sets for x in sorted(s)]))
    assert (got - np.diag(np.diag(got))).tolist() == [[len(a & b) if a is not b else 0 for b in sets] for a in sets]


def test_tag_overlap_counts_equal_brute_force(spark):
    rnd = random.Random(3)
    rows = [(i, i % 2, [f"t{rnd.randrange(5)}" for _ in range(rnd.randint(0, 4))]) for i in range(80)]
    df = spark.createDataFrame(rows, "id bigint, g int, tags array<string>")
    got = {r.g: r.pairs for r in S.overlap_pair_counts(df, ["g"], F.col("tags"), 0.8).collect()}
    want = {0: 0, 1: 0}
    for i, (_, g, t) in enumerate(rows):
        for _, g2, t2 in rows[i + 1:]:
            a, b = set(t), set(t2)
            if g == g2 and a and b and len(a & b) / min(len(a), len(b)) >= 0.8:
                want[g] += 1
    assert got == want


def test_small_blocks_share_a_frame(spark):
    """Many blocks of a few rows come in one batch, a block is cut by the end of a batch, and keys are texts."""
    rnd = np.random.default_rng(4)
    vecs = _unit(rnd, 120)
    rows = [(i, f"b{i % 40}" if i < 60 else "big", v) for i, v in enumerate(vecs)]
    df = spark.createDataFrame(rows, "id bigint, g string, vec array<double>")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        found = T.pairs_within(df, ["g"], "id", ["vec"], K.cosine_at_least(0.1), tile_rows=25)
        got = sorted((r.g, r.left_id, r.right_id) for r in found.collect())
        assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = [(g, i, j) for i, g, v in rows for j, h, w in rows if i < j and g == h and np.dot(v, w) >= 0.1]
    assert got == sorted(want) and len({g for g, *_ in got}) > 2


def test_tiles_find_every_pair_once(spark):
    vecs = _unit(np.random.default_rng(1), 90)
    rows = [(i, i % 2, v) for i, v in enumerate(vecs)]
    df = spark.createDataFrame(rows, "id bigint, g int, vec array<double>")
    got = [(r.left_id, r.right_id) for r in T.pairs_within(df, ["g"], "id", ["vec"], K.cosine_at_least(0.4), tile_rows=7).collect()]
    m = np.array(vecs)
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if i % 2 == j % 2 and m[i] @ m[j] >= 0.4}
    assert len(got) == len(set(got)) and set(got) == want


def test_cosine_duplicates_equal_the_loop(spark):
    vecs = _unit(np.random.default_rng(2), 60)
    vecs = [vecs[i % 40] if i % 4 == 0 else vecs[i] for i in range(60)]
    df = spark.createDataFrame([(i, i % 2, v) for i, v in enumerate(vecs)], "id bigint, g int, vec array<double>")
    got = {r.id: r.flagged_by for r in D.cosine_duplicates(df, ["g"], 0.6).collect()}
    m, want = np.array(vecs), {}
    for i in range(60):
        if i in want:
            continue
        for j in range(i + 1, 60):
            if i % 2 == j % 2 and j not in want and m[i] @ m[j] >= 0.6:
                want[j] = i
    assert got == want and want


@pytest.mark.parametrize("limit", [2**20, 0])
def test_top_k_small_and_tiled_agree(spark, limit, monkeypatch):
    monkeypatch.setattr(V, "SENT_QUERY_BYTES", limit)
    rng = np.random.default_rng(4)
    c, q = _unit(rng, 120), _unit(rng, 9)
    c[7] = c[3]
    corpus = spark.createDataFrame([(i, i % 3, v) for i, v in enumerate(c)], "id bigint, g int, vec array<double>")
    asks = spark.createDataFrame([(i, i % 4, v) for i, v in enumerate(q)], "query_id bigint, g int, vec array<double>")
    got = {(r.query_id, r["rank"]): r.id for r in V.top_k(corpus, asks, 5, ["g"]).collect()}
    want = {}
    for i, v in enumerate(q):
        s = sorted((-round(float(np.dot(v, u)), 6), j) for j, u in enumerate(c) if j % 3 == i % 4)
        want.update({(i, r + 1): j for r, (_, j) in enumerate(s[:5])})
    assert got == want


def test_diversify_equals_the_loop(spark):
    rnd = random.Random(6)
    words = "a b c d e f".split()
    rows = []
    for q in range(4):
        for r in range(1, (21 if q else 6)):
            rows.append((q, q * 100 + r, round(1 - r / 40, 6), r, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 12)))))
    df = spark.createDataFrame(rows, "query_id int, id bigint, score double, rank int, text string")
    got = {(r.query_id, r.place): r.id for r in V.diversify(df, 8).collect()}

    def grams(t):
        w = t.lower().split()
        return set(zip(w, w[1:]))

    want = {}
    for q in range(4):
        left = [r for r in rows if r[0] == q]
        picked = left[:] if len(left) <= 8 else []
        while len(left) > len(picked) and len(picked) < 8:
            best, at = None, None
            for r in [x for x in left if x not in picked]:
                over = max((len(grams(r[4]) & grams(p[4])) / len(grams(r[4]) | grams(p[4])) for p in picked if grams(p[4]) and grams(r[4])), default=0.0)
                value = 0.6 * r[2] - 0.4 * over
                if best is None or value > best:
                    best, at = value, r
            picked.append(at)
        want.update({(q, i + 1): r[1] for i, r in enumerate(picked)})
    assert got == want


def test_leaks_of_a_hand_made_set(spark):
    rows = [
        (1, 1, "Paste Special (Ctrl+Shift+V) pastes values", ["x1", "x2", "x3", "x4"], "x1"),
        (2, 1, "Which keys open Paste Special?", ["Ctrl+Shift+V", "Alt+P", "F5", "F12"], "Ctrl+Shift+V"),
        (3, 1, "What does LAN (Local Area Network) join?", ["rooms", "cells", "files", "sheets"], "rooms"),
        (4, 1, "Full form of LAN?", ["Local Area Network", "Long Arm Net", "Lone Area", "Last"], "Local Area Network"),
        (5, 1, "Port 80 and =SUM(A1) use http", ["p", "q", "r", "s"], "p"),
        (6, 1, "Which port?", ["80", "81", "82", "83"], "80"),
        (7, 2, "Which port again?", ["80", "81", "82", "83"], "80"),
    ]
    df = spark.createDataFrame(rows, "id bigint, exam_set int, question string, options array<string>, correct_answer string")
    got = {r.id: r.anchor for r in L.answer_leaks(df).collect()}
    # The one-character answer "p" lies in the fact Alt+P of another question.
    assert set(got) == {2, 4, 5, 6}
    assert got[6] == "80" and got[4] == "local area network"
    assert {r.id for r in L.answer_leaks(df, least_answer=2).collect()} == {2, 4, 6}
