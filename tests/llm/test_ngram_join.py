"""The n-gram join against all pairs compared one by one."""

import random
import re

import numpy as np
import pytest

from quizloom.llm import ngram_join as N


def _set(text, words):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not ws:
        return frozenset()
    if len(ws) < words:
        return frozenset([tuple(ws)])
    return frozenset(tuple(ws[i : i + words]) for i in range(len(ws) - words + 1))


def _brute(rows, words, percent):
    sets = [(i, _set(t, words)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[a + 1 :]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {(i, len(s), find(i)) for i, s in sets}


def _corpus(seed, n, length):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    bases = [[r.choice(vocab) for _ in range(r.choice(length))] for _ in range(8)]
    out = []
    for i in range(n):
        ws = list(r.choice(bases)) if r.random() < 0.8 else [r.choice(vocab) for _ in range(r.choice(length))]
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
            at = r.randrange(len(ws))
            ws[at : at + r.choice([0, 1])] = [r.choice(vocab)]
        out.append((i, " ".join(ws).replace("w1", "W1")))
    return out


@pytest.mark.parametrize("words,percent,length", [(3, 90, [1, 2, 3, 5, 12]), (3, 90, [60, 90, 150]), (5, 80, [40, 45, 70]), (3, 90, [20, 21, 30])])
def test_equals_all_pairs(spark, words, percent, length):
    rows = _corpus(words * percent + length[0], 160, length) + [(900, None), (901, ""), (902, " \n\t"), (903, "é\x0bx"), (904, "É X")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in N.ngram_join(df, words=words, percent=percent).collect()}
    assert got == _brute(rows, words, percent)


def test_families_in_parts(spark, monkeypatch):
    rows = _corpus(5, 300, [100, 101])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(N, "TREE_DOCS", 7)
    got = {tuple(r) for r in N.ngram_join(df).collect()}
    assert got == _brute(rows, 3, 90)


def test_keys_of_links_meet():
    r = random.Random(3)
    for percent in (80, 90):
        table = N._classes(percent)
        firsts, segments = np.array([x[0] for x in table]), [x[1] for x in table]
        for _ in range(300):
            n = r.choice([1, 2, 5, 9, 20, 33, 120, 600])
            a = {r.getrandbits(64) for _ in range(n)}
            b = set(a)
            while True:
                c = (b | {r.getrandbits(64)}) if r.random() < 0.5 else set(list(b)[1:])
                if not c or 100 * len(a & c) < percent * len(a | c):
                    break
                b = c
            ka, kb = (set(N._keys(np.sort(np.array(list(x), np.uint64)), percent, firsts, segments).tolist()) for x in (a, b))
            assert ka & kb


def test_common_passages_make_no_families(spark, monkeypatch):
    """Documents that share a passage, but not most of their words, are compared by no tree."""
    r, merges, sizes = random.Random(7), N._merges, []
    passage = " ".join(f"common{i}" for i in range(10))
    words = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    texts = [f"{words(30)} {passage} {words(30)}" for _ in range(200)]
    rows = list(enumerate([*texts, texts[50] + " one more", texts[60]]))

    def counted(docs, members, *rest):
        sizes.append(members.count())
        return merges(docs, members, *rest)

    monkeypatch.setattr(N, "_merges", counted)
    monkeypatch.setattr(N, "TREE_DOCS", 16)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {tuple(x) for x in N.ngram_join(df, words=5, percent=80).collect()}
    assert got == _brute(rows, 5, 80) and sizes == [2]


def test_first_shingles_of_links_meet():
    """In any common order, two linked sets share one of their first shingles."""
    r = random.Random(4)
    for percent in (80, 90):
        for _ in range(300):
            n = r.choice([1, 2, 5, 9, 20, 33, 120])
            a, order = {r.getrandbits(40) for _ in range(n)}, r.getrandbits(40)
            b = set(a)
            while 100 * len(a & (c := b | {r.getrandbits(40)} if r.random() < 0.5 else set(list(b)[1:]))) >= percent * len(a | c) and c:
                b = c
            one, two = (set(sorted(x, key=lambda v: v ^ order)[: N._first_shingles(len(x), percent)]) for x in (a, b))
            assert one & two


@pytest.mark.parametrize("flush,docs", [(40, 60_000), (2_000_000, 3)])
def test_blocks_of_every_size(spark, monkeypatch, flush, docs):
    monkeypatch.setattr(N, "_FLUSH_KEYS", flush)
    monkeypatch.setattr(N, "_BLOCK_DOCS", docs)
    rows = _corpus(9, 150, [1, 3, 8, 30, 60])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {tuple(x) for x in N.ngram_join(df, words=5, percent=80).collect()} == _brute(rows, 5, 80)


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert N.ngram_join(empty).count() == 0
    df = spark.createDataFrame(
        [(1, "a b c d", "x", 2), (None, "a b c d", "y", 3), (2, "a b c d", "x", 2), (2, "a b c d", "x", 2), (3, "z " * 50_000, None, None)],
        "doc_id long, text string, comp string, n int",
    )
    got = sorted(N.ngram_join(df).collect(), key=str)
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in got) == [(0, 2, 1), (1, 2, 1), (2, 2, 1), (2, 2, 1), (3, 1, 3)]
    kept = N.one_per_group(df)
    assert kept.columns == df.columns and kept.count() == 3
