"""Tokenizer alignment against plain loops over byte ranges."""

import hashlib
import random
from collections import Counter
from itertools import accumulate

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from quizloom.llm import alignment as A

PATHS = (P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
PIECES = [" ", "  ", "\n", "\t", "a", "b", "é", "ß", "日", "😀", "'s", "'", "12", "▁", ".", "\x1c", "\x85", "<|endoftext|>", "<0x41>", "<s>", "́", "ﬁ", "\r", "\x00"]


@pytest.fixture(scope="module")
def both():
    return A.Tokenizers(*PATHS)


def _texts():
    rng = random.Random(2)
    odd = ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 25))) for _ in range(600)]
    return [None, "", " ", "plain words here", "plain words here", "x" * 3000, " \n ", "the end \n", *odd]


def _brute(both, text):
    found = both.encode([" " + text])[0] if text else None
    if not found:
        return None
    a, b = found
    ends = [list(accumulate(len(table[i]) for i in ids)) for ids, table in ((a, both.bytes_a), (b, both.bytes_b))]
    spans = [list(zip(ids, [0, *e], e)) for ids, e in zip(found, ends)]
    groups, low = [], 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        groups.append("|".join(",".join(str(i) for i, _, e in side if low < e <= cut) for side in spans))
        low = cut
    return a, b, groups, [(x, y) for x, s, e in spans[0] for y, t, f in spans[1] if max(s, t) < min(e, f)]


def test_documents_equal_plain_loops(spark, both, monkeypatch):
    monkeypatch.setattr(A, "BLOCK_BYTES", 2000)
    texts = _texts()
    rows = [(i if i != 7 else None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"pair": F.lit(1), "block": F.lit("b"), "n_a": F.lit(5)})
    got = {r.doc_id: r for r in A.align(docs.repartition(3), *PATHS).collect()}
    found = [_brute(both, t) for t in texts]
    counts = Counter(link for f in found if f for link in f[3])
    top = {}
    for (_, y), n in counts.items():
        top[y] = max(top.get(y, 0), n)
    assert len(got) == len(texts) and sum(f is None for f in found) > 50
    for (i, _), f in zip(rows, found):
        r = got[i]
        have = (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)
        if f is None:
            assert have == (0, 0, 0, 0, 0, 0, "")
            continue
        a, b, groups, links = f
        best = sum(counts[x] == top[x[1]] for x in links)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        assert have == (len(a), len(b), len(groups), len(links), best, sum(counts[x] for x in links), digest)
        assert r.n_group_links == sum(len(x.split(",")) * len(y.split(",")) for x, y in (g.split("|") for g in groups))


def test_empty_table(spark):
    assert A.align(spark.createDataFrame([], "doc_id long, text string"), *PATHS).count() == 0


def test_segments_give_the_ids_of_whole_texts(both):
    texts = [t for t in _texts() if t]
    for t in texts:
        whole, parts = both.encode([" " + t])[0], both.encode(A.segments_of(t))
        assert (whole is None) == (None in parts)
        if whole:
            assert whole == tuple(sum((p[side] for p in parts), []) for side in (0, 1))


def test_small_memory_gives_the_same(both):
    texts = [t for t in _texts() if t]
    one, two = A.Segments(both), A.Segments(both, limit=3)
    whole = A.block(one, list(range(len(texts))), texts)
    again = [A.block(two, [i], [t]).rows[0][:7] for i, t in enumerate(texts)]
    assert [r[:7] for r in whole.rows] == again


def test_sparse_products():
    rng = np.random.default_rng(3)
    for _ in range(30):
        n, m, k = rng.integers(1, 9, 3)
        x, y = (rng.random(s) < 0.3 for s in ((n, m), (m, k)))
        a, b = (A.Csr.of(d.sum(1), np.nonzero(d)[1], d.shape[1]) for d in (x, y))

        def dense(c, shape):
            out = np.zeros(shape, int)
            out[c.rows, c.columns] = c.values
            return out

        product = x.astype(int) @ y.astype(int)
        assert (dense(a.times(b), (n, k)) == product).all() and (dense(a.transposed(), (m, n)) == x.T).all()
        assert (a.entries(b) == product.sum(1)).all()


def test_links_in_groups(both):
    a, b = both.encode([" unbelievable aligners"])[0]
    p = A.multiply(np.array(a), both.size_a[a], np.array(b), both.size_b[b])
    links = p.links_in_groups()
    assert len(links.columns) == p.count_in_groups().sum()
    assert set(zip(p.overlap.rows.tolist(), p.overlap.columns.tolist())) <= set(zip(links.rows.tolist(), links.columns.tolist()))
    assert p.overlap.values.sum() == len(" unbelievable aligners")
