"""Closed syncmers against a plain loop; edits and next documents by hand."""

import hashlib
import random

import regex
import xxhash
from pyspark.sql import functions as F

from quizloom.llm import fingerprint as X


def _h(*values, seed=42):
    for v in values:
        raw = v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True)
        seed = xxhash.xxh64_intdigest(raw, seed=seed)
    return seed - 2**64 if seed >= 2**63 else seed


def _h_chain(*values):
    seed = 42
    for v in values:
        seed = _h(v, seed=seed % 2**64)
    return seed


def _sketch(text):
    han = r"\p{Han}\p{Hiragana}\p{Katakana}"
    ps = regex.findall(rf"(?V1)[{han}]|[[\p{{L}}\p{{M}}\p{{N}}]--[{han}]]{{1,3}}|[^\s\p{{L}}\p{{M}}\p{{N}}]", text or "")
    h = [_h_chain(p) for p in ps]
    if len(h) < X.K:
        return [_h_chain("short", *h)] if h else []
    s = [_h_chain(a, b) for a, b in zip(h, h[1:])]
    out = set()
    for i in range(len(h) - X.K + 1):
        window = s[i : i + X.K - X.S + 1]
        if min(window) in (window[0], window[-1]):
            out.add(_h_chain(s[i], s[i + 2], h[i + 4]))
    return sorted(out)[: X.SIZE]


def _near(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    u = sorted(set(a) | set(b))[: X.SIZE]
    return len(set(u) & set(a) & set(b)) / len(u)


def test_equals_loops(spark):
    r = random.Random(2)
    words = ["the", "thention", "éauxre", "北京市", "x1", "ß", "!?", "and", "ouer", "a"]
    texts = [" ".join(r.choice(words) for _ in range(r.choice([0, 1, 3, 9, 60, 900]))) for _ in range(60)] + [None, "", "  \n", "same same " * 2000]
    ids = r.sample(range(-50, 10_000), len(texts))
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: x for x in X.fingerprints(df).collect()}
    order = sorted(ids, reverse=True)
    text = {i: t or "" for i, t in zip(ids, texts)}
    assert len(got) == len(ids)
    for a, b in zip(order, order[1:] + order[:1]):
        t, cut = text[a], len(text[a]) // 3
        edited = t[: len(t) - cut] + text[b][:cut]
        x = got[a]
        hexed = lambda s: "".join(f"{v % 2**64:016x}" for v in s)
        assert x.n_chars == len(t) and x.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert x.fingerprint == hexed(_sketch(t)) and x.edited_fingerprint == hexed(_sketch(edited))
        assert abs(x.near_edited - _near(_sketch(t), _sketch(edited))) < 1e-9
        assert abs(x.near_next - _near(_sketch(t), _sketch(text[b]))) < 1e-9


def test_odd_rows(spark):
    rows = [(5, "aa bb cc dd", "x"), (5, "aa bb cc dd", "y"), (3, "zz yy", "x"), (3, "ab", "x"), (None, "abcdef", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, head string")
    out = X.fingerprints(df).collect()
    assert len(out) == 5
    assert {x.edited_sha256 for x in out if x.doc_id == 5} == {hashlib.sha256(b"aa bb ccab").hexdigest()}
    assert [x.edited_sha256 for x in out if x.doc_id is None] == [hashlib.sha256(b"abcd").hexdigest()]
    assert X.fingerprints(df.limit(0)).count() == 0


def test_no_python_and_no_single_task_of_texts(spark, sf_dir):
    plan = X.fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
