"""Tokens: the same ids as the libraries, exact round trips, and every id packed once."""

import random
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from quizloom.llm import byte_bpe, packing  # noqa: E402

TEXTS = [
    "", " ", "  two  spaces ", "a\tb \n c\r\n", "Don't we'll 'tis", "naïve café № 12 345½", "日本語テキスト", "x" * 700, " " * 300,
    "a\x1cb \x1d c", "emoji 👩‍👩‍👧 ok", "ÀÉÎ straße ÿ İstanbul ΣΑΣ ẞ", "é tét", "end.\nNext one, (two)", "<|endoftext|> is text",
    " nb sp", "((((!!!!)))) ==== ----" * 9, "1234567890 12a b34", "The The the", "　wide", "tail ", "ﬁ ligature ①",
]


def _random_texts(n):
    r = random.Random(4)
    signs = "abcdefghijklmnopqrstuvwxyzABCéüß .,!?'  \n\t0123«»"
    return ["".join(r.choice(signs) for _ in range(r.randrange(200))) for _ in range(n)]


def _tiktoken():
    import tiktoken

    ranks = byte_bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_tiktoken():
    own, lib = byte_bpe.TextEncoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN), _tiktoken()
    for text in TEXTS + _random_texts(400):
        ids = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode_ordinary(text), text
        assert own.decode(ids) == text.encode()


def test_append_and_edit():
    bpe = byte_bpe.PrefixBpe(byte_bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")))
    r = random.Random(1)
    word = "".join(r.choice("thereandonouing") for _ in range(60)).encode()
    table = bpe.table(word)
    assert bpe.append(word[:25], bpe.table(word[:25]), word[25:]) == table
    assert bpe.tokens(table) == bpe._merge(word)
    edited = word[:30] + b"XQ" + word[33:]
    assert bpe.edit(table, edited, 30) == bpe.table(edited)
    assert bpe.tokens(bpe.edit(table, edited, 30)) == bpe._merge(edited)


def test_byte_bpe_columns(spark):
    df = spark.createDataFrame([(1, None, "z"), (2, "", "z"), (2, "a b", "z"), (None, "a b", None)], "doc_id long, text string, ids string")
    out = byte_bpe.encode(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert [bytes(r.decoded) for r in out] == [b"", b"", b"a b", b"a b"]
    assert byte_bpe.digests(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 4
    assert byte_bpe.digests(df.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def _full():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    return t


def test_same_ids_as_tokenizers():
    own, lib = packing.WordTokenizer(P.path("word_bpe_49k.json")), _full()
    for text in TEXTS + _random_texts(400):
        assert np.frombuffer(own.ids(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids, text


def test_cuts():
    for n in [*range(1, 5000), 20_000]:
        cuts = packing.harmonic_cuts(n)
        assert sum(a for a, _ in cuts) == n
        assert all(2048 // (k + 1) < a <= 2048 // k or a == 2048 // k for a, k in cuts)


def _check_packing(out, rows):
    lib, seen, seqs = _full(), {}, {}
    for r in out:
        seen.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, text in rows:
        ids = lib.encode(text or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(seen.pop(i), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert not seen
    padded = 0
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
        padded += 0 if at & (at - 1) == 0 else 2048 - at
    return padded


@pytest.mark.parametrize("tasks", [1, 5])
def test_packing(spark, tasks, monkeypatch):
    monkeypatch.setattr(packing, "_JOINED", 2)
    r = random.Random(8)
    rows = [(i, " ".join(r.choice(["der", "the", "onthtion", "x,"]) for _ in range(r.choice([0, 1, 30, 200, 3000])))) for i in range(300)]
    rows += [(1000, None), (1001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(tasks)
    out = packing.pack(df, P.path("word_bpe_49k.json")).collect()
    padded = _check_packing(out, rows)
    assert padded < 0.02 * sum(x.length for x in out)


def test_packing_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b", 1), (7, "a b", 2), (7, "a b", 2)], "doc_id long, text string, k int")
    assert sum(r.length for r in packing.pack(df, P.path("word_bpe_49k.json")).collect()) == 9
    assert packing.pack(df.limit(0), P.path("word_bpe_49k.json")).count() == 0
