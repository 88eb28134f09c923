"""Byte-level BPE by prefix dynamic programming.

For each byte prefix of a piece the table holds the last token of its encoding. That token is the
only one that ends there, is itself an encoding, and stays apart from the last token before it;
following the table back gives the encoding. Appending bytes adds entries; after an edit only the
entries from the edit on are made again.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, kept_in_worker

#: White space as Unicode defines it; some engines also count the separators 1C to 1F.
_SPACE = r"\t-\r\x85\p{Z}"
_WORDS, _PIECES = 800_000, 600_000


class PrefixBpe:
    """Encoding of one piece (no splitting) by ranks of byte strings."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks))
        self.alone = Memo(lambda t: self._merge(self.bytes_of[t]) == [t], 200_000)
        self.apart = Memo(lambda p: self._merge(self.bytes_of[p[0]] + self.bytes_of[p[1]]) == list(p), 1_000_000)

    def _merge(self, piece: bytes) -> list[int]:
        """The merges themselves, for the few bytes of one or two tokens."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
            if best == 1 << 40:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def table(self, piece: bytes, known: list[int] | None = None) -> list[int]:
        """Last token of every prefix of ``piece``; ``known`` are entries that still hold."""
        last = list(known or ())
        ranks, alone, apart = self.ranks, self.alone, self.apart
        for end in range(len(last) + 1, len(piece) + 1):
            for start in range(max(0, end - self.longest), end):
                token = ranks.get(piece[start:end])
                if token is not None and (apart[last[start - 1], token] if start else alone[token]):
                    last.append(token)
                    break
        return last

    def tokens(self, last: list[int]) -> list[int]:
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.bytes_of[out[-1]])
        return out[::-1]

    def append(self, piece: bytes, last: list[int], more: bytes) -> list[int]:
        return self.table(piece + more, last)

    def edit(self, last: list[int], edited: bytes, at: int) -> list[int]:
        """Table of ``edited``, which equals the old piece up to byte ``at``."""
        return self.table(edited, last[:at])

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.tokens(self.table(piece))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class TextEncoder:
    """Encoding of whole texts as little-endian 32-bit ids.

    A space between two characters that are no white space begins a piece, so such texts are cut
    there and equal words are encoded once; all others are cut by the pattern as they are.
    """

    def __init__(self, path: str, pattern: str):
        self.bpe = PrefixBpe(load_ranks(path))
        self.vocabulary = np.full(max(self.bpe.bytes_of) + 1, None, object)
        self.vocabulary[list(self.bpe.bytes_of)] = list(self.bpe.bytes_of.values())
        exact = pattern.replace(r"[^\s", "[^" + _SPACE).replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]")
        self.split = regex.compile(exact).findall
        self.loose = regex.compile(r" [\s\x1c-\x1f]|[\s\x1c-\x1f] ").search
        self.pieces = Memo(lambda p: np.array(self.bpe.encode(p.encode()), "<u4").tobytes(), _PIECES)
        self.words = Memo(lambda w: self._whole(" " + w), _WORDS)

    def _whole(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def encode(self, text: str) -> bytes:
        if self.loose(text):
            return self._whole(text)
        first, *rest = text.split(" ")
        return self._whole(first) + b"".join(map(self.words.__getitem__, rest))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(self.vocabulary[np.frombuffer(ids, "<u4")].tolist())


def _encoder(path: str, pattern: str) -> TextEncoder:
    return kept_in_worker(f"byte bpe {path}", lambda: TextEncoder(path, pattern))


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """Add ``ids`` (little-endian unsigned 32-bit, binary) and ``decoded`` (binary).

    A null or empty text has no ids. Texts are encoded whole, each match of ``pattern`` separately,
    without special tokens. Columns of ``df`` named like the new ones are replaced.
    """

    @F.pandas_udf("ids binary, decoded binary")
    def both(texts: pd.Series) -> pd.DataFrame:
        coder = _encoder(path, pattern)
        ids = [coder.encode(t or "") for t in texts]
        return pd.DataFrame({"ids": ids, "decoded": [coder.decode(x) for x in ids]})

    return df.drop("ids", "decoded").withColumn("_both", both(text_col)).select("*", "_both.*").drop("_both")


def digests(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of ``encode``, a batch at a time: the ids
    themselves, larger than the texts, stay in the task."""

    def run(batches):
        coder = _encoder(path, pattern)
        hexed = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            n, a, b = [], [], []
            for text in batch.column(1).to_pylist():
                ids = coder.encode(text or "")
                n.append(len(ids) // 4)
                a.append(hexed(ids))
                b.append(hexed(coder.decode(ids)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
