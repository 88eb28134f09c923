"""Harmonic packing of token sequences.

A document is cut into full sequences and, for what remains, pieces of the lengths
``capacity // k``: ``k`` such pieces fill a sequence. The last few ids are one piece of the class
``k = capacity // length``. Every task fills the sequences of each class with ``k`` pieces on its
own; what does not fill one meets the leftovers of 64 tasks, then of 4,096, and so on. The last
fewer than ``k`` pieces of each class (their number depends on the capacity alone) are laid end to
end and cut at full sequences and, at the very end, at powers of two.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Memo, kept_in_worker, saved

CAPACITY = 2048
#: Remainders up to this many ids are not cut further.
SMALL = 64
_JOINED = 64
#: Words and bare words that a worker remembers: some 100 MB, beside what earlier stages left in the executor.
_WORDS, _BARE = 300_000, 200_000
_OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit ids."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class WordTokenizer:
    """Ids of a tokenizer file whose pieces never hold white space: words met before are looked
    up. Plain Latin words go straight to the merges, all else through the whole tokenizer."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.full.encode_special_tokens = True
        self.model = self.full.model
        self.plain = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)").fullmatch
        self.odd = re.compile(r"[\x1c-\x1f]").search
        self.mapped = str.maketrans({chr(b): self._visible(b) for b in range(128, 256)})
        self.words = Memo(self._word, _WORDS)
        self.bare = Memo(self._bare, _BARE)

    @staticmethod
    def _visible(b: int) -> str:
        """The sign that stands for byte ``b`` in byte-level vocabularies."""
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        return chr(b) if b in kept else chr(256 + sorted(set(range(256)) - set(kept)).index(b))

    def _bare(self, piece: str) -> bytes:
        signs = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.mapped)
        return _packed([t.id for t in self.model.tokenize(signs)])

    def _word(self, word: str) -> bytes:
        m = self.plain(word)
        if m:
            return self.bare[m[1].lower()] + (self.bare[m[2]] if m[2] else b"")
        return self._whole(word)

    def _whole(self, text: str) -> bytes:
        return _packed(self.full.encode(text, add_special_tokens=False).ids)

    def ids(self, text: str) -> bytes:
        if self.odd(text):
            return self._whole(text)
        return b"".join(map(self.words.__getitem__, text.split()))


def harmonic_cuts(n: int, capacity: int = CAPACITY, small: int = SMALL) -> list[tuple[int, int]]:
    """(length, class) of the pieces of ``n`` ids; ``class`` pieces of that length fit a sequence."""
    out = [(capacity, 1)] * (n // capacity)
    n %= capacity
    while n > small:
        k = -(-capacity // n)
        out.append((capacity // k, k))
        n -= capacity // k
    if n:
        out.append((n, capacity // n))
    return out


def _fill(path: str, last_id: int):
    """Task: cut every document and fill sequences by class; rows without a sequence are left over."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "k", "task", "ids"]
    types = [pa.int64()] * 9 + [pa.binary()]

    def run(batches):
        coder = kept_in_worker(f"word bpe {path}", lambda: WordTokenizer(path))
        end = _packed([last_id])
        task, made, open_bins = TaskContext.get().partitionId(), 0, {}

        def table(rows):
            cols = list(zip(*rows)) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = coder.ids(text or "") + end
                total, start = len(ids) // 4, 0
                for length, k in harmonic_cuts(total):
                    part = ids[4 * start : 4 * (start + length)]
                    piece = (doc, start, length, zlib.crc32(part), total, k, part)
                    start += length
                    waiting = open_bins.setdefault(k, [])
                    waiting.append(piece)
                    if len(waiting) == k:
                        at = 0
                        for d, s, n, crc, t, _, _ in waiting:
                            out.append((d, s, n, crc, t, (task << 32) + made, at, k, task, None))
                            at += n
                        made += 1
                        open_bins[k] = []
            yield table(out)
        yield table([(d, s, n, crc, t, None, None, k, task, part) for b in open_bins.values() for d, s, n, crc, t, k, part in b])

    return run


def _lay_out(first: int):
    """One task: the last pieces end to end, at most ``capacity`` ids in a sequence."""

    def run(batches):
        rows = [r for b in batches for r in b.to_pylist()]
        rows.sort(key=lambda r: (r["k"], r["doc_id"] is None, r["doc_id"], r["start"], r["ids_crc32"]))
        total = sum(r["length"] for r in rows)
        bounds = list(range(0, total - total % CAPACITY + 1, CAPACITY))
        rest = total % CAPACITY
        while rest:
            step = 1 << (rest.bit_length() - 1)
            bounds.append(bounds[-1] + step)
            rest -= step
        out, at, seq = [], 0, 0
        for r in rows:
            done = 0
            while done < r["length"]:
                if at == bounds[seq + 1]:
                    seq += 1
                n = min(r["length"] - done, bounds[seq + 1] - at)
                part = r["ids"][4 * done : 4 * (done + n)]
                out.append((r["doc_id"], r["start"] + done, n, zlib.crc32(part), r["doc_tokens"], first + seq, at - bounds[seq]))
                done += n
                at += n
        if out:
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

    return run


def pack(df: DataFrame, path: str, last_id: int = 1) -> DataFrame:
    """Pieces of all documents, placed: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset``.

    ``path`` names the tokenizer file, ``last_id`` ends every document. A null or empty text is its
    end id alone. Repeated rows and rows without an id are documents of their own. An empty table
    gives no piece. Other columns of ``df`` are ignored.
    """
    docs = df.select(F.col("doc_id").cast("long"), "text")
    pieces = saved(docs.mapInArrow(_fill(path, last_id), f"{_OUT}, k long, task long, ids binary"), "pieces")
    columns = [c.split()[0] for c in _OUT.split(", ")]
    placed = pieces.where("sequence_id is not null").select(columns)
    left = pieces.where("sequence_id is null").drop("sequence_id", "offset")
    tasks = (left.agg(F.max("task")).first()[0] or 0) + 1
    level = 1
    while True:
        tasks = -(-tasks // _JOINED)
        group = Window.partitionBy("task", "k")
        order = group.orderBy("doc_id", "start", "ids_crc32")
        left = (
            left.withColumn("task", F.expr(f"task div {_JOINED}"))
            .withColumns({"n": F.count("*").over(group), "i": F.row_number().over(order) - 1})
            .withColumns({"bin": F.expr("i div k"), "full": F.expr("(i div k + 1) * k <= n")})
            .withColumn("offset", F.sum("length").over(Window.partitionBy("task", "k", "bin").orderBy("i")) - F.col("length"))
            .withColumn("sequence_id", F.expr(f"(cast({level} as bigint) << 60) + (task << 36) + (k << 24) + bin"))
        )
        left = saved(left, "leftover")
        placed = placed.unionByName(left.where("full").select(columns))
        left = left.where("not full").drop("n", "i", "bin", "full", "offset", "sequence_id")
        if tasks == 1:
            break
        level += 1
    last = left.coalesce(1).mapInArrow(_lay_out(7 << 60), _OUT)
    return placed.unionByName(last)
