"""Alignment of two tokenizers over the same bytes, by sparse incidence matrices.

A token covers bytes of its text, so each tokenizer gives a token-byte incidence matrix A or B. The
rows of A * B^T, worked out row by row as by Gustavson, hold the tokens of the other side that overlap
a token, valued by the bytes they share. Bytes where both sides end a token cut the text into groups; the products
of the token-group matrices link tokens of one group. The matrices are in compressed sparse rows, made by hand.

A text is cut at blanks behind a visible character. Neither tokenizer joins bytes across such a blank,
so equal segments are tokenized and multiplied once a worker and looked up afterwards. Counts of
linked ids are summed by block of documents, added up by Spark, and return to the blocks that asked.
"""

from __future__ import annotations

import hashlib
import unicodedata
import uuid
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept_in_worker, saved

#: Segments that a worker remembers.
SEGMENTS = 250_000
#: Bytes of text after which a block of documents ends (a longer document is a block).
BLOCK_BYTES = 4 * 2**20
_PAIR = 1 << 32

_CUT = regex.compile(r"(?<=[\p{L}\p{M}\p{N}\p{P}\p{S}])(?= )(?=\s+\S)")


@dataclass
class Csr:
    """Compressed sparse rows: row ``i`` has its columns at ``starts[i]:starts[i + 1]``."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    @classmethod
    def of(cls, sizes: np.ndarray, columns: np.ndarray, width: int) -> Csr:
        starts = np.concatenate(([0], np.cumsum(sizes)))
        return cls(starts, columns, np.ones(len(columns), np.int64), width)

    @property
    def rows(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))

    def transposed(self) -> Csr:
        order = np.argsort(self.columns, kind="stable")
        starts = np.concatenate(([0], np.cumsum(np.bincount(self.columns, minlength=self.width))))
        return Csr(starts, self.rows[order], self.values[order], len(self.starts) - 1)

    def entries(self, other: Csr) -> np.ndarray:
        """Symbolic half of ``self * other``: for each row the terms that its product adds up."""
        terms = np.diff(other.starts)[self.columns]
        return np.add.reduceat(np.append(terms, 0), self.starts[:-1]) * (np.diff(self.starts) > 0) if len(self.starts) > 1 else terms

    def times(self, other: Csr) -> Csr:
        """Row products: row ``i`` is the sum of the rows of ``other`` that row ``i`` names."""
        many = np.diff(other.starts)[self.columns]
        total = int(many.sum())
        ends = np.cumsum(many)
        at = np.arange(total) - np.repeat(ends - many, many) + np.repeat(other.starts[self.columns], many)
        cell = np.repeat(self.rows, many) * other.width + other.columns[at]
        value = np.repeat(self.values, many) * other.values[at]
        cells, which = np.unique(cell, return_inverse=True)
        sums = np.bincount(which, weights=value, minlength=len(cells)).astype(np.int64)
        rows, columns = np.divmod(cells, max(1, other.width))
        starts = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(self.starts) - 1))))
        return Csr(starts, columns, sums, other.width)


def token_bytes(sizes: np.ndarray, width: int) -> Csr:
    """Incidence of tokens that follow each other on bytes."""
    return Csr.of(sizes, np.arange(width), width)


def token_groups(ends: np.ndarray, cuts: np.ndarray) -> Csr:
    """Incidence of tokens on groups; ``cuts`` are the sorted ends of the groups."""
    return Csr.of(np.ones(len(ends), np.int64), np.searchsorted(cuts, ends), len(cuts))


@dataclass
class Product:
    """Tokens of both sides with their groups and overlap links (places in ``a`` and ``b``). Several
    texts may follow each other: no token reaches over an end of both."""

    a: np.ndarray
    b: np.ndarray
    in_a: Csr
    in_b: Csr
    overlap: Csr
    cuts: np.ndarray

    def spelled(self) -> list[str]:
        """Each group as ``a1,a2|b1``."""
        sides = []
        for ids, groups in ((self.a, self.in_a), (self.b, self.in_b)):
            names = list(map(str, ids.tolist()))
            ends = np.searchsorted(groups.columns, np.arange(groups.width + 1)).tolist()
            sides.append([",".join(names[i:j]) for i, j in zip(ends, ends[1:])])
        return ["|".join(x) for x in zip(*sides)]

    def links_in_groups(self) -> Csr:
        """Tokens of both sides that share a group (every pair: for texts whose groups are small)."""
        return self.in_a.times(self.in_b.transposed())

    def count_in_groups(self) -> np.ndarray:
        """For each A token the number of its ``links_in_groups``, without making them."""
        return self.in_a.entries(self.in_b.transposed())


def multiply(a: np.ndarray, size_a: np.ndarray, b: np.ndarray, size_b: np.ndarray) -> Product:
    """Products of two tokenizations of the same bytes: ids and lengths in bytes of both."""
    width = int(size_a.sum())
    overlap = token_bytes(size_a, width).times(token_bytes(size_b, width).transposed())
    ends_a, ends_b = np.cumsum(size_a), np.cumsum(size_b)
    cuts = np.intersect1d(ends_a, ends_b)
    return Product(a, b, token_groups(ends_a, cuts), token_groups(ends_b, cuts), overlap, cuts)


def _byte_alphabet() -> dict[str, int]:
    """Characters of byte-level tokens: printable Latin-1 stands for itself, the other bytes for
    the characters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        of_char = _byte_alphabet()
        vocabulary = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(of_char[c] for c in token) if all(c in of_char for c in token) else token.encode()
        pieces = map(self.b.id_to_piece, range(self.b.get_piece_size()))
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]

        self.size_a = np.array(list(map(len, self.bytes_a)), np.int64)
        self.size_b = np.array(list(map(len, self.bytes_b)), np.int64)

    def _same(self, text: str, a: list[int], b: list[int]) -> bool:
        raw = text.encode(errors="replace")
        return raw == b"".join(map(self.bytes_a.__getitem__, a)) == b"".join(map(self.bytes_b.__getitem__, b))

    def encode(self, segments: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """Ids of both sides for segments that begin with a blank; None where a side's bytes are not the segment's."""
        every = self.a.encode_batch(segments, add_special_tokens=False)
        pairs = zip((a.ids for a in every), self.b.encode([s[1:] for s in segments], num_threads=1))
        return [p if self._same(s, *p) else None for s, p in zip(segments, pairs)]

    def encode_row(self, segments: list[str]) -> tuple[list[int], list[int]] | None:
        """Ids of both sides for segments in a row, each with a visible end: those of each, one after the other."""
        text = "".join(segments)
        a, b = self.a.encode(text, add_special_tokens=False).ids, self.b.encode(text[1:])
        return (a, b) if self._same(text, a, b) else None


def segments_of(text: str) -> list[str]:
    """Cut a blank and the text at blanks behind visible characters; blanks at the end stay with the last."""
    return _CUT.split(" " + text)


def _plain(piece: str) -> bool:
    """A piece between blanks is a segment (behind its blank) if it ends in a visible character."""
    return bool(piece) and unicodedata.category(piece[-1])[0] in "LMNPS"


class Segments:
    """What a worker knows of segments, by their text behind the first blank: place, numbers, spelled
    groups and linked id pairs. ``plain`` are pieces between blanks (-1: no segment), ``rough`` the
    segments of texts that hold such a piece."""

    def __init__(self, tokenizers: Tokenizers, limit: int = SEGMENTS):
        self.tokenizers, self.limit = tokenizers, limit
        self.clear()

    def clear(self) -> None:
        self.plain: dict[str, int] = {}
        self.rough: dict[str, int] = {}
        self.spelled: list[str | None] = []
        self.pairs: list[np.ndarray] = []
        self.numbers: list[tuple[int, int, int, int, int]] = []
        self.uses = np.zeros(0, np.int64)

    def used(self, places: np.ndarray, times: np.ndarray) -> None:
        """Count the occurrences of segments."""
        self.uses = np.concatenate((self.uses, np.zeros(len(self.spelled) - len(self.uses), np.int64)))
        self.uses[places] += times

    def trim(self) -> None:
        """Forget segments that occurred once, and the rarer ones of the others if they are still too many."""
        kept = np.flatnonzero(self.uses > 1)
        if len(kept) > self.limit // 2:
            kept = np.sort(kept[np.argsort(-self.uses[kept], kind="stable")[: self.limit // 2]])
        now = np.full(len(self.spelled), -1, np.int64)
        now[kept] = np.arange(len(kept))
        now = now.tolist()
        for name in ("plain", "rough"):
            setattr(self, name, {t: now[p] for t, p in getattr(self, name).items() if p >= 0 and now[p] >= 0})
        for name in ("spelled", "pairs", "numbers"):
            values = getattr(self, name)
            setattr(self, name, [values[i] for i in kept.tolist()])
        self.uses = self.uses[kept]

    def _learn(self, texts: list[str], table: dict[str, int]) -> None:
        for start in range(0, len(texts), 2000):
            self._add(texts[start : start + 2000], table)

    def _add(self, texts: list[str], table: dict[str, int]) -> None:
        coder = self.tokenizers
        segments = [" " + t for t in texts]
        row = coder.encode_row(segments) if table is self.plain else None
        found = [True] * len(texts) if row else coder.encode(segments)
        if row:
            a, b = (np.array(ids, np.int64) for ids in row)
            ends = np.cumsum(np.array([len(s.encode()) for s in segments], np.int64))
            na, nb = (np.diff(np.searchsorted(np.cumsum(size), ends, "right"), prepend=0) for size in (coder.size_a[a], coder.size_b[b]))
        else:
            good = [f for f in found if f]
            a, b = (np.array([i for f in good for i in f[side]], np.int64) for side in (0, 1))
            na, nb = (np.array([len(f[side]) for f in good], np.int64) for side in (0, 1))
        p = multiply(a, coder.size_a[a], b, coder.size_b[b])
        tokens = np.concatenate(([0], np.cumsum(na)))
        bytes_at = np.concatenate(([0], np.cumsum(coder.size_a[a])))[tokens]
        groups = np.searchsorted(p.cuts, bytes_at, "right")
        links = p.overlap.starts[tokens]
        in_groups = np.concatenate(([0], np.cumsum(p.count_in_groups())))[tokens]
        numbers = list(map(tuple, np.stack((na, nb, np.diff(groups), np.diff(links), np.diff(in_groups)), 1).tolist()))
        pairs = a[p.overlap.rows] * _PAIR + b[p.overlap.columns]
        names, groups, links = p.spelled(), groups.tolist(), links.tolist()
        n = 0
        for text, ids in zip(texts, found):
            table[text] = len(self.spelled)
            if not ids:
                self.spelled.append(None)
                self.pairs.append(pairs[:0])
                self.numbers.append((0, 0, 0, 0, 0))
                continue
            self.spelled.append(";".join(names[groups[n] : groups[n + 1]]))
            self.pairs.append(pairs[links[n] : links[n + 1]].copy())
            self.numbers.append(numbers[n])
            n += 1

    def places(self, texts: list[str | None]) -> list[list[int]]:
        """Places of the segments of each text."""
        if len(self.plain) + len(self.rough) > self.limit:
            self.trim()
        plain = self.plain
        cut = [t.split(" ") if t else [] for t in texts]
        new = sorted(set(chain.from_iterable(cut)).difference(plain))
        plain.update((x, -1) for x in new)
        self._learn(list(filter(_plain, new)), plain)
        out = [list(map(plain.__getitem__, c)) for c in cut]
        loose = {n: [s[1:] for s in segments_of(texts[n])] for n, p in enumerate(out) if -1 in p}
        self._learn(sorted({s for c in loose.values() for s in c if s not in self.rough}), self.rough)
        for n, c in loose.items():
            out[n] = list(map(self.rough.__getitem__, c))
        return out


@dataclass
class Block:
    """A block's documents, with the segments they hold as places in the block's list; the list's
    segments with their linked pairs, as places in the list of pairs; the pairs with their counts."""

    rows: list[tuple]
    starts: np.ndarray
    local: np.ndarray
    pairs: np.ndarray
    totals: np.ndarray


def block(known: Segments, ids: list, texts: list[str | None]) -> Block:
    placed = known.places(texts)
    spelled = known.spelled
    digests = []
    for n, p in enumerate(placed):
        groups = list(map(spelled.__getitem__, p))
        whole = bool(groups) and None not in groups
        digests.append(hashlib.sha256(";".join(groups).encode()).hexdigest() if whole else "")
        if not whole:
            placed[n] = []
    many = np.array(list(map(len, placed)), np.int64)
    every = np.fromiter(chain.from_iterable(placed), np.int64, int(many.sum()))
    # Places are small numbers: those that occur are marked and numbered, not sorted.
    occurs = np.zeros(len(spelled), bool)
    occurs[every] = True
    used = np.flatnonzero(occurs)
    segment = (np.cumsum(occurs) - 1)[every]
    # Documents by segments: how often each has it.
    cell, times = np.unique(np.repeat(np.arange(len(placed)), many) * max(1, len(used)) + segment, return_counts=True)
    doc, at = np.divmod(cell, max(1, len(used)))
    numbers = np.array([known.numbers[s] for s in used.tolist()], np.int64).reshape(-1, 5)
    sums = np.zeros((len(placed), 5), np.int64)
    np.add.at(sums, doc, numbers[at] * times[:, None])
    own = [known.pairs[s] for s in used.tolist()]
    pairs, local = np.unique(np.concatenate(own) if own else np.empty(0, np.int64), return_inverse=True)
    sizes = np.array(list(map(len, own)), np.int64)
    per_segment = np.bincount(at, weights=times, minlength=len(used))
    known.used(used, per_segment.astype(np.int64))
    totals = np.bincount(local, weights=np.repeat(per_segment, sizes), minlength=len(pairs)).astype(np.int64)
    ends = np.searchsorted(doc, np.arange(len(placed) + 1)).tolist()
    at, times = at.astype("<i4"), times.astype("<i4")
    rows = [
        (i, *sums[n].tolist(), digests[n], at[ends[n] : ends[n + 1]].tobytes(), times[ends[n] : ends[n + 1]].tobytes()) for n, i in enumerate(ids)
    ]
    return Block(rows, np.concatenate(([0], np.cumsum(sizes))).astype("<i4"), local.astype("<i4"), pairs, totals)


_DOCS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_group_links long, groups_sha256 string"
_STORED = f"{_DOCS}, at binary, times binary, block string, starts binary, local binary, pair array<long>, total array<long>"
_STORED_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links", "n_group_links")), ("groups_sha256", pa.string()),
     ("at", pa.binary()), ("times", pa.binary()), ("block", pa.string()), ("starts", pa.binary()), ("local", pa.binary()),
     ("pair", pa.list_(pa.int64())), ("total", pa.list_(pa.int64()))]
)


def products(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Two kinds of rows: a row a document (``pair`` is null) and a row a block (``pair`` holds its distinct
    linked id pairs, A id * 2^32 + B id, and ``total`` their counts in the block)."""

    def run(batches):
        known = kept_in_worker(f"alignment:{path_a}:{path_b}", lambda: Segments(Tokenizers(path_a, path_b)))

        def made(ids, texts):
            got, name = block(known, ids, texts), [uuid.uuid4().hex]
            rows = [*map(list, zip(*got.rows)), name * len(ids), *[[None] * len(ids)] * 4]
            tail = [*[[None]] * 9, name, [got.starts.tobytes()], [got.local.tobytes()], [got.pairs], [got.totals]]
            for columns in (rows, tail):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _STORED_SCHEMA.types)], schema=_STORED_SCHEMA)

        ids, texts, held = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                ids.append(doc.as_py())
                texts.append(text.as_py())
                held += len(texts[-1] or "")
                if held > BLOCK_BYTES:
                    yield from made(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield from made(ids, texts)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _STORED)


def pair_counts(stored: DataFrame) -> DataFrame:
    """``id_a, id_b, count`` of all linked id pairs, with ``best``: no pair of its B id counts more."""
    each = stored.where("pair is not null").select(F.explode(F.arrays_zip("pair", "total")).alias("p"))
    counts = each.groupBy(F.col("p.pair").alias("pair")).agg(F.sum("p.total").alias("count"))
    id_b = F.col("pair").bitwiseAND(F.lit(_PAIR - 1))
    # The A ids of one B id are at most A's vocabulary.
    top = F.max("count").over(Window.partitionBy("id_b"))
    counts = counts.withColumn("id_b", id_b).withColumn("best", F.col("count") == top)
    return counts.select("pair", F.shiftright("pair", 32).alias("id_a"), "id_b", "count", "best")


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_group_links, groups_sha256, n_best, count_sum`` of every document.

    Texts that are null or empty, or that a tokenizer does not give back byte by byte behind a blank, have no tokens:
    zeros and an empty digest. Repeated rows are documents of their own.
    """
    stored = saved(products(docs, path_a, path_b), "products")
    counts = pair_counts(stored)
    asked = stored.where("pair is not null").select("block", F.posexplode("pair").alias("place", "pair"))
    told = asked.join(counts.select("pair", "count", "best"), "pair").select("block", "place", "count", "best")
    told = told.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "count", "best"))).alias("t"))
    told = told.select(F.col("block").alias("of"), F.col("t.count").alias("counts"), F.col("t.best").alias("bests"))
    rows = stored.drop("pair", "total")

    def settle(rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        table = rows["starts"].notna()
        docs = rows[~table].drop(columns=["block", "starts", "local"])
        starts, local = (np.frombuffer(rows.loc[table, c].iat[0], "<i4") for c in ("starts", "local"))
        n_best, sums = [np.zeros(len(docs), np.int64) for _ in range(2)]
        if len(told):
            count, best = np.array(told["counts"].iat[0], np.int64), np.array(told["bests"].iat[0], np.int64)
            whole = [np.concatenate(([0], np.cumsum(v[local])))[starts] for v in (best, count)]
            for n, (at, times) in enumerate(zip(docs["at"], docs["times"])):
                at, times = np.frombuffer(at, "<i4"), np.frombuffer(times, "<i4").astype(np.int64)
                n_best[n], sums[n] = (int((times * (w[at + 1] - w[at])).sum()) for w in whole)
        return docs.drop(columns=["at", "times"]).assign(n_best=n_best, count_sum=sums)

    both = rows.groupBy("block").cogroup(told.groupBy("of"))
    return both.applyInPandas(settle, f"{_DOCS}, n_best long, count_sum long")
