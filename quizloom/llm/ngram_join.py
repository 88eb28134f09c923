"""N-gram Jaccard join with signature trees.

Documents are sets of distinct word shingles; two link when their Jaccard similarity reaches a
limit. The result is exact.

1. *Routing.* Shingles have one order: a fixed share of the hash space first, there the rarest first. Two
   linked sets have so many shingles in common that they share one of their first few, their routing keys.
   Shingles of that share travel as six bytes each and are counted where equal ones meet; those of one document
   alone link nothing, and most documents have no others among their first.
2. *Families.* Connected components of documents that share a key hold every possible link. In a family beyond a
   tree's size, the hash space of a set is cut into more segments than two linked sets can differ in, so one segment
   that is not empty is equal in both; documents of the family that share a segment are a family of their own.
3. *Signature trees.* Each family is a tree: leaves are documents, inner nodes hold the OR of the
   token bitmaps below, the range of set sizes, and the fewest bits a link must share. A dual
   traversal drops pairs of nodes that cannot reach the overlap; what reaches the leaves is
   compared set against set, unless both are in one component already.

A family beyond a tree's size is cut into parts: parts are joined, then a spread of their members,
then every document outside the family's largest component with all parts, so no link is lost
while documents that are connected already are not compared again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, drop_kept_in_worker, saved, shuffle_width

#: Documents and shingles of one tree.
TREE_DOCS, TREE_SHINGLES = 8192, 4_000_000
#: Lists of ids up to this size are sent to the scan that reads their texts; larger ones are joined.
SENT_MEMBERS = 250_000

_FLUSH_KEYS = 2_000_000
#: Documents of a block: their places fill two bytes.
_BLOCK_DOCS = 60_000
_BLOCK = 1 << 20
_GROWTH = 1.3
_NO_CLASS = 255
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.int64).astype(_U)
_BASE = _U(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _one(x: int) -> np.uint64:
    return _mix(np.array([x & (2**64 - 1)], _U))[0]


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


def _word_hashes(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    space = _SPACE[b]
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.empty(0, _U)
    size = end - start
    inside = np.flatnonzero(~space)
    at = inside - np.repeat(start, size)
    first = np.cumsum(size) - size
    return _mix(np.add.reduceat(_BYTE[b[inside]] * _powers(int(size.max()))[at], first) + size.astype(_U))


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of a whole text, A-Z lower-cased."""
    raw = text.encode("utf-8", "surrogatepass").lower()
    if len(raw) <= _BLOCK:
        return _word_hashes(raw)
    words, parts, at = raw.split(), [], 0
    while at < len(words):  # a bounded run of words at a time
        parts.append(_word_hashes(b" ".join(words[at : at + 100_000])))
        at += 100_000
    return np.concatenate(parts) if parts else np.empty(0, _U)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a shorter text is one shingle, none without words."""
    w = word_hashes(text or "")
    if not len(w):
        return w
    size = min(words, len(w))
    n = len(w) - size + 1
    s = np.full(n, _one(size), _U)
    for i in range(size):
        s = _mix(s ^ w[i : i + n]) + _BASE
    return np.unique(s)


def _classes(percent: int) -> list[tuple[int, int]]:
    """(first size, segments) of the size classes."""
    firsts, out = [1], []
    while firsts[-1] < 1 << 40:
        firsts.append(max(firsts[-1] + 1, int(firsts[-1] * _GROWTH)))
    for lo, nxt in zip(firsts, firsts[1:]):
        differ = 2 * (nxt - 1) * (100 - percent) // (100 + percent)
        out.append((lo, differ + 2 + (differ + 1) // 12))
    return out


def _keys(s: np.ndarray, percent: int, firsts: np.ndarray, segments: list[int]) -> np.ndarray:
    """Routing keys of a set. Two sets of a link have an equal key: of the segments, at most
    ``differ`` differ and as many as the slack may be empty; a set with more empty segments also
    gets the hashes of its first shingles (one of which two such sets of a link share)."""
    n = len(s)
    c = int(np.searchsorted(firsts, n, "right")) - 1
    top = int(np.searchsorted(firsts, n * 100 // percent, "right")) - 1
    out, sparse = [], False
    for k in range(c, top + 1):
        count = segments[k]
        seg = s % _U(count)
        order = np.argsort(seg, kind="stable")
        seg = seg[order]
        cut = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
        total = np.add.reduceat(_mix(s[order] ^ _BASE), cut)
        out.append(_in_class(_mix(total ^ _mix(seg[cut] + _one(1000 + k))), k))
        upper = int(firsts[k + 1]) - 1
        slack = count - 1 - 2 * upper * (100 - percent) // (100 + percent)
        sparse |= count - len(cut) > slack
    if sparse:
        out.append(_in_class(_mix(s[: n - -(-percent * n // 100) + 1] + _one(7)), _NO_CLASS))
    return np.concatenate(out)


def _in_class(keys: np.ndarray, k: int) -> np.ndarray:
    """Keys whose last byte names the size class they compare."""
    return (keys & ~_U(255)) | _U(k)


_SCHEMA = "bucket int, doc_id long, n int, d1 long, d2 long, keys binary, nodes binary"
_RARE_SCHEMA = "bucket long, block long, doc_id long, n int, d1 long, d2 long, a binary, b binary, c binary"


def _digests(s: np.ndarray) -> tuple[np.uint64, np.uint64]:
    a = _mix(np.add.reduce(_mix(s + _one(11)))[None])
    return a[0], _mix(np.bitwise_xor.reduce(_mix(s ^ _one(13)))[None] + _U(len(s)))[0]


def _first_shingles(n: int, percent: int) -> int:
    """So many first shingles, in any common order, of two linked sets have one in common."""
    return n + percent * n // -100 + 1


def _counted_range(percent: int) -> int:
    """Upper 32 bits below this: the share of the shingles that are counted. It is more than twice that of the first ones."""
    return min(1 << 32, (1 << 32) * (2 * (100 - percent) + 5) // 100)


def _rare(words: int, percent: int, buckets: int):
    """Tasks one after the other: shingles by bucket; those of more than one document back to their block of
    documents; the keys of a block by bucket; links (d1, d2, n = -1) where documents share a key. Rows of documents pass."""
    space, types = _counted_range(percent), [pa.int64()] * 3 + [pa.int32(), pa.int64(), pa.int64()] + [pa.binary()] * 3
    names = ["bucket", "block", "doc_id", "n", "d1", "d2", "a", "b", "c"]

    def rows(bucket, **columns):
        k = len(bucket)
        cols = [pa.array(columns[c], t) if c in columns else pa.nulls(k, t) for c, t in zip(names[1:], types[1:])]
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), *cols], names=names)

    def links(nodes, firsts):
        a, b = np.unique(np.stack((nodes, firsts)), axis=1) if len(nodes) else (nodes, firsts)
        return rows((_mix(a) % _U(buckets)).astype(np.int64), n=np.full(len(a), -1, np.int32), d1=a.view(np.int64), d2=b.view(np.int64))

    def spans(sorted_values):
        cut = np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))
        return cut, list(zip(cut.tolist(), [*cut[1:].tolist(), len(sorted_values)]))

    def stars(keys, nodes):
        """Equal keys once, with their first node, and the links of the others with it."""
        order = np.lexsort((nodes, keys))
        keys, nodes = keys[order], nodes[order]
        head = np.ones(len(keys), bool)
        head[1:] = keys[1:] != keys[:-1]
        first = nodes[head][np.cumsum(head) - 1]
        return keys[head], nodes[head], nodes[nodes != first], first[nodes != first]

    def block_rows(block, sets):
        """Tokens of the counted share by bucket, and what the block needs to choose its keys."""
        size = np.array([len(s) for s in sets])
        token = _mix(np.concatenate(sets) ^ _one(17))
        at = np.repeat(np.arange(len(sets)), size)
        upper = token >> _U(32)
        one = upper < _U(space)
        counted = np.bincount(at[one], minlength=len(sets))
        first = np.array([_first_shingles(n, percent) for n in size.tolist()])
        # What a document lacks in the counted share are the smallest of its other tokens.
        lacks = (first > counted)[at] & ~one
        more, more_at = token[lacks], at[lacks]
        order = np.lexsort((more, more_at))
        more, more_at = more[order], more_at[order]
        keep = np.arange(len(more)) - np.searchsorted(more_at, more_at) < (first - counted)[more_at]
        d1 = np.array([_digests(s)[0] for s in sets], _U)
        extra = np.stack((more[keep], d1[more_at[keep]]))
        table = np.stack((first, counted)).astype(np.int32)
        yield rows([-1 - block], block=[block], a=[d1.tobytes()], b=[table.tobytes()], c=[extra.tobytes()])
        token, at = token[one], at[one].astype(np.uint16)
        if len(token):
            bucket = ((token >> _U(32)) % _U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, low, at = bucket[order], token[order].astype(np.uint32), at[order]
            cut, ends = spans(bucket)
            yield rows(bucket[cut], block=np.full(len(cut), block), a=[at[i:j].tobytes() for i, j in ends], b=[low[i:j].tobytes() for i, j in ends])

    def tokens(batches):
        from pyspark import TaskContext

        drop_kept_in_worker()
        # The same block has the same number if the task is run again.
        block, sets, held = TaskContext.get().partitionId() << 32, {}, 0
        for batch in batches:
            ids, size, d1, d2 = batch.column(0), [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, words)
                a, b = _digests(s) if len(s) else (_U(0), _U(0))
                size.append(len(s))
                d1.append(int(a.view(np.int64)))
                d2.append(int(b.view(np.int64)))
                if len(s) and int(a) not in sets:  # copies of a block are one set
                    sets[int(a)] = s
                    held += len(s)
                if held >= _FLUSH_KEYS or len(sets) >= _BLOCK_DOCS:
                    yield from block_rows(block, list(sets.values()))
                    block, sets, held = block + 1, {}, 0
            spread = (np.array(d1, np.int64).view(_U) % _U(buckets)).astype(np.int64) if d1 else []
            yield rows(spread, block=spread, doc_id=ids, n=size, d1=d1, d2=d2)
        if sets:
            yield from block_rows(block, list(sets.values()))

    def groups(batches, key):
        """Rows of documents and links pass as they are; the others are handed on by bucket or block, whose rows are neighbours."""
        now, held = None, []
        for batch in batches:
            plain = batch.filter(batch.column("n").is_valid())
            if plain.num_rows:
                yield None, plain
            full = batch.filter(batch.column("n").is_null())
            for row in zip(*(full.column(c).to_pylist() for c in (key, "bucket", "block", "a", "b", "c"))):
                if row[0] != now and held:
                    yield now, held
                    held = []
                now = row[0]
                held.append(row[1:])
        if held:
            yield now, held

    def counts(batches):
        for bucket, got in groups(batches, "bucket"):
            if bucket is None:
                yield got
            elif bucket < 0:  # the table of a block
                yield rows([bucket], block=[got[0][1]], a=[got[0][2]], b=[got[0][3]], c=[got[0][4]])
            else:
                low = np.frombuffer(b"".join(r[3] for r in got), np.uint32)
                row = np.repeat(np.arange(len(got)), [len(r[2]) // 2 for r in got])
                at = np.frombuffer(b"".join(r[2] for r in got), np.uint16)
                _, number, times = np.unique(low, return_inverse=True, return_counts=True)
                times = np.minimum(times[number], 65535).astype(np.uint16)
                many = times > 1
                low, row, at, times = low[many], row[many], at[many], times[many]
                if len(row):
                    cut, ends = spans(row)
                    yield rows(
                        np.full(len(cut), bucket), block=[got[r][1] for r in row[cut]],
                        a=[at[i:j].tobytes() for i, j in ends], b=[low[i:j].tobytes() for i, j in ends], c=[times[i:j].tobytes() for i, j in ends],
                    )

    def keys(batches):
        for block, got in groups(batches, "block"):
            if block is None:
                yield got
                continue
            head = next(r for r in got if r[0] < 0)
            got = [r for r in got if r[0] >= 0]
            d1, (first, counted) = np.frombuffer(head[2], _U), np.frombuffer(head[3], np.int32).reshape(2, -1).astype(np.int64)
            more, more_node = np.frombuffer(head[4], _U).reshape(2, -1)
            at, low, times = (np.frombuffer(b"".join(r[c] for r in got), t) for c, t in ((2, np.uint16), (3, np.uint32), (4, np.uint16)))
            bucket = np.repeat(np.array([r[0] for r in got], _U), [len(r[2]) // 2 for r in got])
            many = np.bincount(at, minlength=len(d1))
            left = np.minimum(first, counted) - (counted - many)  # the others are in one document alone
            some = left[at] > 0
            at, times, token = at[some].astype(np.int64), times[some], (bucket[some] << _U(32)) | low[some]
            order = np.lexsort((token, times, at))
            at, token = at[order], token[order]
            keep = np.arange(len(at)) - np.searchsorted(at, at) < left[at]
            key = np.concatenate((_mix(token[keep] ^ _one(19)), _mix(more ^ _one(23))))
            key, node, late, early = stars(key, np.concatenate((d1[at[keep]], more_node)))
            if len(late):
                yield links(late, early)
            if len(key):
                to = ((key >> _U(8)) % _U(buckets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                to, key, node = to[order], key[order], node[order]
                cut, ends = spans(to)
                yield rows(to[cut], a=[key[i:j].tobytes() for i, j in ends], b=[node[i:j].tobytes() for i, j in ends])

    def met(batches):
        for bucket, got in groups(batches, "bucket"):
            if bucket is None:
                yield got
            else:
                _, _, late, early = stars(*(np.frombuffer(b"".join(r[c] for r in got), _U) for c in (2, 3)))
                if len(late):
                    yield links(late, early)

    return tokens, counts, keys, met


def _routed(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``doc_id``, ``n``, ``d1``, ``d2`` of the documents, and the links of routing (``n`` is -1)."""
    width = shuffle_width(docs.sparkSession)
    tokens, counts, keys, met = _rare(words, percent, width * 8)
    out = docs.mapInArrow(tokens, _RARE_SCHEMA)
    for by, step in (("bucket", counts), ("block", keys), ("bucket", met)):
        out = out.repartition(width, by).sortWithinPartitions(by).mapInArrow(step, _RARE_SCHEMA)
    return saved(out.select("doc_id", "n", "d1", "d2"), "routed")


def _route(words: int, percent: int, buckets: int):
    """Task: per document its size and digests; per bucket one (key, node) a distinct key;
    a link (d1, d2, n = -1 less the size class) where two documents of the task share a key."""
    table = _classes(percent)
    firsts, segments = np.array([x[0] for x in table]), [x[1] for x in table]

    def stars(keys, nodes):
        order = np.lexsort((nodes, keys))
        keys, nodes = keys[order], nodes[order]
        head = np.concatenate(([True], keys[1:] != keys[:-1]))
        first = nodes[head][np.cumsum(head) - 1]
        link = nodes != first
        ends = np.stack((nodes[link], first[link], keys[link] & _U(255)))
        pairs = np.unique(ends, axis=1) if link.any() else np.empty((3, 0), _U)
        return keys[head], nodes[head], pairs

    def rows(bucket, doc=None, n=None, d1=None, d2=None, keys=None, nodes=None):
        k = len(bucket)
        none = lambda t: pa.nulls(k, t)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(bucket, pa.int32()),
                none(pa.int64()) if doc is None else pa.array(doc, pa.int64()),
                none(pa.int32()) if n is None else pa.array(n, pa.int32()),
                none(pa.int64()) if d1 is None else pa.array(d1, pa.int64()),
                none(pa.int64()) if d2 is None else pa.array(d2, pa.int64()),
                none(pa.binary()) if keys is None else pa.array(keys, pa.binary()),
                none(pa.binary()) if nodes is None else pa.array(nodes, pa.binary()),
            ],
            names=["bucket", "doc_id", "n", "d1", "d2", "keys", "nodes"],
        )

    def links(pairs):
        at = (_mix(pairs[0]) % _U(buckets)).astype(np.int32)
        return rows(at, n=-1 - pairs[2].astype(np.int32), d1=pairs[0].view(np.int64), d2=pairs[1].view(np.int64))

    def flush(keys, nodes):
        keys, nodes, pairs = stars(np.concatenate(keys), np.concatenate(nodes))
        if pairs.shape[1]:
            yield links(pairs)
        at = ((keys >> _U(8)) % _U(buckets)).astype(np.int32)
        order = np.argsort(at, kind="stable")
        at, keys, nodes = at[order], keys[order], nodes[order]
        cut = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        ends = [*cut[1:].tolist(), len(at)]
        spans = list(zip(cut.tolist(), ends))
        yield rows(at[cut], keys=[keys[i:j].tobytes() for i, j in spans], nodes=[nodes[i:j].tobytes() for i, j in spans])

    def first_half(batches):
        drop_kept_in_worker()
        keys, nodes, held = [], [], 0
        for batch in batches:
            ids, size, d1, d2 = batch.column(0), [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, words)
                size.append(len(s))
                if not len(s):
                    d1.append(0)
                    d2.append(0)
                    continue
                a, b = _digests(s)
                d1.append(int(a.view(np.int64)))
                d2.append(int(b.view(np.int64)))
                own = _keys(s, percent, firsts, segments)
                keys.append(own)
                nodes.append(np.full(len(own), a, _U))
                held += len(own)
                if held >= _FLUSH_KEYS:
                    yield from flush(keys, nodes)
                    keys, nodes, held = [], [], 0
            spread = np.array(d1, np.int64).view(_U) % _U(buckets) if d1 else []
            yield rows(np.asarray(spread, np.int32), ids, size, d1, d2)
        if held:
            yield from flush(keys, nodes)

    def second_half(batches):
        def meet(keys, nodes):
            _, _, pairs = stars(np.frombuffer(b"".join(keys), _U), np.frombuffer(b"".join(nodes), _U))
            if pairs.shape[1]:
                yield links(pairs)

        now, keys, nodes = None, [], []
        for batch in batches:
            plain = batch.filter(batch.column("n").is_valid())
            if plain.num_rows:
                yield plain
            full = batch.filter(batch.column("keys").is_valid())
            for at, k, v in zip(*(full.column(c).to_pylist() for c in ("bucket", "keys", "nodes"))):
                if at != now and keys:
                    yield from meet(keys, nodes)
                    keys, nodes = [], []
                now = at
                keys.append(k)
                nodes.append(v)
        if keys:
            yield from meet(keys, nodes)

    return first_half, second_half


class SignatureTree:
    """Leaves are sets in order of size and first hash; ``fanout`` nodes make the next level's node."""

    def __init__(self, sets: list[np.ndarray], percent: int, fanout: int = 8):
        self.percent, self.fanout = percent, fanout
        size = np.array([len(s) for s in sets])
        self.order = np.lexsort(([int(s[0]) for s in sets], size))
        self.sets = [sets[i] for i in self.order]
        bits = 256
        while bits < 4 * int(size.max()) and bits < 1 << 16:
            bits *= 2
        maps = np.zeros((len(sets), bits // 8), np.uint8)
        for row, s in zip(maps, self.sets):
            on = np.zeros(bits, bool)
            on[(s >> _U(17)) % _U(bits)] = True
            row[:] = np.packbits(on)
        maps = maps.view(_U)
        size = size[self.order]
        filled = np.bitwise_count(maps).sum(1).astype(np.int64)
        need = filled - size * (100 - percent) // 100
        self.size, self.filled = size, filled
        self.levels = [(maps, size, size, need)]
        while len(self.levels[-1][0]) > fanout:
            maps, lo, hi, need = self.levels[-1]
            cut = np.arange(0, len(maps), fanout)
            self.levels.append(
                (
                    np.bitwise_or.reduceat(maps, cut),
                    np.minimum.reduceat(lo, cut),
                    np.maximum.reduceat(hi, cut),
                    np.minimum.reduceat(need, cut),
                )
            )

    def _possible(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        maps, lo, hi, need = self.levels[level]
        p = self.percent
        ok = (hi[i] * 100 >= lo[j] * p) & (hi[j] * 100 >= lo[i] * p)
        if level == 0:  # the overlap that these two sizes need
            a, b = self.size[i], self.size[j]
            least = -(-p * (a + b) // (100 + p))
            need_ij = np.maximum(self.filled[i] - a, self.filled[j] - b) + least
        else:
            need_ij = np.maximum(need[i], need[j])
        for at in range(0, len(i), 4096):
            part = slice(at, at + 4096)
            live = np.flatnonzero(ok[part]) + at
            if len(live):
                shared = np.bitwise_count(maps[i[live]] & maps[j[live]]).sum(1)
                ok[live] = shared >= need_ij[live]
        return ok

    def _below(self, level: int, i: np.ndarray, j: np.ndarray):
        f, n = self.fanout, len(self.levels[level - 1][0])
        ci = np.repeat(i * f, f * f) + np.tile(np.repeat(np.arange(f), f), len(i))
        cj = np.repeat(j * f, f * f) + np.tile(np.tile(np.arange(f), f), len(i))
        ok = (ci < n) & (cj < n) & (ci <= cj)
        return ci[ok], cj[ok]

    def linked(self, i: int, j: int) -> bool:
        a, b = self.sets[i], self.sets[j]
        both = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * both >= self.percent * (len(a) + len(b) - both)

    def join(self, root: np.ndarray, allowed=None):
        """Unite ``root`` (of the leaves in tree order) over all links; ``allowed(i, j)`` keeps pairs."""

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        top, merged = np.array(root), [True]

        def leaves(i, j):
            keep = i != j
            if allowed is not None:
                keep &= allowed(i, j)
            i, j = i[keep], j[keep]
            for at in range(0, len(i), 4096):
                if merged[0]:  # the components as they are now
                    top[:] = [find(x) for x in range(len(root))]
                    merged[0] = False
                bi, bj = i[at : at + 4096], j[at : at + 4096]
                apart = top[bi] != top[bj]
                bi, bj = bi[apart], bj[apart]
                ok = self._possible(0, bi, bj)
                for x, y in zip(bi[ok].tolist(), bj[ok].tolist()):
                    a, b = find(x), find(y)
                    if a != b and self.linked(x, y):
                        root[max(a, b)] = min(a, b)
                        merged[0] = True

        n = len(self.sets)
        if n > 64:  # neighbours in the order first: most later pairs are then in one component
            leaves(np.arange(n - 1), np.arange(1, n))
        highest = len(self.levels) - 1
        ends = np.arange(len(self.levels[highest][0]))
        i, j = (x.ravel() for x in np.meshgrid(ends, ends, indexing="ij"))
        stack = [(highest, i[i <= j], j[i <= j])]
        while stack:
            level, i, j = stack.pop()
            if level == 0:
                leaves(i, j)
                continue
            ok = self._possible(level, i, j)
            i, j = i[ok], j[ok]
            for at in range(0, len(i), 1024):
                stack.append((level - 1, *self._below(level, i[at : at + 1024], j[at : at + 1024])))
        for x in range(n):
            root[x] = find(x)


def _trees(words: int, percent: int):
    """Task: rows sorted by group; per group (component, smallest component it is linked with)."""

    def solve(ids, comps, sides, texts):
        sets = [shingle_set(t, words) for t in texts]
        keep = [x for x, s in enumerate(sets) if len(s)]
        if len(keep) < 2:
            return []
        tree = SignatureTree([sets[x] for x in keep], percent)
        at = [keep[x] for x in tree.order]
        comp = [comps[x] for x in at]
        first, root = {}, np.empty(len(at), np.int64)
        for x, c in enumerate(comp):
            root[x] = first.setdefault(c, x)
        side = np.array([sides[x] for x in at])
        tree.join(root, (lambda i, j: side[i] != side[j]) if side.any() else None)
        least: dict[int, int] = {}
        for c, r in zip(comp, root.tolist()):
            least[r] = min(c, least.get(r, c))
        return [(c, least[r]) for c, r in zip(comp, root.tolist()) if c != least[r]]

    def run(batches):
        now, rows = None, []

        def done():
            pairs = set(solve(*zip(*rows))) if len(rows) > 1 else ()
            if pairs:
                a, b = zip(*pairs)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("grp", "doc_id", "comp", "side", "text")]
            for g, *row in zip(*cols):
                if g != now:
                    yield from done()
                    now, rows = g, []
                rows.append(row)
        yield from done()

    return run


def _merges(docs: DataFrame, members: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between components, found by the trees of ``members`` (grp, doc_id, comp, side)."""
    spark = docs.sparkSession
    if members.count() <= SENT_MEMBERS:
        members = F.broadcast(members)
    rows = docs.join(members, "doc_id").select("grp", "doc_id", "comp", "side", "text")
    rows = rows.repartition(shuffle_width(spark), "grp").sortWithinPartitions("grp")
    return saved(rows.mapInArrow(_trees(words, percent), "a long, b long"), "merges")


def _relabel(members: DataFrame, merges: DataFrame) -> DataFrame:
    found = components(merges).select(F.col("node").alias("comp"), F.col("comp").alias("_to"))
    return members.join(found, "comp", "left").withColumn("comp", F.coalesce("_to", "comp")).drop("_to")


def _parts(weights: DataFrame) -> DataFrame:
    """Number of tree-sized parts of each family."""
    n = F.greatest(F.ceil(F.col("docs") / TREE_DOCS), F.ceil(F.col("size") / TREE_SHINGLES))
    return weights.select("family", n.cast("long").alias("parts"))


def ngram_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, percent: int = 90) -> DataFrame:
    """Per document: ``doc_id``, ``n_shingles``, ``component_id``.

    A text is lower-cased (A-Z) and split at ASCII white space. Linked: 100 * intersection >=
    percent * union. ``component_id`` is the smallest id reachable by links. A null or blank text
    has no shingles and links with nothing; equal texts link; a row without an id keeps its
    size and gets the component of its copies, if any; other columns of ``df`` are ignored. Copies
    are one node, so they are never expanded into pairs.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    routed = _routed(docs, words, percent)
    sized = routed.where("n >= 0")
    classes = saved(
        sized.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep")), "classes"
    )
    families = components(routed.where("n < 0").select(F.col("d1").alias("a"), F.col("d2").alias("b")))
    families = families.select(F.col("node").alias("d1"), F.col("comp").alias("family"))
    members = saved(
        classes.where("rep is not null").join(families, "d1").select("family", F.col("rep").alias("doc_id"), "n").distinct(),
        "members",
    )
    members = _by_segments(docs, members, words, percent)
    weights = members.groupBy("family").agg(F.count("*").alias("docs"), F.sum("n").alias("size"))
    parts = saved(_parts(weights.where("docs > 1")), "parts")
    placed = (
        members.join(parts, "family")
        .withColumn("part", F.pmod(F.xxhash64("doc_id"), "parts"))
        .withColumn("comp", F.col("doc_id"))
    )
    one = placed.select(F.xxhash64("family", "part").alias("grp"), "doc_id", "comp", F.lit(0).alias("side"))
    merges = _merges(docs, saved(one, "placed"), words, percent)
    if parts.where("parts > 1").head(1):
        merges = _across_parts(docs, saved(placed.where("parts > 1"), "placed"), merges, words, percent)
    comps = components(merges).select(F.col("node").alias("rep"), F.col("comp").alias("component"))
    classes = classes.join(comps, "rep", "left").select(
        "n", "d1", "d2", F.coalesce("component", "rep").alias("component_id")
    )
    empty = sized.where("n = 0").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return (
        sized.where("n > 0")
        .join(classes, ["n", "d1", "d2"])
        .select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
        .unionByName(empty)
    )


def _by_segments(docs: DataFrame, members: DataFrame, words: int, percent: int) -> DataFrame:
    """``members`` (family, doc_id, n) with families beyond a tree's size told apart by the segments their documents share."""
    sizes = members.groupBy("family").agg(F.count("*").alias("docs"), F.sum("n").alias("size"))
    large = saved(_parts(sizes).where("parts > 1").select("family"), "large")
    if not large.head(1):
        return members
    inside = saved(members.join(large, "family", "left_semi"), "large")
    ids = inside.select("doc_id")
    if inside.count() <= SENT_MEMBERS:
        ids = F.broadcast(ids)
    width = shuffle_width(docs.sparkSession)
    first, second = _route(words, percent, width * 8)
    routed = docs.join(ids, "doc_id", "left_semi").mapInArrow(first, _SCHEMA).repartition(width, "bucket").sortWithinPartitions("bucket")
    routed = saved(routed.mapInArrow(second, _SCHEMA).select("doc_id", "n", "d1", "d2"), "routed")
    # A document is a node of each size class it is compared in, so families do not chain through sizes.
    in_class = lambda d: F.xxhash64(d, "n")
    keyed = routed.where("n < 0")
    found = components(keyed.select(in_class("d1").alias("a"), in_class("d2").alias("b")))
    nodes = keyed.select("d1", "n").unionByName(keyed.select(F.col("d2").alias("d1"), "n")).distinct()
    found = nodes.select("d1", in_class("d1").alias("node")).join(found, "node").select("d1", "comp")
    finer = routed.where("n > 0").select("doc_id", "d1").join(found, "d1").select("doc_id", "comp").distinct()
    finer = inside.join(finer, "doc_id").select(F.xxhash64("family", "comp").alias("family"), "doc_id", "n")
    return saved(members.join(large, "family", "left_anti").unionByName(finer).distinct(), "members")


def _across_parts(docs: DataFrame, big: DataFrame, merges: DataFrame, words: int, percent: int) -> DataFrame:
    """``merges`` with the links between the parts of large families."""
    found = saved(_relabel(big, merges), "placed")
    # A spread of members from all parts connects the large components with each other.
    some = found.where((F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(16)) == 0) | (F.col("comp") == F.col("doc_id")))
    few = _parts(some.groupBy("family").agg(F.count("*").alias("docs"), F.sum("n").alias("size"))).withColumnRenamed("parts", "few")
    some = some.join(few, "family").select(
        F.xxhash64("family", F.lit(-1), F.pmod(F.xxhash64("doc_id"), "few")).alias("grp"), "doc_id", "comp", F.lit(0).alias("side")
    )
    more = _merges(docs, saved(some, "spread"), words, percent)
    found = saved(_relabel(found, more), "placed")
    # Now only documents outside the largest component of their family can add links.
    sizes = found.groupBy("family", "comp").agg(F.count("*").alias("docs"))
    main = sizes.groupBy("family").agg(F.max(F.struct("docs", "comp")).alias("top")).select("family", F.col("top.comp").alias("main"))
    found = found.join(main, "family")
    rest = found.where("comp <> main")
    rest_parts = _parts(rest.groupBy("family").agg(F.count("*").alias("docs"), F.sum("n").alias("size"))).withColumnRenamed("parts", "rest_parts")
    tile = F.xxhash64("family", F.lit(-2), "i", "j").alias("grp")
    left = (
        rest.join(rest_parts, "family")
        .withColumn("i", F.pmod(F.xxhash64("doc_id", F.lit(9)), "rest_parts"))
        .withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        .select(tile, "doc_id", "comp", F.lit(1).alias("side"))
    )
    right = (
        found.join(rest_parts, "family")
        .withColumn("j", F.col("part"))
        .withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rest_parts") - 1)))
        .select(tile, "doc_id", "comp", F.lit(0).alias("side"))
    )
    last = _merges(docs, saved(left.unionByName(right), "tiles"), words, percent)
    return merges.unionByName(more).unionByName(last)


def one_per_group(df: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``df`` whose document is the first of its group (all rows without an id)."""
    groups = ngram_join(df, words=words, percent=percent)
    gone = saved(groups.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    if gone.count() <= SENT_MEMBERS:
        gone = F.broadcast(gone)
    return df.join(gone, "doc_id", "left_anti")
