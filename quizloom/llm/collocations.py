"""Phrase collocations by Toivonen's sampling method.

A sample of the documents proposes phrases that may be frequent. One pass over all documents then counts
every word and every phrase whose two parts (all words but the last, all but the first) were proposed: that is
the proposal with its negative border, the phrases outside of it whose parts lie inside. A
border phrase that turns out frequent was missed by the sample: it joins the proposal, and a second pass counts only
what the grown border adds. There a phrase that the first pass did not count is taken for proposed, so its extensions are counted at
once: a phrase cannot be more frequent than its parts, and each part of a frequent one was either counted in the first pass, and so is
proposed by now, or is new in the second. Two passes thus always find all.

These passes count 64-bit hashes of phrases, which tasks exchange as blocks of numbers: two phrases of one hash can only look
too frequent. A last pass spells the phrases that reached the count and counts them exactly.
The proposal is kept as a Bloom filter of bounded size. What it takes for proposed by mistake is counted like
the rest; a filter that fills up prunes less and loses nothing.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, shuffle_width

LONGEST = 4
LEAST_COUNT = 30
#: One document of so many (by a hash of its id) is in the sample.
SAMPLE_PART = 8
#: Share of the count expected in the sample that is enough to be proposed.
CAUTION = 0.6
#: Bits of the filter: about 16 for each proposed phrase, between these bounds.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28
TOP = 2000

#: Words after which a task passes its counts on.
_FLUSH = 1_500_000
_BREAK = b"\xff"
_SCHEMA = "lang string, words int, phrase string, n long"
_ARROW = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())])


def _folded() -> bytes:
    """Lower case for A-Z, a blank for a tab, the break for what ends a piece."""
    table = bytearray(range(256))
    for c in range(65, 91):
        table[c] = c + 32
    table[9] = 32
    for c in b".,;:!?\n\x0b\x0c\r":
        table[c] = _BREAK[0]
    return bytes(table)


_FOLDED = _folded()


def tokens(text: bytes) -> list[bytes]:
    """Words of a text in UTF-8, with ``_BREAK`` (no byte of UTF-8) between pieces."""
    return text.translate(_FOLDED).replace(_BREAK, b" \xff ").split()


class _Words(dict):
    """Numbers of the words of a part of a task; the break is -1."""

    def __init__(self):
        super().__init__({_BREAK: -1})
        self.list: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self.list)
        self.list.append(word)
        return at


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _known(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the filter holds both bits of each hash."""
    out = np.ones(len(h), bool)
    for at in (h, h >> np.uint64(32)):
        at = at & np.uint64(64 * len(bits) - 1)
        out &= (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return out


def _grouped(columns: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """First places and counts of equal rows; a row is packed exactly into one number."""
    code, most = columns[0].astype(np.int64), width
    for column in columns[1:]:
        if most * width >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
            most = len(code)
        code, most = code * width + column, most * width
    _, first, counts = np.unique(code, return_index=True, return_counts=True)
    return first, counts


def _levels(ids: np.ndarray, h: np.ndarray, bits: np.ndarray | None, old: np.ndarray | None = None):
    """For each number of words: places where such a phrase is proposed or on the border, and
    the phrases' hashes there. Without a filter every phrase counts. ``ids`` is -1 at breaks.

    With an ``old`` filter only places that it did not reach are given, and phrases there are taken for proposed."""
    before = _levels(ids, h, old) if old is not None else None
    inside = ids >= 0
    held = inside if bits is None else inside & _known(bits, h)
    if before is None:
        yield 1, np.flatnonzero(inside), h[inside]
    else:
        next(before)  # all words were counted
        yield 1, np.empty(0, np.int64), h[:0]
    whole = h
    for words in range(2, LONGEST + 1):
        at = np.flatnonzero(held[:-1] & held[1:])
        # The hash of the phrase without its last word stands at its place in ``whole``.
        longer = _mixed(whole[at] * np.uint64(0xD6E8FEB86659FD93) + h[at + words - 1])
        new = np.ones(len(at), bool)
        if before is not None:
            seen = np.zeros(len(ids), bool)
            seen[next(before)[1]] = True
            new = ~seen[at]
        yield words, at[new], longer[new]
        whole = np.zeros(len(h), np.uint64)
        whole[at] = longer
        held = np.zeros(len(ids), bool)
        held[at] = True if bits is None else _known(bits, longer) | (new if before is not None else False)


def _parts(batches):
    """Texts (``lang``, ``text``) as arrays of numbered words, by language, about ``_FLUSH`` words at a time."""
    words, held, size = _Words(), {}, 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), pc.cast(batch.column(1), pa.binary())):
            found = tokens(text.as_py() or b"")
            found.append(_BREAK)
            held.setdefault(lang, []).append(np.fromiter(map(words.__getitem__, found), np.int32, len(found)))
            size += len(found)
            if size >= _FLUSH:
                yield words.list, {k: np.concatenate(v) for k, v in held.items()}
                words, held, size = _Words(), {}, 0
    if size:
        yield words.list, {k: np.concatenate(v) for k, v in held.items()}


def _hashed(words: list[bytes], lang: str, ids: np.ndarray) -> np.ndarray:
    """Hash of each place's word in its language (0 at breaks)."""
    seed = xxhash.xxh64_intdigest(lang.encode(errors="replace")) & 0xFFFFFFFF
    table = np.zeros(len(words) + 1, np.uint64)
    used = np.flatnonzero(np.bincount(ids[ids >= 0], minlength=len(words)))
    table[used] = np.array([xxhash.xxh64_intdigest(words[i], seed) for i in used.tolist()], np.uint64)
    return table[ids]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def _bits(hashes: DataFrame, size: int) -> np.ndarray:
    """Filter of ``size`` bits that holds the column ``hash``: Spark joins the bits of each 64-bit word, at most ``size`` / 64 rows."""
    ends = F.array(*[h.bitwiseAND(F.lit(size - 1)) for h in (F.col("hash"), F.shiftrightunsigned("hash", 32))])
    each = hashes.select(F.explode(ends).alias("bit"))
    one = F.expr("shiftleft(1L, int(bit & 63))")
    table = each.groupBy(F.shiftright("bit", 6).cast("int").alias("at")).agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    if table.num_rows:
        out[table["at"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    return out


def _size(phrases: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, 1 << (16 * phrases).bit_length()))


def _packed(bits: np.ndarray | None) -> bytes | None:
    return None if bits is None else zlib.compress(bits.tobytes(), 1)


def _unpacked(data: bytes | None) -> np.ndarray | None:
    return None if data is None else np.frombuffer(zlib.decompress(data), np.uint64)


_BLOCK = pa.schema([("part", pa.int32()), ("inner", pa.bool_()), ("hashes", pa.binary()), ("counts", pa.binary())])


def _summed(hashes: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    h, which = np.unique(np.frombuffer(b"".join(hashes), np.uint64), return_inverse=True)
    n = np.bincount(which, weights=np.frombuffer(b"".join(counts), np.int64), minlength=len(h))
    return h, n.astype(np.int64)


def _counted(docs: DataFrame, new: np.ndarray | None, old: np.ndarray | None, least: int, longest: int = LONGEST) -> DataFrame:
    """Hashes of phrases with a count of ``least`` or more (``hash``, ``inner``: short enough to be part of another), of
    words and of what ``new`` proposes with its border (all phrases, if it is none); if there is an ``old`` proposal, only of phrases that it did not count."""
    spark = docs.sparkSession
    sent, parts = spark.sparkContext.broadcast((_packed(new), _packed(old))), shuffle_width(spark)

    def count(batches):
        new, old = map(_unpacked, sent.value)
        for words, held in _parts(batches):
            found = {True: [], False: []}
            for lang, ids in held.items():
                h = _hashed(words, lang, ids)
                for n, _, hashes in itertools.islice(_levels(ids, h, new, old), longest):
                    found[n < LONGEST].append(hashes)
            for inner, lists in found.items():
                if not lists:
                    continue
                h, n = np.unique(np.concatenate(lists), return_counts=True)
                # Hashes are in order, so a part of their range is a slice.
                cuts = np.searchsorted(h, np.arange(1, parts, dtype=np.uint64) * np.uint64((1 << 64) // parts)).tolist()
                spans = [(p, i, j) for p, (i, j) in enumerate(zip([0, *cuts], [*cuts, len(h)])) if i < j]
                columns = [[p for p, _, _ in spans], [inner] * len(spans), [h[i:j].tobytes() for _, i, j in spans], [n[i:j].astype(np.int64).tobytes() for _, i, j in spans]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _BLOCK.types)], schema=_BLOCK)

    def add(batches):
        """A task has whole parts of the range, so it sees every count of its hashes."""
        held: dict[tuple, list] = {}
        for batch in batches:
            for part, inner, h, n in zip(*(c.to_pylist() for c in batch.columns)):
                h_list, n_list = held.setdefault((part, inner), [[], []])
                h_list.append(h)
                n_list.append(n)
                if sum(map(len, h_list)) > 1 << 25:
                    held[part, inner] = [[x.tobytes()] for x in _summed(h_list, n_list)]
        for (_, inner), lists in held.items():
            h, n = _summed(*lists)
            h = h[n >= least]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), inner))], names=["hash", "inner"])

    blocks = _texts(docs).mapInArrow(count, "part int, inner boolean, hashes binary, counts binary")
    out = saved(blocks.repartition(parts, "part").mapInArrow(add, "hash long, inner boolean"), "frequent")
    sent.destroy()
    return out


def _proposal(docs: DataFrame, least: int) -> np.ndarray:
    """Phrases short enough to be part of another that are frequent in the sample."""
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE_PART)) == 0)
    proposed = _counted(sample, None, None, max(1, int(least / SAMPLE_PART * CAUTION)), LONGEST - 1).select("hash")
    return _bits(proposed, _size(proposed.count()))


def _missed(frequent: DataFrame, bits: np.ndarray) -> np.ndarray | None:
    """The filter of frequent phrases outside of the proposal; None if there are none."""
    sent = frequent.sparkSession.sparkContext.broadcast(_packed(bits))

    def outside(batches):
        held = _unpacked(sent.value)
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(h[~_known(held, h.view(np.uint64))])], names=["hash"])

    found = _bits(frequent.where("inner").select("hash").mapInArrow(outside, "hash long"), 64 * len(bits))
    sent.destroy()
    return found if found.any() else None


def _spelled(docs: DataFrame, bits: np.ndarray, least: int) -> DataFrame:
    """Exact counts (``lang, words, phrase, n``) of the phrases whose hashes the filter holds, from ``least`` on; a row with 0
    words and no phrase has a language's sum of words. The filter holds the parts of every phrase that counts."""
    sent = docs.sparkSession.sparkContext.broadcast(_packed(bits))

    def run(batches):
        held_bits = _unpacked(sent.value)
        for words, held in _parts(batches):
            names = pa.array(words + [b""], pa.binary()).cast(pa.string())
            for lang, ids in held.items():
                total = int((ids >= 0).sum())
                yield pa.RecordBatch.from_pylist([{"lang": lang, "words": 0, "n": total}], schema=_ARROW)
                for n, at, hashes in _levels(ids, _hashed(words, lang, ids), held_bits):
                    at = at[_known(held_bits, hashes)]
                    if not len(at):
                        continue
                    first, counts = _grouped([ids[at + i] for i in range(n)], len(words))
                    place = at[first]
                    each = [names.take(pa.array(ids[place + i])) for i in range(n)]
                    columns = [[lang] * len(place), np.full(len(place), n, np.int32), pc.binary_join_element_wise(*each, " "), counts]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW.types)], schema=_ARROW)

    counts = _texts(docs).mapInArrow(run, _SCHEMA).groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))
    counts = saved(counts.where((F.col("n") >= least) | (F.col("words") == 0)), "phrases")
    sent.destroy()
    return counts


def frequent_phrases(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """``lang, words, phrase, n`` of all phrases of 1 to ``LONGEST`` words that occur ``least`` times or more in a
    language, and a row with 0 words and no phrase for each language with its number of words.

    Everything is counted in all documents; the sample only decides how many passes that takes.
    """
    bits = _proposal(docs, least)
    found = _counted(docs, bits, None, least)
    more = _missed(found, bits)
    if more is not None:
        found = found.unionByName(_counted(docs, bits | more, bits, least))
    return _spelled(docs, _bits(found.select("hash"), _size(found.count())), least)


def _words(first: Column, count: Column) -> Column:
    return F.array_join(F.slice("_w", first, count), " ")


def scored(found: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """Candidates of ``frequent_phrases`` at their lowest-scoring cut: ``lang, phrase, a, l, r, score``."""
    phrases = found.where("words > 0").select("lang", "phrase", "words", "n")
    candidates = phrases.where((F.col("words") > 1) & (F.col("n") >= least)).withColumnRenamed("n", "a")
    cut = candidates.withColumn("_w", F.split("phrase", " ")).withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    sides = F.array(
        F.struct(F.lit(0).alias("side"), _words(F.lit(1), F.col("cut")).alias("part")),
        F.struct(F.lit(1).alias("side"), _words(F.col("cut") + 1, F.col("words") - F.col("cut")).alias("part")),
    )
    parts = cut.select("lang", "phrase", "words", "a", "cut", F.inline(sides))
    met = parts.join(phrases.select("lang", F.col("phrase").alias("part"), "n"), ["lang", "part"])
    kinds = [(c, s) for c in range(1, LONGEST) for s in (0, 1)]
    wide = met.groupBy("lang", "phrase", "words", "a").agg(
        *[F.max(F.when((F.col("cut") == c) & (F.col("side") == s), F.col("n"))).alias(f"n{c}{s}") for c, s in kinds]
    )

    def option(c: int) -> Column:
        score = F.expr(f"(cast(a as decimal(20, 0)) * 2000000) div (n{c}0 + n{c}1)")
        return F.when(F.col("words") > c, F.struct(score.alias("score"), F.lit(c).alias("cut"), F.col(f"n{c}0").alias("l"), F.col(f"n{c}1").alias("r")))

    best = F.array_min(F.array_compact(F.array(*[option(c) for c in range(1, LONGEST)])))
    return wide.withColumn("_b", best).select("lang", "phrase", "words", "a", "_b.l", "_b.r", "_b.score")


def unabsorbed(candidates: DataFrame) -> DataFrame:
    """Candidates without those inside a longer one that occurs at least 0.8 times as often."""
    inner = [(i, k) for k in range(2, LONGEST) for i in range(1, LONGEST - k + 2)]
    longer = candidates.where("words > 2").withColumn("_w", F.split("phrase", " "))
    subs = F.array_compact(F.array(*[F.when((F.lit(i + k - 1) <= F.col("words")) & (F.col("words") > k), _words(F.lit(i), F.lit(k))) for i, k in inner]))
    around = longer.select("lang", F.explode(subs).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    kept = candidates.join(around, ["lang", "phrase"], "left")
    return kept.where(F.col("around").isNull() | (F.col("around") * 100 < F.col("a") * 80)).drop("around")


def _first(rows: DataFrame, keys: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST_COUNT) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases of 2 to ``LONGEST`` words.

    A null text has no words; a null language is ``und`` and one with it. Repeated rows count as often as they stand there; an empty table
    gives no rows. Other columns than ``doc_id`` (which draws the sample), ``text`` and ``lang`` are not looked at.
    """
    spark: SparkSession = docs.sparkSession
    found = frequent_phrases(docs, least)
    kept = unabsorbed(saved(scored(found, least), "candidates"))
    # A language's candidates are first ranked in parts, so that none is gathered whole.
    dealt = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(shuffle_width(spark))))
    ranked = _first(_first(dealt, ["lang", "part"], top).drop("rank", "part"), ["lang"], top)
    totals = found.where("words = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
