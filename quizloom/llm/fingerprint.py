"""Document fingerprints from closed syncmers, in built-in functions only.

A text is cut into pieces of up to three letters or digits (a sign of a script without blanks is a
piece of its own). A run of ``K`` pieces is kept if the smallest hash of its inner runs of ``S``
pieces lies at its first or last place. That depends on nothing outside the run, so two texts keep
the same runs wherever they agree. The fingerprint holds the smallest ``SIZE`` hashes of the kept
runs: the shares of common ones estimate how much two texts have in common.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, shuffle_width

K, S, SIZE = 5, 2, 64
#: The first documents of the id ranges are sent to all tasks up to this size.
SENT_BYTES = 64 * 2**20
_PIECES = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]|[\p{L}\p{M}\p{N}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}]]{1,3}|[^\s\p{L}\p{M}\p{N}]"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body).getItem(0)


def _no_hashes() -> Column:
    return F.array().cast("array<bigint>")


def syncmers(text: Column) -> Column:
    """Hashes of the closed syncmers in order of place; a text of fewer than ``K`` pieces is one
    run, a null text or one without pieces has none."""

    def kept(h: Column, s: Column) -> Column:
        last = K - S

        def run(i: Column) -> Column:
            first, end = s[i], s[i + last]
            inner = [s[i + j] for j in range(1, last)]
            edge = (first <= F.least(*inner, end)) | (end <= F.least(first, *inner))
            return F.when(edge, F.xxhash64(first, s[i + 2], h[i + 4]))

        runs = F.transform(F.sequence(F.lit(0), F.size(h) - K), run)
        return F.filter(runs, lambda x: x.isNotNull())

    def of(h: Column) -> Column:
        short = F.when(F.size(h) > 0, F.array(F.xxhash64(F.lit("short"), h))).otherwise(_no_hashes())
        pairs = F.zip_with(F.slice(h, 1, F.size(h) - 1), F.slice(h, 2, F.size(h) - 1), lambda a, b: F.xxhash64(a, b))
        return F.when(F.size(h) >= K, _let(pairs, lambda s: kept(h, s))).otherwise(short)

    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_PIECES), F.lit(0))
    return _let(F.transform(pieces, lambda p: F.xxhash64(p)), of)


def sketch(text: Column) -> Column:
    """The ``SIZE`` smallest distinct hashes, in order. Of many hashes only those below a bound are
    sorted that six times as many are expected to pass; all, if fewer than ``SIZE`` do."""

    def smallest(a: Column) -> Column:
        bound = (F.lit(-(2.0**63)) + F.lit(6.0 * SIZE * 2.0**64) / F.size(a)).cast("long")
        few = _let(bound, lambda b: F.array_distinct(F.filter(a, lambda x: x < b)))
        some = F.when(F.size(a) > 6 * SIZE, few).otherwise(_no_hashes())
        return _let(some, lambda c: F.slice(F.sort_array(F.when(F.size(c) < SIZE, F.array_distinct(a)).otherwise(c)), 1, SIZE))

    return _let(syncmers(text), smallest)


def as_text(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the kept runs; two empty fingerprints are alike (1)."""

    def share(u: Column) -> Column:
        return F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u)

    union = F.slice(F.sort_array(F.array_union(a, b)), 1, SIZE)
    one_empty = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(one_empty, (F.size(a) == F.size(b)).cast("double")).otherwise(_let(union, share))


def id_ranges(ids: DataFrame) -> list[tuple[int, int]]:
    """(smallest, largest) id of ranges that hold about as many of the distinct ``ids``: one for
    each shuffle partition at most, so their number does not grow with the rows of one."""
    dealt = ids.repartitionByRange(shuffle_width(ids.sparkSession), "doc_id")
    ends = dealt.groupBy(F.spark_partition_id().alias("part")).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("top"))
    return sorted((r.low, r.top) for r in ends.collect())


def _range_of(lows: list[int]) -> Column:
    """Number of the range of an id: first among every ``step``-th lower end, then among those between."""
    step = max(1, int(len(lows) ** 0.5))
    blocks = [lows[i : i + step] for i in range(0, len(lows), step)]
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])

    def within(block: Column) -> Column:
        inner = F.filter(F.element_at(F.array(*map(longs, blocks)), block), lambda x: x <= F.col("doc_id"))
        return (block - 1) * step + F.size(inner) - 1

    reached = F.size(F.filter(longs([x[0] for x in blocks]), lambda x: x <= F.col("doc_id")))
    return _let(reached, within).cast("int")


def _with_next(docs: DataFrame, ranges: list[tuple[int, int]]) -> DataFrame:
    """Rows of distinct ids with ``head`` (the first ``most`` code points of the next text) and
    ``following`` (its hashes). The next document is the next row of the range; the last of a range
    gets the first of the range below, one row for each range, of a checked size."""
    order = Window.partitionBy("part").orderBy(F.col("doc_id").desc())
    placed = docs.withColumn("part", _range_of([low for low, _ in ranges]))
    after = F.lead(F.struct("text", "own")).over(order)
    inside = placed.withColumn("after", after).select(
        "doc_id", "text", "own", "most", "part",
        F.substring("after.text", F.lit(1), F.col("most")).alias("head"), F.col("after.own").alias("following"),
    )
    firsts = [(part, ranges[part - 1][1]) for part in range(len(ranges))]
    below = docs.sparkSession.createDataFrame(firsts, "for_part int, top long")
    edge = docs.join(F.broadcast(below), F.col("doc_id") == F.col("top")).select("for_part", F.col("text").alias("edge"), F.col("own").alias("edge_own"))
    edge = saved(edge, "edges")
    size = edge.agg(F.sum(F.octet_length("edge") + 8 * SIZE)).first()[0] or 0
    edge = F.broadcast(edge) if size <= SENT_BYTES else edge
    last = F.col("following").isNull() & (F.col("part") == F.col("for_part"))
    return inside.join(edge, last, "left").select(
        "doc_id", "text", "own",
        F.coalesce("head", F.substring("edge", F.lit(1), F.col("most"))).alias("head"),
        F.coalesce("following", "edge_own").alias("following"),
    )


def fingerprints(df: DataFrame) -> DataFrame:
    """Fingerprint of every text and of its edited form, with likenesses.

    Edited: the last floor(n_chars / 3) code points give way to as many first ones of the next
    document by descending id (all, if it is shorter; after the last document comes the first).
    ``near_edited`` and ``near_next`` compare the fingerprint with the edited text's and the next
    document's. A null text counts as empty. Rows that share an id have the same next document;
    of several next rows with one id the smallest text counts. A row without an id has an empty
    next document. Other columns of ``df`` are ignored.
    """
    plain = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    known = plain.where("doc_id is not null")
    most = F.expr("char_length(text) div 3").cast("int")
    ids = saved(known.groupBy("doc_id").agg(F.count("*").alias("rows"), F.max(most).alias("most")), "ids")
    ranges = id_ranges(ids.select("doc_id"))
    own = sketch(F.col("text")).alias("own")
    rows = plain.where("doc_id is null").select("doc_id", "text", own, F.lit("").alias("head"), _no_hashes().alias("following"))
    repeated = ids.where("rows > 1")
    if repeated.head(1):  # one row of an id finds the next document for all of them
        order = Window.partitionBy("doc_id").orderBy("text")
        numbered = known.withColumn("_n", F.row_number().over(order))
        single = numbered.where("_n = 1").join(ids, "doc_id").select("doc_id", "text", own, "most")
        single = saved(_with_next(single, ranges), "single")
        heads = single.join(repeated, "doc_id", "left_semi").select("doc_id", "head", "following")
        others = numbered.where("_n > 1").join(heads, "doc_id").select("doc_id", "text", own, "head", "following")
        rows = rows.unionByName(single).unionByName(others)
    elif ranges:
        rows = rows.unionByName(_with_next(known.select("doc_id", "text", own, most.alias("most")), ranges))
    cut = F.expr("char_length(text) div 3").cast("int")
    n = F.char_length("text")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("head", F.lit(1), cut))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "own", "following", edited.alias("edited"))
    rows = rows.withColumn("changed", sketch(F.col("edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
