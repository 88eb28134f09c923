"""WARC archives: written from pages, read back, and indexed by an external merge.

Each task writes WARC files (gzip) of bounded size through Spark's text sink, whose line separator is the
record separator of the format. A payload that occurs again is stored once; its other records are
revisits. Reading a file back gives a capture run: index rows sorted by URL key and time. Runs are
cut into key ranges, and each range merges its slices of all runs with a loser tree, so that the
ranges one after the other are the capture histories in global order.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import saved, shuffle_width

#: Payloads of fewer bytes are stored whole each time.
LEAST_REVISIT_BYTES = 1000
#: Bytes of records after which a task goes on to its next file.
FILE_BYTES = 16 * 2**20
#: Index rows of one key range (expected number).
RANGE_ROWS = 100_000

_END = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URL = re.compile(r"(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#]*)([^#]*)")

INDEX = (
    "urlkey string, date string, page_id long, url string, record_type string, refers_to long, "
    "payload_bytes long, payload_digest string, run string, offset long, length long"
)
_SCHEMA = pa.schema(
    [(n, pa.int64() if t == "long" else pa.string()) for n, t in (c.split(" ") for c in INDEX.split(", "))]
)
_HISTORY = INDEX + ", range_no int, place long, edge boolean"


def crawl_date(page_id: Column) -> Column:
    """Capture time of a table without one: the first second of 2000 (UTC) plus the page's id in seconds
    (modulo 2^31; a null id adds nothing)."""
    seconds = F.coalesce(F.pmod(page_id, F.lit(2**31)), F.lit(0)).cast("decimal(18,6)")
    moment = F.to_timestamp_ntz(F.lit("2000-01-01 00:00:00")) + F.make_dt_interval(secs=seconds)
    return F.concat(F.translate(moment.cast("string"), " ", "T"), F.lit("Z"))


def records(pages: DataFrame, date: Column | None = None) -> DataFrame:
    """One column ``record``: the WARC record of every row, without the separator after it.

    Of equal payloads of at least ``LEAST_REVISIT_BYTES`` the record with the largest ``page_id`` is a
    response and the others are revisits of it. A null ``html`` is an empty payload. Rows that share
    the largest id are all responses, as are rows without an id if no copy has one. A null ``url``
    leaves the target out; blanks and line breaks inside an URL are percent-encoded.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("date", crawl_date(F.col("page_id")) if date is None else date)
    rows = rows.withColumn("bytes", F.octet_length("payload")).withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    large = F.col("bytes") >= LEAST_REVISIT_BYTES
    kept = rows.where(large).groupBy("digest").agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("copies"))
    kept = kept.where("copies > 1 and kept is not null").select(F.col("digest").alias("key"), "kept")
    # Small payloads get a key of their own: an empty one may be the most frequent of all.
    own = F.when(large, F.col("digest")).otherwise(F.concat_ws(" ", F.lit("own"), F.xxhash64("page_id", "url").cast("string")))
    rows = rows.withColumn("key", own).join(kept, "key", "left")
    again = F.col("kept").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("kept"), F.lit(False))
    target = F.col("url")
    for char, code in ((" ", "%20"), ("\t", "%09"), ("\n", "%0A"), ("\r", "%0D")):
        target = F.replace(target, F.lit(char), F.lit(code))

    def urn(page_id: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(":"), F.substring("digest", 1, 16), F.lit(">"))

    def field(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value)

    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(_END)
    )
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        field("WARC-Type", F.when(again, "revisit").otherwise("response")),
        field("WARC-Record-ID", urn(F.col("page_id"))),
        field("WARC-Target-URI", target),
        field("WARC-Date", F.col("date")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(again, field("WARC-Refers-To", urn(F.col("kept")))),
        F.when(again, F.lit(f"WARC-Profile: {_PROFILE}")),
        F.lit("Content-Type: application/http;msgtype=response"),
        field("Content-Length", (F.octet_length(http) + F.when(again, 0).otherwise(F.col("bytes"))).cast("string")),
    )
    return rows.select(F.concat(head, F.lit(_END), http, F.when(again, "").otherwise(F.col("payload"))).alias("record"))


def write(pages: DataFrame, path: str, date: Column | None = None, file_bytes: int = FILE_BYTES) -> None:
    """Write ``records`` below ``path`` as gzip files of about ``file_bytes`` before compression
    (a longer record has a file to itself at most)."""

    def volumes(batches):
        """Number the files of a task by the bytes before each record."""
        done = 0
        for batch in batches:
            sizes = pc.add(pc.cast(pc.binary_length(batch.column(0)), pa.int64()), len(_END))
            ends = pc.add(pc.cumulative_sum(sizes), done)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.divide(pc.subtract(ends, sizes), file_bytes)], names=["record", "volume"]
            )
            done = ends[-1].as_py() if len(ends) else done

    dealt = records(pages, date).mapInArrow(volumes, "record string, volume long")
    dealt.write.partitionBy("volume").option("lineSep", _END).option("compression", "gzip").text(path)


def url_key(url: str | None) -> str:
    """Host names from the last to the first, then the path with its query, lower case: pages of a
    site stand together. No URL: empty."""
    if not url:
        return ""
    found = _URL.match(url)
    if not found:
        return url.lower()
    host, rest = found.groups()
    return ",".join(reversed(host.lower().removeprefix("www.").split("."))) + ")" + (rest.lower() or "/")


def _page(urn: str | None) -> int | None:
    name = urn.split(":")[2] if urn else "none"
    return None if name == "none" else int(name)


def parse(data: bytes, run: str) -> list[tuple]:
    """Index rows of a WARC file by its lengths, in order of appearance. A payload must have the
    digest that its record names."""
    out, at = [], 0
    while at < len(data):
        body = data.index(b"\r\n\r\n", at) + 4
        version, *lines = data[at : body - 4].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"{run}: no record at {at}")
        head = dict(line.split(": ", 1) for line in lines)
        end = body + int(head["Content-Length"])
        payload = data.index(b"\r\n\r\n", body) + 4
        size = int(re.search(rb"\r\nContent-Length: (\d+)", data[body:payload])[1])
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        whole = head["WARC-Type"] == "response"
        if whole and (end - payload != size or hashlib.sha1(data[payload:end]).hexdigest() != digest):
            raise ValueError(f"{run}: the payload at {payload} is not the one that was written")
        url = head.get("WARC-Target-URI")
        out.append(
            (url_key(url), head["WARC-Date"], _page(head["WARC-Record-ID"]), url, head["WARC-Type"],
             _page(head.get("WARC-Refers-To")), size, digest, run, at, end - at)
        )
        at = end + len(_END)
    return out


def _order(row: tuple) -> tuple:
    return row[0], row[1], row[8], row[9]


def _batches(rows, schema: pa.Schema, size: int = 10_000):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def runs(spark: SparkSession, path: str) -> DataFrame:
    """Capture runs of the archives below ``path``: each file's index rows, sorted in its task."""

    def sort_file(batches):
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1)):
                rows = parse(zlib.decompress(data.as_py(), wbits=31), "/".join(name.as_py().rsplit("/", 2)[-2:]))
                yield from _batches(sorted(rows, key=_order), _SCHEMA)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(sort_file, INDEX)


class LoserTree:
    """Merge of sorted lists: a node keeps the loser of its match, so the next row costs one match a
    level, on the path of the list that gave the last one."""

    def __init__(self, lists: list[list], key):
        self.lists, self.key = lists, key
        self.at = [0] * len(lists)
        self.heads = [key(rows[0]) if rows else None for rows in lists]
        self.losers = [0] * len(lists)
        self.winner = self._play(1) if lists else 0

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or x <= y)

    def _play(self, node: int) -> int:
        if node >= len(self.lists):
            return node - len(self.lists)
        a, b = self._play(2 * node), self._play(2 * node + 1)
        winner, self.losers[node] = (a, b) if self._beats(a, b) else (b, a)
        return winner

    def __iter__(self):
        while self.lists and self.heads[self.winner] is not None:
            w = self.winner
            rows, at = self.lists[w], self.at[w]
            yield rows[at]
            self.at[w] = at + 1
            self.heads[w] = self.key(rows[at + 1]) if at + 1 < len(rows) else None
            node = (w + len(self.lists)) // 2
            while node:
                if self._beats(self.losers[node], w):
                    w, self.losers[node] = self.losers[node], w
                node //= 2
            self.winner = w


def _numbered(rows, range_no: int):
    """Add the range, the place among its rows of the same key, and a mark on the last row of the
    range's first key and of its last key."""
    first = held = None
    place = 0
    for row in rows:
        if held is not None:
            yield (*held, range_no, place, row[0] != held[0] and held[0] == first)
        first = row[0] if held is None else first
        place = place + 1 if held is not None and held[0] == row[0] else 1
        held = row
    if held is not None:
        yield (*held, range_no, place, True)


def histories(index: DataFrame, rows: int) -> DataFrame:
    """Merge capture runs (``INDEX``; ``rows`` of them) into capture histories: the columns of the runs with
    ``range_no`` and ``capture``, the number of the capture among those of its URL key.

    A URL key may fill many ranges: ranges are cut by key, time, run and offset. Only the first and
    the last key of a range can go on in another, so two rows a range carry their counts over.
    """
    spark = index.sparkSession
    ranges = max(shuffle_width(spark), -(-rows // RANGE_ROWS))
    schema = pa.schema([*_SCHEMA, ("range_no", pa.int32()), ("place", pa.int64()), ("edge", pa.bool_())])

    def merge(batches):
        slices: dict[str, list] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                slices.setdefault(row[8], []).append(row)
        for part in slices.values():
            part.sort(key=_order)  # in order already unless a spill came between
        tree = LoserTree(list(slices.values()), _order)
        yield from _batches(_numbered(tree, TaskContext.get().partitionId()), schema)

    merged = saved(index.repartitionByRange(ranges, "urlkey", "date", "run", "offset").mapInArrow(merge, _HISTORY), "histories")
    before = Window.partitionBy("urlkey").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    carry = merged.where("edge").select("urlkey", "range_no", F.sum("place").over(before).alias("carry"))
    joined = merged.join(F.broadcast(carry.where("carry > 0")), ["urlkey", "range_no"], "left")
    return joined.withColumn("capture", F.col("place") + F.coalesce("carry", F.lit(0))).drop("place", "edge", "carry")


def captures(pages: DataFrame, date: Column | None = None) -> DataFrame:
    """Write the archives of ``pages``, read them back and merge their index: one row a page.

    An empty table has no archives and no rows. Other columns of ``pages`` are not looked at.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write(pages, path, date)
    if pages.isEmpty():
        return spark.createDataFrame([], INDEX + ", range_no int, capture long")
    seen = Observation()
    index = saved(runs(spark, path).observe(seen, F.count(F.lit(1)).alias("n")), "runs")
    return histories(index, seen.get["n"])
