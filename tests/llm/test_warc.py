"""WARC archives against the pages they were written from."""

import gzip
import hashlib
import random

from pyspark.sql import functions as F

from quizloom.llm import warc
from quizloom.session import scratch_path

SCHEMA = "page_id long, url string, html string"


def _rows():
    body = "<p>é " + "x" * 1200 + "\r\n\r\nWARC/1.1\r\n</p>"
    rows = [(i, f"http://www.b.example/{i % 3}?Q={i}#f", body) for i in range(20)]
    rows += [(i, "https://a.example", f"{i}" * 700) for i in range(20, 60)]
    rows += [(60, None, None), (61, "x y\r\nz", ""), (62, "", "tiny"), (63, "http://u@c.example:80", "tiny"), (None, "http://d.example/", body)]
    rows += [(70, "http://e.example/", "r" * 2000)] * 3 + [(71, "http://e.example/", "r" * 2000)] * 2 + [(None, "http://n.example/", "n" * 1500)] * 2
    return rows + [(80, "http://long.example/", "ü" * 3_000_000)]


def _expected(rows):
    kept = {}
    for i, _, html in rows:
        if i is not None:
            kept[html] = max(kept.get(html, i), i)
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        again = len(raw) >= 1000 and html in kept and i != kept[html]
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", kept[html] if again else None))
    return sorted(out, key=str)


def _answer(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_pages_come_back(spark):
    rows = _rows()
    pages = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({"digest": F.lit("x"), "key": F.lit("k"), "kept": F.lit(0)})
    assert _answer(warc.captures(pages)) == _expected(rows)


def test_empty_table(spark):
    assert warc.captures(spark.createDataFrame([], SCHEMA)).count() == 0


def test_files_are_small_and_whole(spark):
    rows = [(i, f"http://h{i % 7}.example/{i}", str(i) * 400) for i in range(200)]
    path = scratch_path(spark, "warc-test")
    warc.write(spark.createDataFrame(rows, SCHEMA).coalesce(2), path, file_bytes=20_000)
    files = spark.read.format("binaryFile").load(path).select("content").collect()
    assert len(files) > 8
    data = [gzip.decompress(bytes(f.content)) for f in files]
    assert all(len(d) < 24_000 for d in data)
    assert sum(d.count(b"WARC/1.1\r\n") for d in data) == 200
    assert {r[2] for d in data for r in warc.parse(d, "")} == set(range(200))


def test_changed_payload_is_noticed():
    data = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1:0>\r\nWARC-Date: d\r\nWARC-Payload-Digest: sha1:00\r\nContent-Length: 40\r\n\r\nHTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nabcd\r\n\r\n"
    try:
        warc.parse(data, "f")
    except ValueError:
        return
    raise AssertionError


def test_histories_are_in_global_order(spark, monkeypatch):
    """One URL has a third of the captures and fills several ranges."""
    monkeypatch.setattr(warc, "RANGE_ROWS", 40)
    rows = [(i, "http://hot.example/" if i % 3 == 0 else f"http://h{i % 11}.example/{i % 5}", f"{i}") for i in range(600)]
    got = warc.captures(spark.createDataFrame(rows, SCHEMA).repartition(9)).collect()
    by_range = sorted(got, key=lambda r: (r.range_no, r.urlkey, r.date, r.run, r.offset))
    keys = [(r.urlkey, r.date, r.run, r.offset) for r in by_range]
    assert keys == sorted(keys) and len({r.range_no for r in got if "hot" in r.urlkey}) > 2
    seen = {}
    for r in by_range:
        seen[r.urlkey] = seen.get(r.urlkey, 0) + 1
        assert r.capture == seen[r.urlkey]


def test_loser_tree():
    rng = random.Random(5)
    for k in range(9):
        lists = [sorted(rng.randrange(50) for _ in range(rng.randrange(12))) for _ in range(k)]
        assert list(warc.LoserTree(lists, lambda x: x)) == sorted(x for rows in lists for x in rows)


def test_url_keys():
    assert warc.url_key("HTTP://user@www.B.a.Example:8080/X?y=Z#f") == "example:8080,a,b)/x?y=z"
    assert warc.url_key("http://a.example") == "example,a)/" and warc.url_key(None) == "" == warc.url_key("") and warc.url_key("News:X") == "news:x"
