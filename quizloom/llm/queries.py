"""Queries of the training-data operators over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import alignment, byte_bpe, chat, collocations, fingerprint, html_text, language_id, licences, ngram_join, packing, quality, topk, warc
from .common import read

QUERIES = {}
ORACLE = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


_JOIN_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN []
    WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM words),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k
  FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * k >= 90 * (na + nb - k)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, a AS r FROM ways UNION SELECT ways.b, reach.r FROM reach JOIN ways ON ways.a = reach.doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id
FROM sets s LEFT JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) c ON c.doc_id = s.doc_id
"""


@query("op1_ngram_jaccard_join", _JOIN_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(read(spark, sf_dir, "documents"), words=3, percent=90)


@query("op2_language_id")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read(spark, sf_dir, "documents"))


@query("op3_document_fingerprints")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(read(spark, sf_dir, "documents"))


@query("op4_quality_classifier")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op5_byte_bpe")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.digests(read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


_TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query("op6_exact_top_k", _TOPK_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"))


@query("op7_html_extraction")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(read(spark, sf_dir, "pages"))


@query("op8_harmonic_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


_CHAT_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(nullif(trim(role, ' '), ''), 'unknown') AS role, coalesce(text, '') AS text,
    coalesce(CAST(floor(turn / 256) AS BIGINT), -1) AS part FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
x AS (
  SELECT t.*, p.speaker, coalesce(t.role = p.speaker, false) AS own, t.text || '<|im_end|>' AS body,
    '<|im_start|>' || CASE WHEN t.role = p.speaker THEN 'assistant' WHEN t.role <> 'system' THEN 'user name=' || t.role ELSE t.role END || chr(10) AS head
  FROM t LEFT JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
y AS (
  SELECT *, row_number() OVER w AS i, sum(length(head) + length(body) + 1) OVER (w ROWS UNBOUNDED PRECEDING) - length(body) - 1 AS starts
  FROM x WINDOW w AS (PARTITION BY conv_id, speaker, part ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, speaker, part, count(*) AS n_turns, string_agg(head || body || chr(10), '' ORDER BY i) AS text,
  string_agg(CASE WHEN own THEN '1' ELSE '0' END, '' ORDER BY i) AS mask,
  coalesce(string_agg(CAST(starts AS BIGINT) || ':' || CAST(starts + length(body) AS BIGINT), ' ' ORDER BY i) FILTER (WHERE own), '') AS spans,
  CAST(coalesce(sum(length(body)) FILTER (WHERE own), 0) AS BIGINT) AS trained_chars
FROM y GROUP BY conv_id, speaker, part
"""


@query("op9_perspective_rotation", _CHAT_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(read(spark, sf_dir, "conversations"))


def _licence_sql() -> str:
    rows = ", ".join("({}, {}, {})".format(*["'" + v.replace("'", "''") + "'" for v in r]) for r in licences.KNOWN)
    return f"""
WITH k AS (SELECT kind, sha256({licences.canonical_sql("text")}) AS digest, min(licence) AS licence
  FROM (VALUES {rows}) v(licence, kind, text) GROUP BY ALL),
d AS (SELECT doc_id, sha256({licences.canonical_sql("text")}) AS digest, text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text ILIKE '%licen%'),
n AS (SELECT l.doc_id, string_agg(DISTINCT k.licence, ' ' ORDER BY k.licence) AS notices
  FROM l JOIN k ON k.kind = 'notice' AND k.digest = sha256({licences.canonical_sql("line")}) WHERE line ILIKE '%licen%' GROUP BY l.doc_id)
SELECT d.doc_id, d.digest, k.licence, coalesce(n.notices, '') AS notices
FROM d LEFT JOIN k ON k.kind = 'text' AND k.digest = d.digest LEFT JOIN n ON n.doc_id = d.doc_id
"""


@query("op10_licence_scan", _licence_sql())
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(read(spark, sf_dir, "documents"))


_PHRASES_SQL = r"""WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents),
spelled AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
rows0 AS (SELECT lang, unnest(list_zip(w, w[2:], w[3:], w[4:])) AS z FROM spelled),
rows1 AS (SELECT lang, z[1] AS w, z[2] AS w2, z[3] AS w3, z[4] AS w4 FROM rows0),
grams AS (
  SELECT lang, k, CASE k WHEN 1 THEN w WHEN 2 THEN w || ' ' || w2 WHEN 3 THEN w || ' ' || w2 || ' ' || w3 ELSE w || ' ' || w2 || ' ' || w3 || ' ' || w4 END AS phrase
  FROM rows1, range(1, 5) t(k)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS n FROM grams WHERE phrase IS NOT NULL GROUP BY lang, k, phrase),
often AS MATERIALIZED (SELECT * FROM f WHERE n >= 30),
c AS MATERIALIZED (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM often WHERE k > 1),
sides AS MATERIALIZED (
  SELECT lang, phrase, k, a, cut, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:k], ' ') AS tail
  FROM c JOIN range(1, 4) s(cut) ON cut < k),
cuts AS (
  SELECT s.lang, s.phrase, s.k, s.a, s.cut, x.n AS l, y.n AS r, CAST(CAST(2000000 AS HUGEINT) * s.a // (x.n + y.n) AS BIGINT) AS score
  FROM sides s JOIN often x ON x.lang = s.lang AND x.phrase = s.head JOIN often y ON y.lang = s.lang AND y.phrase = s.tail),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, phrase, max(a) AS around FROM (
    SELECT c.lang, c.a, array_to_string(c.w[i.i:i.i + s.k - 1], ' ') AS phrase
    FROM c JOIN range(2, 4) s(k) ON s.k < c.k JOIN range(1, 4) i(i) ON i.i + s.k - 1 <= c.k) GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN inside i ON i.lang = low.lang AND i.phrase = low.phrase WHERE i.around IS NULL OR 100 * i.around < 80 * low.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept),
total AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""


@query("op11_phrase_collocations", _PHRASES_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


@query("op12_tokenizer_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    both = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.align(read(spark, sf_dir, "documents"), *both)


_WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
k AS (SELECT *, strlen(payload) AS payload_bytes, max(page_id) OVER (PARTITION BY payload) AS kept FROM p)
SELECT page_id, payload_bytes, sha1(payload) AS payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM kept AND kept IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM kept THEN kept END AS refers_to
FROM k
"""


@query("op13_warc", _WARC_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.captures(read(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
