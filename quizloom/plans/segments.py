"""Queries: text segmentation and tagging, on books made from the documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import reference_values as R
from ..functions import text as X
from ..operators import segment as S
from ..schemas import SLUG_RULE
from .catalog import query, with_
from .items import table

WS = X.WS
N = "chr(10)"


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


# A book per document: front matter, a chapter with numbered sections and question zones,
# a chapter of paragraphs, a glossary and a practice set. {t} is the whole text.
_BOOK = [
    "Cover of ", "{source}", "\nContents\n\n1. INTRODUCTION TO COMPUTER\n1.1 Basics\n", "{text}", "\n1.2 More Basics\n\n", "{wide}",
    "\nMultiple Choice Questions\n1. ", "{source}", " is what?\n(a) one (b) two\n2. ", "{text}", "\nTrue/False\n1. ", "{lang}",
    " is a language of the text.\n2. No\n3. WORD PROCESSING\n", "{wide}", "\nComputer Glossary\n", "{text}", "\nPractice Set 1\n1. Name ", "{source}", "\n10. ", "{text}",
]


def books(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    col = {"{text}": F.col("text"), "{wide}": F.regexp_replace("text", "\n", "\n\n"), "{source}": F.col("source"), "{lang}": F.col("lang")}
    return d.select("doc_id", F.concat(*[col.get(p, F.lit(p)) for p in _BOOK]).alias("text"))


def _lit(p: str) -> str:
    return "'" + p.replace("'", "''").replace("\n", f"' || {N} || '") + "'"


_SQLCOL = {"{text}": "text", "{wide}": f"replace(text, {N}, {N} || {N})", "{source}": "source", "{lang}": "lang"}
BOOKS = "books AS (SELECT doc_id, " + " || ".join(_SQLCOL.get(p, f"({_lit(p)})") for p in _BOOK) + " AS text FROM documents)"
BODY = f"body AS (SELECT doc_id, CASE WHEN regexp_matches(text, '{S.FIRST_CHAPTER}') THEN substring(text, strpos(text, regexp_extract(text, '{S.FIRST_CHAPTER}'))) ELSE text END AS text FROM books)"


@query("front_matter_removed", with_(BOOKS, BODY, body="SELECT doc_id, length(text) AS n, md5(text) AS digest FROM body"))
def front_matter_removed(spark, sf):
    b = books(spark, sf).withColumn("text", S.without_front_matter(F.col("text")))
    return b.select("doc_id", F.length("text").alias("n"), F.md5("text").alias("digest"))


_TITLES = ", ".join("'" + t + "'" for t in R.BOOK_TITLES + R.BACK_MATTER)
_CHAPTERS = ", ".join("'" + t + "'" for t in R.BOOK_TITLES)
SECTIONS = f"""hits AS (SELECT doc_id, text, t AS title, strpos(text, t) AS start FROM body, (SELECT unnest([{_TITLES}]) AS t) WHERE strpos(text, t) > 0),
secs AS (SELECT doc_id, title, start, title IN ({_CHAPTERS}) AS is_chapter, {strip_sql("substring(text, start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start), length(text) + 1) - start)")} AS content FROM hits)"""


@query("book_sections_by_title", with_(BOOKS, BODY, SECTIONS, body="SELECT doc_id, title, start, is_chapter, md5(content) AS digest FROM secs"))
def book_sections_by_title(spark, sf):
    b = books(spark, sf).withColumn("text", S.without_front_matter(F.col("text")))
    return S.sections(b).select("doc_id", "title", "start", "is_chapter", F.md5("content").alias("digest"))


ZONES = f"""pos AS (SELECT *, strpos(content, '{S.MCQ_MARK}') AS m, strpos(content, '{S.TF_MARK}') AS t FROM secs WHERE is_chapter),
zones AS (SELECT doc_id, title, start, {strip_sql("CASE WHEN m > 0 THEN substring(content, 1, m - 1) ELSE content END")} AS prose,
 {strip_sql(f"CASE WHEN m > 0 AND t > m THEN substring(content, m + {len(S.MCQ_MARK)}, t - m - {len(S.MCQ_MARK)}) WHEN m > 0 THEN substring(content, m + {len(S.MCQ_MARK)}) ELSE '' END")} AS mcq,
 {strip_sql(f"CASE WHEN m > 0 AND t > m THEN substring(content, t + {len(S.TF_MARK)}) ELSE '' END")} AS truefalse FROM pos)"""


@query("chapter_zones", with_(BOOKS, BODY, SECTIONS, ZONES, body="SELECT doc_id, title, md5(prose) AS prose, md5(mcq) AS mcq, md5(truefalse) AS truefalse FROM zones"))
def chapter_zones(spark, sf):
    b = books(spark, sf).withColumn("text", S.without_front_matter(F.col("text")))
    z = S.sections(b).where("is_chapter").withColumn("z", S.zones(F.col("content")))
    return z.select("doc_id", "title", *[F.md5(f"z.{n}").alias(n) for n in ("prose", "mcq", "truefalse")])


QCHUNKS = f"""qsrc AS (SELECT doc_id, title, 'mcq' AS content_type, mcq AS text FROM zones UNION ALL SELECT doc_id, title, 'truefalse', truefalse FROM zones
 UNION ALL SELECT doc_id, title, 'practice_set', content FROM secs WHERE title LIKE 'Practice%'),
qpieces AS (SELECT doc_id, title, content_type, unnest(string_split(regexp_replace(text, '(?m)^(\\d{{1,3}})\\.\\s', chr(57344) || '\\0', 'g'), chr(57344))[2:]) AS p FROM qsrc),
qchunks AS (SELECT doc_id, title AS chapter, content_type, regexp_extract({strip_sql('p')}, '^(\\d{{1,3}})\\.', 1) AS question_no, {strip_sql('p')} AS text FROM qpieces WHERE length({strip_sql('p')}) >= 8)"""


@query("question_chunks", with_(BOOKS, BODY, SECTIONS, ZONES, QCHUNKS, body="SELECT doc_id, chapter, content_type, question_no, md5(text) AS digest FROM qchunks"))
def question_chunks(spark, sf):
    chunks = S.book_chunks(books(spark, sf)).where("content_type IN ('mcq', 'truefalse', 'practice_set')")
    return chunks.select("doc_id", "chapter", "content_type", "question_no", F.md5("text").alias("digest"))


@query("prose_and_glossary_chunks")
def prose_and_glossary_chunks(spark, sf):
    chunks = S.book_chunks(books(spark, sf)).where("content_type IN ('content', 'glossary')")
    return chunks.select("doc_id", "id", "chapter", "content_type", "section", "subsection", "term", F.md5("text").alias("digest"))


@query("chunk_counts_by_type")
def chunk_counts_by_type(spark, sf):
    return S.book_chunks(books(spark, sf)).groupBy("content_type").agg(F.count("*").alias("n"))


_PROSE_LINES = f"list_filter(list_transform(string_split(prose, {N} || {N}), lambda p: {strip_sql('p')}), lambda p: length(p) > 30)"


@query(
    "paragraph_chunks",
    with_(BOOKS, BODY, SECTIONS, ZONES, body=f"SELECT doc_id, title AS chapter, md5(unnest({_PROSE_LINES})) AS digest FROM zones WHERE NOT regexp_matches(prose, '(?m)^\\d+(?:\\.\\d+){{1,3}}\\s+[A-Z][^\\n]{{2,80}}$')"),
)
def paragraph_chunks(spark, sf):
    chunks = S.book_chunks(books(spark, sf)).where("content_type = 'content' AND section IS NULL")
    return chunks.select("doc_id", "chapter", F.md5("text").alias("digest"))


MARKDOWN = f"md AS (SELECT doc_id, text || {N} || '## Part ' || lang || '  ' || {N} || replace(text, '. ', '.' || {N}) || {N} || '### From ' || source || {N} || text || {N} || '## Empty' || {N} || '## Last' || {N} || text AS text FROM documents)"
ISLANDS = f"""ln AS (SELECT doc_id, unnest(string_split(text, {N})) AS raw, generate_subscripts(string_split(text, {N}), 1) AS pos FROM md),
l2 AS (SELECT doc_id, pos, regexp_replace(raw, '{WS}+$', '') AS line FROM ln),
l3 AS (SELECT *, starts_with(line, '## ') AS two, starts_with(line, '### ') AS three FROM l2),
l4 AS (SELECT *, sum(CASE WHEN two OR three THEN 1 ELSE 0 END) OVER w AS island, coalesce(last_value(CASE WHEN two THEN {strip_sql('substring(line, 4)')} END IGNORE NULLS) OVER w, '') AS chapter FROM l3 WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
l5 AS (SELECT doc_id, island, max(chapter) AS chapter, coalesce(max(CASE WHEN three THEN {strip_sql('substring(line, 5)')} END), '') AS section, string_agg(line, {N} ORDER BY pos) FILTER (NOT two AND NOT three) AS text FROM l4 GROUP BY ALL HAVING count(*) FILTER (NOT two AND NOT three) > 0)"""


@query(
    "markdown_sections",
    with_(MARKDOWN, ISLANDS, body=f"SELECT doc_id, 'md-' || lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY island) - 1 AS VARCHAR), 5, '0') AS id, chapter, section, md5({strip_sql('text')}) AS digest FROM l5"),
)
def markdown_sections(spark, sf):
    d = table(spark, sf, "documents")
    md = d.select(
        "doc_id",
        F.concat(
            "text", F.lit("\n## Part "), "lang", F.lit("  \n"), F.replace("text", F.lit(". "), F.lit(".\n")), F.lit("\n### From "), "source",
            F.lit("\n"), "text", F.lit("\n## Empty\n## Last\n"), "text",
        ).alias("text"),
    )
    return S.heading_islands(md).select("doc_id", "id", "chapter", "section", F.md5("text").alias("digest"))


def _book_text(spark, sf):
    """Long lines broken at sentence ends, so that short lines can be headings."""
    return table(spark, sf, "documents").select(
        "doc_id", "source", F.concat(F.lit("Start of Text\n"), F.replace("text", F.lit(". "), F.lit(".\n"))).alias("text")
    )


HEADING_SQL = "(s <> '' AND length(s) <= 80 AND NOT regexp_matches(s, '^[-|●]') AND NOT regexp_matches(s, '^\\d+\\.\\s+\\d+') AND regexp_matches(s, '[A-Za-z]{3,}') AND NOT regexp_matches(s, '^\\p{Ll}'))"
BOOK_LINES = f"""bt AS (SELECT doc_id, source, 'Start of Text' || {N} || replace(text, '. ', '.' || {N}) AS text FROM documents),
bl AS (SELECT doc_id, unnest(string_split(text, {N})) AS line, generate_subscripts(string_split(text, {N}), 1) - 1 AS pos FROM bt),
bs AS (SELECT *, {strip_sql('line')} AS s FROM bl), bh AS (SELECT *, {HEADING_SQL} AND pos > 0 AS head FROM bs),
br AS (SELECT doc_id, CAST(0 AS BIGINT) AS b FROM bt UNION ALL SELECT r.doc_id, (SELECT min(h.pos) FROM bh h WHERE h.doc_id = r.doc_id AND h.head AND h.pos > r.b + 4) FROM br r WHERE r.b IS NOT NULL),
bk AS (SELECT doc_id, b, row_number() OVER (PARTITION BY doc_id ORDER BY b) - 1 AS section_no, lead(b) OVER (PARTITION BY doc_id ORDER BY b) AS stop FROM br WHERE b IS NOT NULL),
bx AS (SELECT k.doc_id, k.section_no, max(CASE WHEN l.pos = k.b THEN l.s END) AS section_heading, {strip_sql(f"coalesce(string_agg(CASE WHEN l.pos > k.b THEN l.line END, {N} ORDER BY l.pos), '')")} AS text
 FROM bk k JOIN bs l ON l.doc_id = k.doc_id AND l.pos >= k.b AND (k.stop IS NULL OR l.pos < k.stop) GROUP BY ALL),
bsec AS (SELECT x.*, t.source FROM bx x JOIN bt t USING (doc_id) WHERE length(x.text) >= 80)"""


@query("heading_sections", "WITH RECURSIVE " + BOOK_LINES + " SELECT doc_id, section_no, section_heading, md5(text) AS digest FROM bsec")
def heading_sections(spark, sf):
    return S.book_sections(_book_text(spark, sf)).select("doc_id", "section_no", "section_heading", F.md5("text").alias("digest"))


# A small rule table for these texts; users bring their own.
RULES = [
    {"chapter_id": f"ch{c}", "pattern": p, "slug": s, "bloom_levels": b, "difficulty": d}
    for c in range(1, 10)
    for p, s, b, d in (
        (r"copyright|licen[sc]e", "save_document", ["remember"], ["easy"]),
        (r"the.*tion", "tables_in_writer" if c < 4 else f"topic_{c}", ["apply"], ["medium"]),
        (r"(^|[^\p{L}])(und|le|que)($|[^\p{L}])", "cyber_safety_email", ["understand", "analyze"], ["medium", "hard"]),
    )
]
CH = "'ch' || (doc_id % 9 + 1)"


def _tagged(spark, sf):
    sections = S.book_sections(_book_text(spark, sf)).withColumn(
        "chapter_id", F.concat(F.lit("ch"), (F.col("doc_id") % 9 + 1).cast("string"))
    )
    rules = spark.createDataFrame([{**r, "ordinal": i} for i, r in enumerate(RULES)], SLUG_RULE)
    return S.tag_slugs(sections, rules)


def _rule_case(t: str, col: str) -> str:
    arms = []
    for r in RULES:
        v = r["slug"] if col == "slug" else ",".join(r[col])
        arms.append(f"WHEN chapter_id = '{r['chapter_id']}' AND regexp_matches({t}, '(?i){r['pattern']}') THEN '{v}'")
    return "CASE " + " ".join(arms) + " END"


def _rule(col: str) -> str:
    return f"coalesce({_rule_case('section_heading', col)}, {_rule_case('substring(text, 1, 300)', col)})"


_FALLBACK = "trim(substring(regexp_replace(lower(section_heading), '[^a-z0-9]+', '_', 'g'), 1, 40), '_')"
TAGGED = f"""bc AS (SELECT *, {CH} AS chapter_id FROM bsec), tg AS (SELECT *, coalesce({_rule('slug')}, {_FALLBACK}) AS topic_slug, coalesce({_rule('difficulty')}, 'easy') AS difficulty,
 CASE WHEN regexp_matches(text, '(?i)Ctrl\\+|Alt\\+|shortcut|keyboard') THEN 'shortcut' WHEN length(text) < 300 AND regexp_matches(text, '(?i)summary|objective|overview|intro') THEN 'summary' ELSE 'leaf' END AS chunk_type FROM bc)"""
_HOME = "CASE topic_slug " + " ".join(f"WHEN '{s}' THEN '{h}'" for s, h, _ in R.CROSS_REFERENCES) + " ELSE chapter_id END"
_CROSS = "CASE topic_slug " + " ".join(f"WHEN '{s}' THEN '{','.join(o)}'" for s, _, o in R.CROSS_REFERENCES) + " ELSE '' END"


@query(
    "tagged_sections",
    "WITH RECURSIVE " + BOOK_LINES + ",\n" + TAGGED + f" SELECT doc_id, section_no, topic_slug, difficulty, chunk_type, chapter_id || ':' || topic_slug AS concept_id, {_HOME} AS home_chapter, {_CROSS} AS cross_ref FROM tg",
)
def tagged_sections(spark, sf):
    return _tagged(spark, sf).select(
        "doc_id", "section_no", "topic_slug", F.array_join("difficulty", ",").alias("difficulty"), "chunk_type", "concept_id",
        "home_chapter", F.array_join("cross_ref", ",").alias("cross_ref"),
    )


# A table of 1,080 rules made from the most frequent words: 120 a chapter, about the size of a real one.
WORD_RULES = 1080
_WIDE_SQL = f"""bc AS MATERIALIZED (SELECT *, {CH} AS chapter_id FROM bsec),
rw AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{{5,}}')) AS word FROM documents),
rr AS (SELECT word, row_number() OVER (ORDER BY count(*) DESC, word) - 1 AS r FROM rw GROUP BY word),
rules AS MATERIALIZED (SELECT 'ch' || (r % 9 + 1) AS chapter_id, r // 9 AS ordinal, CASE r % 3 WHEN 0 THEN word WHEN 1 THEN word || '.*tion' ELSE word || 's?e' END AS pattern, 'word_' || r AS slug FROM rr WHERE r < {WORD_RULES}),
m1 AS (SELECT doc_id, section_no, arg_min(slug, ordinal) AS slug FROM bc JOIN rules USING (chapter_id) WHERE regexp_matches(section_heading, '(?i)' || pattern) GROUP BY ALL),
m2 AS (SELECT doc_id, section_no, arg_min(slug, ordinal) AS slug FROM bc JOIN rules USING (chapter_id) WHERE regexp_matches(substring(text, 1, 300), '(?i)' || pattern) GROUP BY ALL)"""


def word_rules(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0))).alias("word"))
    top = words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(WORD_RULES)
    ranked = top.withColumn("r", F.row_number().over(Window.orderBy(F.desc("count"), "word")) - 1)
    kind = F.col("r") % 3
    return ranked.select(
        F.concat(F.lit("ch"), (F.col("r") % 9 + 1).cast("string")).alias("chapter_id"), F.floor(F.col("r") / 9).cast("int").alias("ordinal"),
        F.when(kind == 0, F.col("word")).when(kind == 1, F.concat("word", F.lit(".*tion"))).otherwise(F.concat("word", F.lit("s?e"))).alias("pattern"),
        F.concat(F.lit("word_"), F.col("r").cast("string")).alias("slug"),
        F.array(F.lit("apply")).alias("bloom_levels"), F.array(F.lit("medium")).alias("difficulty"),
    )


@query(
    "tagged_sections_by_word_rules",
    "WITH RECURSIVE " + BOOK_LINES + ",\n" + _WIDE_SQL + f" SELECT bc.doc_id, bc.section_no, coalesce(m1.slug, m2.slug, {_FALLBACK}) AS topic_slug FROM bc LEFT JOIN m1 USING (doc_id, section_no) LEFT JOIN m2 USING (doc_id, section_no)",
)
def tagged_sections_by_word_rules(spark, sf):
    sections = S.book_sections(_book_text(spark, sf)).withColumn("chapter_id", F.concat(F.lit("ch"), (F.col("doc_id") % 9 + 1).cast("string")))
    return S.tag_slugs(sections, word_rules(spark, sf)).select("doc_id", "section_no", "topic_slug")


_STOP = ", ".join(f"'{w}'" for w in X.KEYWORD_STOP)
_KW = f"""list_sort(list_distinct(list_concat(list_filter(list_concat(regexp_extract_all(text, '{X.KEYWORD_ACRONYM}'), regexp_extract_all(text, '{X.KEYWORD_NAME}')), lambda w: NOT list_contains([{_STOP}], w)),
 regexp_extract_all(text, '{X.KEYWORD_CTRL}'))))[1:8]"""


# The SQL engine's word border knows ASCII only: other Latin letters become a word character first.
_ASCII = "regexp_replace(text, '[\\x{C0}-\\x{D6}\\x{D8}-\\x{F6}\\x{F8}-\\x{24F}]', '_', 'g')"


KEYWORDS_SQL = f"SELECT doc_id, array_to_string({_KW}, ',') AS keywords FROM (SELECT doc_id, {_ASCII} AS text FROM documents)"


@query("keywords", KEYWORDS_SQL)
def keywords(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(X.keywords(F.col("text")), ",").alias("keywords"))


def _raw_chunks(spark, sf):
    d = table(spark, sf, "documents")
    n = F.lit(None).cast("string")
    return d.select(
        F.concat(F.lit("chunk-"), X.zero_padded(F.col("doc_id"), 4)).alias("id"), "text", n.alias("book"),
        F.col("lang").alias("chapter"), F.when(F.col("doc_id") % 5 == 0, "mcq").otherwise("content").alias("content_type"),
        F.col("source").alias("section"), n.alias("subsection"), n.alias("question_no"), n.alias("question_type"), n.alias("term"),
    )


@query("recursive_chunks")
def recursive_chunks(spark, sf):
    return S.expand_chunks(_raw_chunks(spark, sf), "chunks.jsonl").select(
        "source_id", "chunk_index", F.length("text").alias("n"), F.md5("text").alias("digest")
    )


_WIN = "SELECT doc_id, i AS window_no, substring(text, i * 650 + 1, 800) AS piece FROM documents, LATERAL (SELECT unnest(range(0, 1 + greatest(CAST(ceil((length(text) - 800) / 650) AS BIGINT), 0))) AS i)"


@query("fixed_windows", f"SELECT doc_id, CAST(window_no AS INT) AS window_no, md5(piece) AS digest FROM ({_WIN})")
def fixed_windows(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.posexplode(S.fixed_windows(F.col("text"))).alias("window_no", "piece")).select(
        "doc_id", "window_no", F.md5("piece").alias("digest")
    )


ATOM_SQL = f"""atoms AS (SELECT 'chunk-' || lpad(CAST(doc_id AS VARCHAR), CAST(greatest(4, length(CAST(doc_id AS VARCHAR))) AS INT), '0') AS source_id, lang AS chapter, source AS section, {strip_sql('text')} AS text FROM documents WHERE doc_id % 5 = 0 OR length({strip_sql('text')}) <= 800)"""


@query(
    "chunk_metadata",
    with_(ATOM_SQL, body="SELECT 'chunk-' || substring(sha1(source_id || '|' || chapter || '|0|' || substring(text, 1, 200)), 1, 20) AS id, 'book' AS book, chapter, section, length(text) AS char_count, substring(text, 1, 512) AS text FROM atoms WHERE text <> ''"),
)
def chunk_metadata(spark, sf):
    whole = S.expand_chunks(_raw_chunks(spark, sf), "chunks.jsonl").where(
        (F.col("content_type") == "mcq") | (F.length("text") <= 800)
    )
    # Pieces of split prose are compared by the brute-force test; here every unsplit chunk.
    counts = whole.groupBy("source_id").agg(F.max("chunk_index").alias("m"))
    return S.chunk_metadata(
        whole.join(counts.where("m = 0").select("source_id"), "source_id", "left_semi")
    ).select("id", "book", "chapter", "section", "char_count", "text")


@query("ingest_by_content_type", "SELECT doc_id AS n FROM documents WHERE doc_id % 5 = 0")
def ingest_by_content_type(spark, sf):
    from ..operators.vector import metadata_filter

    kept = metadata_filter(_raw_chunks(spark, sf), content_type=["mcq", "glossary"])
    return kept.select(F.regexp_extract("id", r"(\d+)$", 1).cast("bigint").alias("n"))
