"""Queries: projections and normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import reference_values as R
from ..functions import text as X
from ..operators import enrich as E
from ..operators import vector as V
from .bank import HASH
from .catalog import query, with_
from .items import ITEMS_SQL, blueprint_sql, items, table
from .vectors import CORPUS_SQL, QUERY_SQL, SCORE, corpus, passages

WS = X.WS


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


@query("content_hashes", f"SELECT doc_id, {HASH} AS h FROM (SELECT doc_id, text AS question FROM documents)")
def content_hashes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.content_hash(F.col("text")).alias("h"))


_FORM = f"lower({strip_sql(f'''regexp_replace(regexp_replace(regexp_replace({strip_sql('t')}, '^[A-Da-d][).\\]]{WS}*', ''), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '{WS}+', ' ', 'g')''')})"


@query("answer_forms", f"SELECT doc_id, md5({_FORM}) AS digest FROM (SELECT doc_id, 'B)  ' || text || '.' AS t FROM documents)")
def answer_forms(spark, sf):
    t = F.concat(F.lit("B)  "), "text", F.lit("."))
    return table(spark, sf, "documents").select("doc_id", F.md5(X.answer_form(t)).alias("digest"))


@query("collapsed_texts", f"SELECT conv_id, turn, md5(regexp_replace(lower({strip_sql('text')}), '{WS}+', ' ', 'g')) AS digest FROM conversations")
def collapsed_texts(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(X.collapse(F.col("text"))).alias("digest"))


@query("name_keys", "SELECT DISTINCT p_type, regexp_replace(lower(p_type || ' & ' || p_brand), '[^a-z0-9]', '', 'g') AS k FROM part")
def name_keys(spark, sf):
    both = F.concat("p_type", F.lit(" & "), "p_brand")
    return table(spark, sf, "part").select("p_type", X.name_key(both).alias("k")).distinct()


CH_SQL = f"chapters AS (SELECT chapter_no, list_filter(string_split_regex(lower(arg_max(question, id)), '{WS}+'), lambda w: w <> '') AS topics FROM items GROUP BY 1)"


@query(
    "enriched_metadata",
    with_(ITEMS_SQL, CH_SQL, blueprint_sql(), body="SELECT i.id, array_to_string(c.topics[1:5], '|') AS tags, round_even(b.min_q / 100, 2) AS weightage, 'judge-1' AS model_name, 'v2' AS prompt_version, round_even(i.generation_time, 4) AS generation_time, 'approved' AS validation_status FROM items i JOIN chapters c USING (chapter_no) JOIN blueprint b USING (chapter_no)"),
)
def enriched_metadata(spark, sf):
    bank = items(spark, sf)
    chapters = bank.groupBy("chapter_no").agg(F.max_by("question", "id").alias("q")).select("chapter_no", X.words(F.col("q")).alias("topics"))
    return E.enrich(bank, chapters, "judge-1").select(
        "id", F.array_join("tags", "|").alias("tags"), "weightage", "model_name", "prompt_version", "generation_time", "validation_status"
    )


_PASS = f"""near AS (SELECT * FROM (SELECT q.query_id, c.id, row_number() OVER (PARTITION BY q.query_id ORDER BY {SCORE} DESC, c.id) AS rank FROM ask q, corpus c) WHERE rank <= 8),
lines AS (SELECT n.query_id, n.rank, '[Passage ' || n.rank || ']' || CASE WHEN c.source <> '' OR c.lang <> 'en' THEN ' (' || array_to_string(list_filter([c.source, CASE WHEN c.lang = 'en' THEN '' ELSE c.lang END], lambda x: x <> ''), ' › ') || ')' ELSE '' END
 || chr(10) || {strip_sql('c.text')} AS line FROM near n JOIN corpus c ON c.id = n.id)"""


@query("passage_blocks", with_(CORPUS_SQL, QUERY_SQL, _PASS, body="SELECT query_id, md5(string_agg(line, chr(10) || chr(10) ORDER BY rank)) AS digest FROM lines GROUP BY 1"))
def passage_blocks(spark, sf):
    c = corpus(spark, sf)
    near = V.top_k(c, passages(spark, sf), 8).join(
        c.select("id", "text", F.col("source").alias("section"), F.when(F.col("lang") == "en", "").otherwise(F.col("lang")).alias("subsection")), "id"
    )
    return E.passage_blocks(near, "query_id").select("query_id", F.md5("block").alias("digest"))


@query(
    "topic_lists",
    "SELECT doc_id, md5(array_to_string(list_transform(string_split(text, chr(10)), lambda l: '• ' || source || ': ' || l), chr(10))) AS digest FROM documents",
)
def topic_lists(spark, sf):
    d = table(spark, sf, "documents")
    topics = F.transform(F.split("text", "\n"), lambda x: F.struct(F.col("source").alias("topic"), x.alias("notes")))
    return d.select("doc_id", F.md5(E.topic_list(topics)).alias("digest"))


@query(
    "chapter_labels",
    with_(ITEMS_SQL, body="SELECT id, array_to_string(list_transform(string_split(replace(regexp_replace(chapter_key, '^chapter_0?', 'Ch '), '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS label FROM items"),
)
def chapter_labels(spark, sf):
    return items(spark, sf).select("id", X.label_from_key(F.col("chapter_key")).alias("label"))


@query("embedding_texts", "SELECT doc_id, md5(substring(text, 1, 8000)) AS digest FROM documents")
def embedding_texts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(E.embedding_text(F.col("text"))).alias("digest"))


_SEEDS = ", ".join(f"'{s}'" for s in R.SEED_PHRASES)


@query("seed_phrases", with_(ITEMS_SQL, body=f"SELECT id, ([{_SEEDS}])[(exam_set - 1) % 10 + 1] AS phrase FROM items"))
def seed_phrases(spark, sf):
    return items(spark, sf).select("id", E.seed_phrase(F.col("exam_set")).alias("phrase"))


_ID = " ".join(f"WHEN '{b[0]}' THEN '{i}'" for b, (i, _) in zip(R.BLUEPRINT, R.CHAPTER_IDS))
_TITLE = " ".join(f"WHEN '{b[0]}' THEN '{t}'" for b, t in zip(R.BLUEPRINT, R.BOOK_TITLES))


@query("chapter_lookup", with_(ITEMS_SQL, body=f"SELECT id, CASE chapter_key {_ID} END AS chapter_id, CASE chapter_key {_TITLE} END AS book_title FROM items"))
def chapter_lookup(spark, sf):
    return E.chapter_lookup(items(spark, sf)).select("id", "chapter_id", "book_title")


@query("question_vector_metadata", with_(ITEMS_SQL, body="SELECT question_uuid, substring(question, 1, 500) AS question_text, exam_set, chapter FROM items"))
def question_vector_metadata(spark, sf):
    return E.question_vector_metadata(items(spark, sf))


_BG = f"list_filter(string_split_regex(lower(text), '{WS}+'), lambda w: w <> '')"


@query("bigram_counts", f"SELECT item_id, CASE WHEN len(w) > 1 THEN len(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) ELSE 0 END AS n FROM (SELECT item_id, {_BG} AS w FROM benchmark)")
def bigram_counts(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.size(X.bigrams(F.col("text"))).alias("n"))


@query(
    "set_operations_on_tags",
    with_(ITEMS_SQL, body="SELECT a.id, len(list_intersect(a.tags, b.tags)) AS shared, len(list_distinct(list_concat(a.tags, b.tags))) AS joined FROM items a JOIN items b ON a.exam_set = b.exam_set AND b.position = a.position + 1"),
)
def set_operations_on_tags(spark, sf):
    bank = items(spark, sf).select("id", "exam_set", "position", "tags")
    nxt = bank.select("exam_set", (F.col("position") - 1).alias("position"), F.col("tags").alias("next_tags"))
    return bank.join(nxt, ["exam_set", "position"]).select(
        "id", F.size(F.array_intersect("tags", "next_tags")).alias("shared"), F.size(F.array_union("tags", "next_tags")).alias("joined")
    )
