"""Queries: vector search, namespaces, slugs, distractors."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import reference_values as R
from ..functions import text as X
from ..operators import cells as C
from ..operators import vector as V
from .catalog import query, with_
from .items import ITEMS_SQL, items, table


def corpus(spark, sf):
    """Every document with a vector and filter columns; documents beyond the vectors share some."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "source", "lang")
    emb = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"), "label")
    n = emb.count()
    return docs.withColumn("vec_id", (F.col("id") * 7) % n).join(emb, "vec_id").select("id", "vec", "label", "text", "source", "lang")


CORPUS_SQL = "corpus AS (SELECT d.doc_id AS id, e.embedding AS vec, e.label, d.text, d.source, d.lang FROM documents d JOIN embeddings e ON e.vec_id = (d.doc_id * 7) % (SELECT count(*) FROM embeddings))"


def passages(spark, sf):
    """One query per benchmark passage, asking inside one label."""
    emb = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    n = emb.count()
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"))
    return b.join(emb, b.query_id % n == emb.vec_id).select("query_id", "vec", (F.col("query_id") % 10).cast("int").alias("label"))


QUERY_SQL = "ask AS (SELECT b.item_id AS query_id, e.embedding AS vec, CAST(b.item_id % 10 AS INT) AS label FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id % (SELECT count(*) FROM embeddings))"
SCORE = "round(list_inner_product(CAST(q.vec AS DOUBLE[]), CAST(c.vec AS DOUBLE[])), 6)"


def _topk_sql(k: int, on: str = "q.label = c.label", where: str = "TRUE", src: str = "corpus") -> str:
    return f"SELECT query_id, id, score, rank FROM (SELECT q.query_id, c.id, {SCORE} AS score, row_number() OVER (PARTITION BY q.query_id ORDER BY {SCORE} DESC, c.id) AS rank FROM ask q JOIN {src} c ON {on} WHERE {where}) WHERE rank <= {k}"


@query("vector_top_k", with_(CORPUS_SQL, QUERY_SQL, body=_topk_sql(5, "TRUE")))
def vector_top_k(spark, sf):
    return V.top_k(corpus(spark, sf), passages(spark, sf), 5)


@query("vector_top_k_filtered", with_(CORPUS_SQL, QUERY_SQL, body=_topk_sql(5)))
def vector_top_k_filtered(spark, sf):
    return V.top_k(corpus(spark, sf), passages(spark, sf), 5, ["label"])


@query("metadata_filter", with_(CORPUS_SQL, QUERY_SQL, body=_topk_sql(3, "TRUE", "c.lang = 'en' AND c.source IN ('src1', 'src2', 'src3')")))
def metadata_filter(spark, sf):
    kept = V.metadata_filter(corpus(spark, sf), lang="en", source=["src1", "src2", "src3"])
    return V.top_k(kept, passages(spark, sf), 3)



def _index(spark, sf):
    return C.build(corpus(spark, sf).drop("text"), ["label", "lang", "source"])


@query("indexed_top_k_filtered", with_(CORPUS_SQL, QUERY_SQL, body=_topk_sql(5)))
def indexed_top_k_filtered(spark, sf):
    return C.search(_index(spark, sf), passages(spark, sf), 5, ["label"])


@query("indexed_metadata_filter", with_(CORPUS_SQL, QUERY_SQL, body=_topk_sql(3, "TRUE", "c.lang = 'en' AND c.source IN ('src1', 'src2', 'src3')")))
def indexed_metadata_filter(spark, sf):
    return C.search(_index(spark, sf), passages(spark, sf), 3, lang="en", source=["src1", "src2", "src3"])


_WORDS = f"list_filter(string_split_regex(lower(text), '{X.WS}+'), lambda w: w <> '')"


def rerank_sql(k: int, on: str) -> str:
    """Each step takes the candidate with the best 0.6 * score - 0.4 * largest overlap with those taken."""
    return f"""near AS MATERIALIZED (SELECT * FROM (SELECT q.query_id, c.id, c.text, {SCORE} AS score, CAST(row_number() OVER (PARTITION BY q.query_id ORDER BY {SCORE} DESC, c.id) AS INT) AS rank
 FROM ask q JOIN corpus c ON {on}) WHERE rank <= {V.CANDIDATES}),
wordy AS (SELECT id, any_value({_WORDS}) AS w FROM near GROUP BY id),
grams AS MATERIALIZED (SELECT id, CASE WHEN len(w) > 1 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE [] END AS g FROM wordy),
ids AS (SELECT DISTINCT a.id AS a, b.id AS b FROM near a JOIN near b USING (query_id) WHERE a.id < b.id),
over0 AS MATERIALIZED (SELECT a, b, CASE WHEN len(x.g) = 0 OR len(y.g) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(x.g, y.g)) / CAST(len(x.g) + len(y.g) - len(list_intersect(x.g, y.g)) AS DOUBLE) END AS o
 FROM ids JOIN grams x ON x.id = a JOIN grams y ON y.id = b),
over1 AS MATERIALIZED (SELECT * FROM over0 UNION ALL SELECT b, a, o FROM over0),
rows1 AS MATERIALIZED (SELECT n.query_id, n.rank, any_value(n.score) AS score, list(coalesce(v.o, 1.0) ORDER BY m.rank) AS o
 FROM near n JOIN near m USING (query_id) LEFT JOIN over1 v ON v.a = n.id AND v.b = m.id GROUP BY n.query_id, n.rank),
steps(query_id, n, taken, mmr) AS (SELECT query_id, 1, [1], 0.6 * score FROM rows1 WHERE rank = 1 UNION ALL
 SELECT query_id, n + 1, list_append(taken, rank), gain FROM (SELECT s.query_id, s.n, s.taken, r.rank, 0.6 * r.score - 0.4 * list_max(list_transform(s.taken, lambda t: r.o[t])) AS gain
  FROM steps s JOIN rows1 r ON r.query_id = s.query_id AND NOT list_contains(s.taken, r.rank) WHERE s.n < {k}) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, rank) = 1),
picked AS (SELECT s.query_id, m.id, m.score, round(s.mmr, 6) AS mmr_score, CAST(s.n AS INT) AS place FROM steps s JOIN near m ON m.query_id = s.query_id AND m.rank = s.taken[s.n])"""


@query("diversified_passages", with_(CORPUS_SQL, QUERY_SQL, rerank_sql(V.DEFAULT_TOP_K, "TRUE"), body="SELECT * FROM picked"))
def diversified_passages(spark, sf):
    c = corpus(spark, sf)
    near = V.top_k(c, passages(spark, sf), V.CANDIDATES)
    return V.diversify(near.join(c.select("id", "text"), "id"))


@query("retrieval", with_(CORPUS_SQL, QUERY_SQL, rerank_sql(6, "q.label = c.label"), body="SELECT * FROM picked"))
def retrieval(spark, sf):
    return V.retrieve(corpus(spark, sf), passages(spark, sf), 6, ["label"])


def _store(spark, sf):
    e = table(spark, sf, "embeddings").select(
        F.concat(F.lit("ns"), (F.col("label") % 3).cast("string")).alias("namespace"), F.col("vec_id").alias("id"),
        F.col("embedding").alias("vec"), F.lit("stored").alias("origin"),
    )
    return e


def _incoming(spark, sf):
    """Every vector arrives again twice: first unchanged, then moved to a later batch."""
    e = _store(spark, sf).where("id % 2 = 0").drop("origin")
    one = e.withColumns({"origin": F.lit("first"), "batch_no": F.lit(0)})
    two = e.where("id % 4 = 0").withColumns({"origin": F.lit("second"), "batch_no": F.lit(1)})
    new = e.withColumns({"id": F.col("id") + 1_000_000, "origin": F.lit("new"), "batch_no": F.lit(0)})
    return one.unionByName(two).unionByName(new)


STORE_SQL = """store AS (SELECT 'ns' || (label % 3) AS namespace, vec_id AS id FROM embeddings),
after_upsert AS (SELECT namespace, id, CASE WHEN id % 4 = 0 THEN 'second' WHEN id % 2 = 0 THEN 'first' ELSE 'stored' END AS origin FROM store
 UNION ALL SELECT namespace, id + 1000000, 'new' FROM store WHERE id % 2 = 0)"""


@query("vector_upsert", with_(STORE_SQL, body="SELECT * FROM after_upsert"))
def vector_upsert(spark, sf):
    return V.upsert(_store(spark, sf), _incoming(spark, sf)).select("namespace", "id", "origin")


@query("namespace_dropped", with_(STORE_SQL, body="SELECT namespace, id FROM store WHERE namespace <> 'ns1'"))
def namespace_dropped(spark, sf):
    return V.drop_namespace(_store(spark, sf), "ns1").select("namespace", "id")


@query("namespace_counts", with_(STORE_SQL, body="SELECT namespace, count(*) AS vectors FROM after_upsert GROUP BY 1"))
def namespace_counts(spark, sf):
    return V.describe(V.upsert(_store(spark, sf), _incoming(spark, sf)))


def slug_pool(spark, sf):
    """Tagged chunks: a chapter, a slug, one or two difficulties, the sets that used them."""
    level = F.element_at(F.array(F.lit("easy"), F.lit("medium"), F.lit("hard")), (F.col("id") % 3 + 1).cast("int"))
    used = F.when(F.col("id") % 4 == 0, F.array(F.lit("1"), F.lit("2"))).when(F.col("id") % 4 == 1, F.array(F.lit("2"))).otherwise(F.array().cast("array<string>"))
    return corpus(spark, sf).select(
        "id", "vec", "text", "source",
        (F.col("label") % 9 + 1).alias("chapter_no"),
        F.concat(F.lit("ch"), (F.col("label") % 9 + 1).cast("string")).alias("chapter_id"),
        F.concat(F.col("source"), F.lit("_"), (F.col("id") % 3).cast("string")).alias("topic_slug"),
        F.array(level, F.lit("hard")).alias("difficulty"),
        F.when(F.col("label") % 9 == 7, F.array(F.lit("1"), F.lit("2"))).otherwise(used).alias("used_in_sets"),
        (F.col("id") % 5).cast("int").alias("q_count"),
    )


POOL_SQL = """pool AS (SELECT id, vec, text, source, label % 9 + 1 AS chapter_no, 'ch' || (label % 9 + 1) AS chapter_id, source || '_' || (id % 3) AS topic_slug,
 [['easy', 'medium', 'hard'][id % 3 + 1], 'hard'] AS difficulty,
 CASE WHEN label % 9 = 7 OR id % 4 = 0 THEN ['1', '2'] WHEN id % 4 = 1 THEN ['2'] ELSE [] END AS used_in_sets, CAST(id % 5 AS INT) AS q_count FROM corpus)"""


def chapter_questions(spark, sf):
    """One query vector per blueprint chapter."""
    emb = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    chapters = spark.createDataFrame([(i + 1, b[0]) for i, b in enumerate(R.BLUEPRINT)], "chapter_no int, chapter_key string")
    return chapters.join(emb, F.col("chapter_no") - 1 == F.col("vec_id")).select("chapter_no", "chapter_key", "vec")


ASK_CHAPTER_SQL = "ask9 AS (SELECT CAST(vec_id + 1 AS INT) AS chapter_no, embedding AS vec FROM embeddings WHERE vec_id < 9)"


@query("ingest_plan", with_(CORPUS_SQL, POOL_SQL, body="SELECT chapter_id, count(*) AS chunks, count(DISTINCT topic_slug) AS slugs FROM pool GROUP BY 1"))
def ingest_plan(spark, sf):
    return V.ingest_plan(slug_pool(spark, sf))


DSCORE = "round(list_inner_product(CAST(q.vec AS DOUBLE[]), CAST(p.vec AS DOUBLE[])), 6)"
OPEN_SQL = f"""sets AS (SELECT DISTINCT CAST(floor(doc_id / 100) AS INT) + 1 AS exam_set FROM documents),
scored AS (SELECT p.*, {DSCORE} AS score FROM pool p JOIN ask9 q ON q.chapter_no = p.chapter_no),
open0 AS (SELECT s.exam_set, p.*, NOT list_contains(p.used_in_sets, CAST(s.exam_set AS VARCHAR)) AS unused FROM sets s, scored p),
openp AS (SELECT * FROM open0 QUALIFY unused OR NOT bool_or(unused) OVER (PARTITION BY exam_set, chapter_no)),
best AS (SELECT * FROM openp QUALIFY row_number() OVER (PARTITION BY exam_set, chapter_no, topic_slug ORDER BY score DESC, id) = 1)"""


@query("available_slugs", with_(CORPUS_SQL, POOL_SQL, ASK_CHAPTER_SQL, OPEN_SQL, body="SELECT exam_set, chapter_no, topic_slug, id, score FROM best"))
def available_slugs(spark, sf):
    from ..operators import slugs as G

    return G.available_slugs(slug_pool(spark, sf), chapter_questions(spark, sf), exam_sets(spark, sf)).select(
        "exam_set", "chapter_no", "topic_slug", "id", "score"
    )


def exam_sets(spark, sf):
    return table(spark, sf, "documents").select((F.floor(F.col("doc_id") / 100) + 1).cast("int").alias("exam_set")).distinct()


OPTION_VEC_SQL = """optv AS (SELECT DISTINCT ON (t) t AS text, e.embedding AS vec FROM (SELECT DISTINCT p_name AS t FROM part) o
 JOIN embeddings e ON e.vec_id = CAST('0x' || substring(md5(t), 1, 15) AS BIGINT) % (SELECT count(*) FROM embeddings))"""
DIST_SQL = """wrong AS (SELECT id, correct_answer, unnest(options) AS option, unnest([0, 1, 2, 3]) AS place FROM items WHERE question_type NOT IN ('assertion_reason', 'sequence_order')),
dist AS (SELECT w.id, w.place, w.option, round(list_inner_product(CAST(a.vec AS DOUBLE[]), CAST(b.vec AS DOUBLE[])), 4) AS sim FROM wrong w
 LEFT JOIN optv a ON a.text = w.correct_answer LEFT JOIN optv b ON b.text = w.option WHERE w.option <> w.correct_answer)"""


def option_vectors(spark, sf):
    emb = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    n = emb.agg(F.count("*")).scalar()
    names = table(spark, sf, "part").select(F.col("p_name").alias("text")).distinct()
    return names.withColumn("vec_id", X.stable_number("text") % n).join(emb, "vec_id").select("text", "vec")


@query("distractor_scores", with_(ITEMS_SQL, OPTION_VEC_SQL, DIST_SQL, body="SELECT id, place, option, sim FROM dist"))
def distractor_scores(spark, sf):
    return V.distractor_scores(items(spark, sf), option_vectors(spark, sf), R.FIXED_OPTION_TYPES).select("id", "place", "option", "sim")


DIST_REASON_SQL = "dreason AS (SELECT id, arg_min('option_' || (place + 1) || '_' || CASE WHEN sim < -0.1 THEN 'distant' ELSE 'too_close' END, place) AS reason FROM dist WHERE sim < -0.1 OR sim > 0.97 GROUP BY id)"


@query("distractor_rule", with_(ITEMS_SQL, OPTION_VEC_SQL, DIST_SQL, DIST_REASON_SQL, body="SELECT DISTINCT d.id, r.reason FROM dist d LEFT JOIN dreason r ON r.id = d.id"))
def distractor_rule(spark, sf):
    scores = V.distractor_scores(items(spark, sf), option_vectors(spark, sf), R.FIXED_OPTION_TYPES)
    return V.distractor_reason(scores, low=-0.1)
