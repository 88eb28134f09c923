"""Queries: quotas, balance, allocation, slug sampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import reference_values as R
from ..functions import text as X
from ..operators import balance as B
from ..operators import slugs as G
from ..operators.rules import structure_reason
from ..session import cut_lineage
from .catalog import query, with_
from .items import ITEMS_SQL, blueprint_sql, items, table
from .rules import STRUCTURE_SQL
from .segments import KEYWORDS_SQL
from .vectors import ASK_CHAPTER_SQL, CORPUS_SQL, DSCORE, OPEN_SQL, POOL_SQL, chapter_questions, exam_sets, rerank_sql, slug_pool

N_MIN = sum(b[1] for b in R.BLUEPRINT)
SETS_SQL = "all_sets AS (SELECT DISTINCT CAST(floor(doc_id / 100) AS INT) + 1 AS exam_set FROM documents)"
NUM = "CAST('0x' || substring(md5('{t}' || '|' || s.exam_set || '|' || b.chapter_no), 1, 15) AS BIGINT)"
ALLOC_SQL = f"""drawn AS (SELECT s.exam_set, b.chapter_no, b.chapter_key, b.min_q, b.max_q, b.max_q - b.min_q AS room,
 {NUM.format(t="draw")} AS draw, row_number() OVER (PARTITION BY s.exam_set ORDER BY {NUM.format(t="order")}) AS k FROM all_sets s, blueprint b),
walk AS (SELECT exam_set, CAST(0 AS BIGINT) AS k, 0 AS chapter_no, CAST(0 AS BIGINT) AS add_q, CAST({R.SET_SIZE - N_MIN} AS BIGINT) AS budget FROM all_sets
 UNION ALL SELECT d.exam_set, d.k, d.chapter_no, d.draw % (least(d.room, w.budget) + 1), w.budget - d.draw % (least(d.room, w.budget) + 1)
 FROM walk w JOIN drawn d ON d.exam_set = w.exam_set AND d.k = w.k + 1),
rest AS (SELECT exam_set, min(budget) AS budget FROM walk GROUP BY 1),
spare AS (SELECT d.*, w.add_q, d.room - w.add_q AS free, coalesce(sum(d.room - w.add_q) OVER (PARTITION BY d.exam_set ORDER BY d.chapter_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
 FROM drawn d JOIN walk w ON w.exam_set = d.exam_set AND w.chapter_no = d.chapter_no),
allocation AS (SELECT s.exam_set, s.chapter_no, s.chapter_key, s.min_q, s.max_q, CAST(s.min_q + s.add_q + greatest(least(s.free, r.budget - s.earlier), 0) AS BIGINT) AS quota
 FROM spare s JOIN rest r USING (exam_set))"""


def alloc(body: str, *more: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([SETS_SQL, blueprint_sql(), ALLOC_SQL, *more]) + "\n" + body


@query("set_allocation", alloc("SELECT * FROM allocation"))
def set_allocation(spark, sf):
    return B.allocate(exam_sets(spark, sf))


@query(
    "allocation_invariants",
    with_(SETS_SQL, body="SELECT exam_set, 100 AS total, 9 AS chapters_in_bounds FROM all_sets"),
)
def allocation_invariants(spark, sf):
    ok = F.col("quota").between(F.col("min_q"), F.col("max_q"))
    return B.allocate(exam_sets(spark, sf)).groupBy("exam_set").agg(
        F.sum("quota").alias("total"), F.count_if(ok).alias("chapters_in_bounds")
    )


@query(
    "allocation_report",
    alloc("SELECT exam_set, chapter_key, min_q, max_q, quota FROM allocation UNION ALL SELECT exam_set, 'TOTAL', NULL, NULL, sum(quota) FROM allocation GROUP BY 1"),
)
def allocation_report(spark, sf):
    return B.allocation_report(B.allocate(exam_sets(spark, sf)))


_DIFF = "SELECT exam_set, chapter_no, quota, e AS easy, m + quota - e - m - h AS medium, h AS hard FROM (SELECT a.*, CAST(round_even(b.easy * a.quota, 0) AS BIGINT) AS e, CAST(round_even(b.medium * a.quota, 0) AS BIGINT) AS m, CAST(round_even(b.hard * a.quota, 0) AS BIGINT) AS h FROM allocation a JOIN blueprint b USING (chapter_no))"


@query("difficulty_counts", alloc(_DIFF))
def difficulty_counts(spark, sf):
    return B.difficulty_counts(B.allocate(exam_sets(spark, sf)))


_FMT = ", ".join(f"CAST(round_even({s}::DOUBLE * quota, 0) AS BIGINT) AS {t}" for t, s in R.FORMAT_MIX)
_FSUM = " + ".join(t for t, _ in R.FORMAT_MIX)


@query(
    "format_counts",
    alloc(f"SELECT * REPLACE (greatest(standard + quota - ({_FSUM}), 0) AS standard) FROM (SELECT exam_set, chapter_no, quota, {_FMT} FROM allocation)"),
)
def format_counts(spark, sf):
    return B.format_counts(B.allocate(exam_sets(spark, sf)))


def _survivors(spark, sf):
    return items(spark, sf).where(structure_reason().isNull()).select("id", "question_uuid", "exam_set", "chapter_no", "position")


def _quotas(spark, sf):
    return B.allocate(exam_sets(spark, sf)).select("exam_set", "chapter_no", "quota")


ACCEPT_SQL = f"""ranked AS (SELECT id, question_uuid, exam_set, chapter_no, position, row_number() OVER (PARTITION BY exam_set, chapter_no ORDER BY position) AS place FROM items WHERE {STRUCTURE_SQL} IS NULL),
accepted AS (SELECT r.* FROM ranked r JOIN allocation a USING (exam_set, chapter_no) WHERE r.place <= a.quota)"""


@query("quota_acceptance", alloc("SELECT id, exam_set, chapter_no, place FROM accepted", ITEMS_SQL, ACCEPT_SQL))
def quota_acceptance(spark, sf):
    return B.accept_quota(_survivors(spark, sf), _quotas(spark, sf), ["exam_set", "chapter_no"], "position").select(
        "id", "exam_set", "chapter_no", "place"
    )


@query(
    "quota_shortages",
    alloc(
        "SELECT exam_set, chapter_no, quota, n AS accepted, quota - n AS shortage, CASE WHEN quota - n > 0 THEN CAST(greatest(quota - n + 3, floor((quota - n) * 1.5)) AS BIGINT) ELSE 0 END AS next_batch FROM (SELECT a.exam_set, a.chapter_no, a.quota, count(c.id) AS n FROM allocation a LEFT JOIN accepted c USING (exam_set, chapter_no) GROUP BY ALL)",
        ITEMS_SQL, ACCEPT_SQL,
    ),
)
def quota_shortages(spark, sf):
    keys = ["exam_set", "chapter_no"]
    quotas = _quotas(spark, sf)
    return B.shortages(B.accept_quota(_survivors(spark, sf), quotas, keys, "position"), quotas, keys)


@query("oversampling", alloc("SELECT exam_set, chapter_no, CAST(greatest(quota + 3, floor(quota * 1.5)) AS BIGINT) AS batch FROM allocation"))
def oversampling(spark, sf):
    return _quotas(spark, sf).select("exam_set", "chapter_no", B.oversample(F.col("quota")).alias("batch"))


@query(
    "chapters_in_blueprint_order",
    alloc("SELECT id, exam_set, chapter_no AS blueprint_chapter, CAST(place AS INTEGER) AS blueprint_place, CAST('0x' || substring(md5(question_uuid || '|' || exam_set), 1, 15) AS BIGINT) AS shuffle_key FROM accepted", ITEMS_SQL, ACCEPT_SQL),
)
def chapters_in_blueprint_order(spark, sf):
    acc = B.accept_quota(_survivors(spark, sf), _quotas(spark, sf), ["exam_set", "chapter_no"], "position")
    return B.in_blueprint_order(acc).select("id", "exam_set", "blueprint_chapter", "blueprint_place", "shuffle_key")


# Answers drawn towards the first option, so that the position rule has work to do.
def skewed_answers(spark, sf):
    return items(spark, sf).withColumn(
        "correct_answer", F.when(F.col("id") % 5 != 0, F.get("options", F.lit(0))).otherwise(F.col("correct_answer"))
    )


SKEWED_SQL = "skewed AS (SELECT * EXCLUDE (correct_answer), CASE WHEN id % 5 <> 0 THEN options[1] ELSE correct_answer END AS correct_answer FROM items)"
POSITION_SQL = """placed AS (SELECT id, exam_set, chapter_no, position, CASE WHEN list_contains(options, correct_answer) THEN list_position(options, correct_answer) END AS p,
 count(*) OVER (PARTITION BY exam_set, chapter_no) AS n, row_number() OVER (PARTITION BY exam_set, chapter_no ORDER BY position) AS seen FROM skewed),
fold AS (SELECT exam_set, chapter_no, CAST(0 AS BIGINT) AS seen, [0, 0, 0, 0] AS c, CAST(NULL AS BIGINT) AS id, FALSE AS flagged FROM (SELECT DISTINCT exam_set, chapter_no FROM placed)
 UNION ALL SELECT p.exam_set, p.chapter_no, p.seen,
  CASE WHEN p.p IS NULL OR (p.n >= 8 AND (f.c[p.p] + 1) / p.seen > 0.55 AND f.c[p.p] >= ceil(p.n * 0.45::DOUBLE)) THEN f.c ELSE list_transform(f.c, lambda x, i: CASE WHEN i = p.p THEN x + 1 ELSE x END) END,
  p.id, p.p IS NOT NULL AND p.n >= 8 AND (f.c[p.p] + 1) / p.seen > 0.55 AND f.c[p.p] >= ceil(p.n * 0.45::DOUBLE)
 FROM fold f JOIN placed p ON p.exam_set = f.exam_set AND p.chapter_no = f.chapter_no AND p.seen = f.seen + 1)"""


@query(
    "answer_position_enforcement",
    "WITH RECURSIVE " + ",\n".join([ITEMS_SQL, SKEWED_SQL, POSITION_SQL]) + " SELECT id, flagged FROM fold WHERE id IS NOT NULL",
)
def answer_position_enforcement(spark, sf):
    return B.enforce_answer_positions(skewed_answers(spark, sf), ["exam_set", "chapter_no"], "position").select("id", "flagged")




def assertion_answers(spark, sf):
    return items(spark, sf).withColumns(
        {
            "question_type": F.when(F.col("id") % 3 != 0, "assertion_reason").otherwise("standard"),
            "correct_answer": F.when(F.col("id") % 5 < 3, " both A and R are TRUE and R is the correct explanation of A").otherwise(F.col("correct_answer")),
        }
    )


BIAS_SQL = """ar AS (SELECT id, exam_set, chapter_no, row_number() OVER (PARTITION BY exam_set, chapter_no ORDER BY position) AS r,
 CASE WHEN id % 5 < 3 THEN 1 ELSE 0 END AS a FROM items WHERE id % 3 <> 0),
bias AS (SELECT exam_set, chapter_no, CAST(0 AS BIGINT) AS r, 0 AS acc, 0 AS na, CAST(NULL AS BIGINT) AS id, FALSE AS flagged FROM (SELECT DISTINCT exam_set, chapter_no FROM ar)
 UNION ALL SELECT x.exam_set, x.chapter_no, x.r,
  b.acc + CASE WHEN x.a = 1 AND b.acc >= 3 AND (b.na + 1) / (b.acc + 1) > 0.4 THEN 0 ELSE 1 END,
  b.na + CASE WHEN x.a = 1 AND NOT (b.acc >= 3 AND (b.na + 1) / (b.acc + 1) > 0.4) THEN 1 ELSE 0 END,
  x.id, x.a = 1 AND b.acc >= 3 AND (b.na + 1) / (b.acc + 1) > 0.4
 FROM bias b JOIN ar x ON x.exam_set = b.exam_set AND x.chapter_no = b.chapter_no AND x.r = b.r + 1)"""


@query(
    "assertion_reason_balance",
    "WITH RECURSIVE " + ",\n".join([ITEMS_SQL, BIAS_SQL]) + " SELECT id, flagged FROM bias WHERE id IS NOT NULL UNION ALL SELECT id, FALSE FROM items WHERE id % 3 = 0",
)
def assertion_reason_balance(spark, sf):
    return B.enforce_assertion_balance(assertion_answers(spark, sf), ["exam_set", "chapter_no"], "position").select("id", "flagged")


def _slug_quotas(spark, sf):
    q = G.difficulty_quota(F.col("quota"), F.col("easy"), F.col("medium"), F.col("hard"))
    bp = spark.createDataFrame([(i + 1, b[3], b[4], b[5]) for i, b in enumerate(R.BLUEPRINT)], "chapter_no int, easy double, medium double, hard double")
    return (
        _quotas(spark, sf).join(F.broadcast(bp), "chapter_no")
        .select("exam_set", "chapter_no", F.col("quota").alias("n_questions"), *[v.alias(f"quota_{k}") for k, v in q.items()])
    )


def _available(spark, sf):
    return G.available_slugs(slug_pool(spark, sf), chapter_questions(spark, sf), exam_sets(spark, sf))


def _sampled(spark, sf):
    return G.sample_by_difficulty(_available(spark, sf), _slug_quotas(spark, sf))


SAMPLE_SQL = """sq AS (SELECT a.exam_set, a.chapter_no, a.quota AS n, CAST(round_even(b.easy * a.quota, 0) AS INT) AS e, CAST(round_even(b.medium * a.quota, 0) AS INT) AS m, CAST(round_even(b.hard * a.quota, 0) AS INT) AS h
 FROM allocation a JOIN blueprint b USING (chapter_no)),
qq AS (SELECT exam_set, chapter_no, e + n - e - m - h AS qe, m AS qm, h AS qh FROM sq),
bk AS (SELECT *, difficulty[1] AS bucket, row_number() OVER (PARTITION BY exam_set, chapter_no, difficulty[1] ORDER BY CAST('0x' || substring(md5(exam_set || '|' || chapter_no || '|' || topic_slug), 1, 15) AS BIGINT), topic_slug) AS r FROM best),
sz AS (SELECT exam_set, chapter_no, count_if(bucket = 'easy') AS he, count_if(bucket = 'medium') AS hm, count_if(bucket = 'hard') AS hh FROM bk GROUP BY ALL),
s1 AS (SELECT *, least(qe, he) AS ee FROM sz JOIN qq USING (exam_set, chapter_no)),
s2 AS (SELECT *, least(qe - ee, hm) AS em FROM s1), s3 AS (SELECT *, least(qe - ee - em, hh) AS eh FROM s2),
s4 AS (SELECT *, least(qm, hm - em) AS mm FROM s3), s5 AS (SELECT *, least(qm - mm, he - ee) AS me FROM s4), s6 AS (SELECT *, least(qm - mm - me, hh - eh) AS mh FROM s5),
s7 AS (SELECT *, least(qh, hh - eh - mh) AS h3 FROM s6), s8 AS (SELECT *, least(qh - h3, he - ee - me) AS h1 FROM s7), s9 AS (SELECT *, least(qh - h3 - h1, hm - em - mm) AS h2 FROM s8),
sampled AS (SELECT b.exam_set, b.chapter_no, b.topic_slug, b.id, b.bucket AS target_difficulty FROM bk b JOIN s9 s USING (exam_set, chapter_no)
 WHERE b.r <= CASE b.bucket WHEN 'easy' THEN ee + me + h1 WHEN 'medium' THEN em + mm + h2 ELSE eh + mh + h3 END)"""
SLUG_CTES = (CORPUS_SQL, POOL_SQL, ASK_CHAPTER_SQL, OPEN_SQL, SAMPLE_SQL)


@query("slug_sampling", alloc("SELECT exam_set, chapter_no, topic_slug, target_difficulty FROM sampled", *SLUG_CTES))
def slug_sampling(spark, sf):
    return _sampled(spark, sf).select("exam_set", "chapter_no", "topic_slug", "target_difficulty")


CHUNK_SQL = f"""bestc AS (SELECT p.chapter_no, p.topic_slug, p.id AS chunk_id, {DSCORE} AS chunk_score FROM pool p JOIN ask9 q ON q.chapter_no = p.chapter_no
 QUALIFY row_number() OVER (PARTITION BY p.chapter_no, p.topic_slug ORDER BY {DSCORE} DESC, p.id) = 1),
chunks AS (SELECT s.*, c.chunk_id, c.chunk_score FROM sampled s JOIN bestc c USING (chapter_no, topic_slug))"""


def _chunks(spark, sf):
    return G.chunk_for_slug(_sampled(spark, sf), slug_pool(spark, sf), chapter_questions(spark, sf))


@query("slug_retrieval", alloc("SELECT exam_set, chapter_no, topic_slug, target_difficulty, chunk_id, chunk_score FROM chunks", *SLUG_CTES, CHUNK_SQL))
def slug_retrieval(spark, sf):
    return _chunks(spark, sf).select("exam_set", "chapter_no", "topic_slug", "target_difficulty", "chunk_id", "chunk_score")


@query(
    "passage_rows",
    alloc(
        """SELECT c.exam_set, c.chapter_no, chunk_id AS id, chunk_score AS score, chunk_score AS mmr_score, md5(p.text) AS text_digest, p.chapter_id AS chapter, p.source AS section, c.topic_slug,
 CASE WHEN chunk_id % 2 = 0 THEN 'apply,analyze' ELSE 'remember' END AS bloom_levels, array_to_string(p.difficulty, ',') AS difficulty, w.keywords
 FROM chunks c JOIN pool p ON p.id = c.chunk_id JOIN words9 w ON w.doc_id = c.chunk_id""",
        *SLUG_CTES, CHUNK_SQL, f"words9 AS ({KEYWORDS_SQL})",
    ),
)
def passage_rows(spark, sf):
    levels = F.when(F.col("chunk_id") % 2 == 0, F.array(F.lit("apply"), F.lit("analyze")))
    about = slug_pool(spark, sf).select(
        F.col("id").alias("chunk_id"), "text", "chapter_id", F.col("source").alias("section_heading"), "difficulty", X.keywords(F.col("text")).alias("keywords")
    )
    chunks = _chunks(spark, sf).select("exam_set", "chapter_no", "topic_slug", "chunk_id", "chunk_score").join(about, "chunk_id")
    return G.chunk_passages(chunks.withColumn("bloom_levels", levels)).select(
        "exam_set", "chapter_no", "id", "score", "mmr_score", F.md5("metadata.text").alias("text_digest"), "metadata.chapter", "metadata.section", "metadata.topic_slug",
        *[F.array_join(f"metadata.{c}", ",").alias(c) for c in ("bloom_levels", "difficulty", "keywords")],
    )


PLACED_SQL = """pplace AS (SELECT exam_set, chapter_no, chunk_id, row_number() OVER (PARTITION BY exam_set, chapter_no ORDER BY topic_slug) AS place FROM chunks),
used AS (SELECT p.chunk_id AS id, p.exam_set FROM accepted a JOIN pplace p USING (exam_set, chapter_no, place)),
marked AS (SELECT p.id, list_sort(list_distinct(list_concat(p.used_in_sets, coalesce(u.s, [])))) AS used_in_sets, p.q_count + coalesce(u.n, 0) AS q_count
 FROM pool p LEFT JOIN (SELECT id, list(DISTINCT CAST(exam_set AS VARCHAR)) AS s, count(*) AS n FROM used GROUP BY 1) u USING (id))"""


@query(
    "chunks_marked_used",
    alloc("SELECT id, array_to_string(used_in_sets, ',') AS used, q_count FROM marked", *SLUG_CTES, CHUNK_SQL, ITEMS_SQL, ACCEPT_SQL, PLACED_SQL),
)
def chunks_marked_used(spark, sf):
    keys = ["exam_set", "chapter_no"]
    order = Window.partitionBy(*keys).orderBy("topic_slug")
    passages = _chunks(spark, sf).withColumn("place", F.row_number().over(order)).select(*keys, "place", F.col("chunk_id"))
    accepted = B.accept_quota(_survivors(spark, sf), _quotas(spark, sf), keys, "position").select(*keys, "place")
    used = G.pair_by_rank(passages, accepted, keys).select(F.col("chunk_id").alias("id"), "exam_set")
    return G.mark_used(slug_pool(spark, sf), used).select("id", F.array_join(F.sort_array("used_in_sets"), ",").alias("used"), "q_count")


# Chapter and seed phrase of a set's query; a vector of the table stands for their embedding.
SEEDED_SQL = f"""ask AS MATERIALIZED (SELECT q.*, e.embedding AS vec FROM (SELECT CAST(c * {len(R.SEED_PHRASES)} + s AS BIGINT) AS query_id, CAST(c AS INT) AS chapter_no, CAST(s AS INT) AS seed_no FROM range(1, 10) a(c), range(0, {len(R.SEED_PHRASES)}) b(s)) q
 JOIN embeddings e ON e.vec_id = q.query_id % (SELECT count(*) FROM embeddings)),
unserved AS (SELECT s.exam_set, q.chapter_no FROM all_sets s, (SELECT DISTINCT chapter_no FROM ask) q
 WHERE q.chapter_no = 8 OR NOT EXISTS (SELECT 1 FROM chunks k WHERE k.exam_set = s.exam_set AND k.chapter_no = q.chapter_no))"""


@query(
    "passages_with_fallback",
    alloc(
        f"""SELECT exam_set, chapter_no, chunk_id AS id, 'slug' AS origin, chunk_score AS score, round(chunk_score, 6) AS mmr_score FROM chunks WHERE chapter_no <> 8 UNION ALL
 SELECT u.exam_set, u.chapter_no, p.id, 'cosine', p.score, p.mmr_score FROM unserved u JOIN ask q ON q.chapter_no = u.chapter_no AND q.seed_no = (u.exam_set - 1) % {len(R.SEED_PHRASES)} JOIN picked p ON p.query_id = q.query_id""",
        *SLUG_CTES, CHUNK_SQL, SEEDED_SQL, rerank_sql(8, "c.label % 9 + 1 = q.chapter_no AND c.id % 5 <> 0"),
    ),
)
def passages_with_fallback(spark, sf):
    from .vectors import corpus

    keys = ["exam_set", "chapter_no"]
    # Chapter 8 has no usable slug passages here, so that the plain search must serve it.
    score = F.col("chunk_score")
    served = _chunks(spark, sf).where("chapter_no <> 8").select(*keys, F.col("chunk_id").alias("id"), F.lit("slug").alias("origin"), score.alias("score"), score.alias("mmr_score"))
    served = cut_lineage(served)  # read twice: to find what is missing, and for the result
    emb = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    n, seeds = emb.count(), len(R.SEED_PHRASES)
    asks = spark.range(1, len(R.BLUEPRINT) + 1).select(F.col("id").cast("int").alias("chapter_no"), F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("seed_no"))
    asks = asks.withColumn("vec_id", (F.col("chapter_no") * seeds + F.col("seed_no")) % n).join(emb, "vec_id").drop("vec_id")
    kind = F.when(F.col("id") % 5 == 0, "mcq").otherwise("content").alias("content_type")
    rows = corpus(spark, sf).select("id", "vec", "text", (F.col("label") % 9 + 1).alias("chapter_no"), kind)
    plain = G.fallback_passages(G.unserved(served, _quotas(spark, sf), keys), asks, rows)
    return served.unionByName(plain.select(*keys, "id", F.lit("cosine").alias("origin"), "score", "mmr_score"))
