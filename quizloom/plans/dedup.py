"""Queries: duplicates by text, by vector, and leaked answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import dedup as D
from ..operators import leaks as L
from ..operators import setjoin as S
from ..operators.metrics import JACCARD_LIMIT
from .bank import HASH
from .catalog import query, with_
from .items import ITEMS_SQL, items, table
from .metrics import TOKENS

VEC_SQL = "vecs AS (SELECT i.*, e.embedding AS vec, e.vec_id FROM items i JOIN embeddings e ON e.vec_id = ((i.id // 3) * 7) % (SELECT count(*) FROM embeddings))"


def vector_items(spark, sf):
    """Bank rows with a vector; three neighbours share one, so copies exist."""
    emb = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    n = emb.agg(F.count("*")).scalar()
    return items(spark, sf).withColumn("vec_id", (F.floor(F.col("id") / 3) * 7) % n).join(emb, "vec_id")


DOT = "list_inner_product(CAST(a.vec AS DOUBLE[]), CAST(b.vec AS DOUBLE[]))"


@query("jaccard_pair_counts", with_(ITEMS_SQL, TOKENS, body="SELECT exam_set, count(*) AS pairs FROM jac WHERE jaccard > 0.55 GROUP BY 1"))
def jaccard_pair_counts(spark, sf):
    bank = items(spark, sf)
    return S.jaccard_pair_counts(bank, ["exam_set"], "id", X.word_set(F.col("question")), JACCARD_LIMIT).where("pairs > 0")


@query(
    "jaccard_pairs",
    with_(
        ITEMS_SQL, TOKENS,
        "sig AS (SELECT exam_set, id, md5(string_agg(w, ' ' ORDER BY w)) AS h FROM tok2 GROUP BY ALL), rep AS (SELECT exam_set, h, min(id) AS id FROM sig GROUP BY ALL)",
        body="SELECT j.exam_set, i AS left_rep, j AS right_rep, c AS shared FROM jac j WHERE jaccard > 0.55 AND i IN (SELECT id FROM rep) AND j IN (SELECT id FROM rep)",
    ),
)
def jaccard_pairs(spark, sf):
    bank = items(spark, sf)
    return S.jaccard_pairs(bank, ["exam_set"], "id", X.word_set(F.col("question")), JACCARD_LIMIT).select(
        "exam_set", "left_rep", "right_rep", "shared"
    )


@query("fuzzy_duplicates_in_set")
def fuzzy_duplicates_in_set(spark, sf):
    return D.fuzzy_first_match(items(spark, sf).select("id", "exam_set", "question"), ["exam_set"])


@query("fuzzy_duplicates_across_sets")
def fuzzy_duplicates_across_sets(spark, sf):
    return D.fuzzy_first_match(items(spark, sf).select("id", "exam_set", "question"), [])


@query("fuzzy_against_registry")
def fuzzy_against_registry(spark, sf):
    bank = items(spark, sf).select("id", "question", "validation_status")
    return D.fuzzy_against(bank.where("validation_status <> 'approved'"), bank.where("validation_status = 'approved'"))


@query(
    "cosine_duplicates",
    with_(ITEMS_SQL, VEC_SQL, body="SELECT exam_set, chapter_no, id, f AS flagged_by FROM (SELECT *, min(id) OVER (PARTITION BY exam_set, chapter_no, vec_id) AS f FROM vecs) WHERE id <> f"),
)
def cosine_duplicates(spark, sf):
    return D.cosine_duplicates(vector_items(spark, sf), ["exam_set", "chapter_no"], 0.88)


HEADS_SQL = "heads AS MATERIALIZED (SELECT exam_set, chapter_no, id, vec FROM vecs QUALIFY id = min(id) OVER (PARTITION BY exam_set, chapter_no, vec_id))"
PAIRS_SQL = f"""pairs AS MATERIALIZED (SELECT * FROM (SELECT a.exam_set, a.chapter_no, a.id AS left_id, b.id AS right_id, {DOT} AS score
 FROM heads a JOIN heads b ON a.exam_set = b.exam_set AND a.chapter_no = b.chapter_no AND a.id < b.id) WHERE score >= 0.3)"""
# Heads one after the other: one falls if an earlier head close to it has not fallen.
GREEDY_SQL = """lefts AS MATERIALIZED (SELECT right_id, list(left_id) AS near FROM pairs GROUP BY right_id),
turns AS MATERIALIZED (SELECT right_id AS id, near, row_number() OVER (ORDER BY right_id) AS n FROM lefts),
steps(n, fallen) AS (SELECT CAST(0 AS BIGINT), []::BIGINT[] UNION ALL
 SELECT t.n, CASE WHEN len(list_filter(t.near, lambda x: NOT list_contains(s.fallen, x))) > 0 THEN list_append(s.fallen, t.id) ELSE s.fallen END FROM steps s JOIN turns t ON t.n = s.n + 1),
down AS MATERIALIZED (SELECT unnest(fallen) AS id FROM (SELECT fallen FROM steps ORDER BY n DESC LIMIT 1)),
flags AS MATERIALIZED (SELECT right_id AS id, min(left_id) AS flagged_by FROM pairs WHERE left_id NOT IN (SELECT id FROM down) GROUP BY right_id),
reps AS (SELECT exam_set, chapter_no, id, min(id) OVER (PARTITION BY exam_set, chapter_no, vec_id) AS rep FROM vecs)"""


@query(
    "cosine_duplicates_wide",
    with_(
        ITEMS_SQL, VEC_SQL, HEADS_SQL, PAIRS_SQL, GREEDY_SQL,
        body="SELECT * FROM (SELECT r.exam_set, r.chapter_no, r.id, coalesce(f.flagged_by, CASE WHEN r.id <> r.rep THEN r.rep END) AS flagged_by FROM reps r LEFT JOIN flags f ON f.id = r.rep) WHERE flagged_by IS NOT NULL",
    ),
)
def cosine_duplicates_wide(spark, sf):
    return D.cosine_duplicates(vector_items(spark, sf), ["exam_set", "chapter_no"], 0.30)


@query(
    "cosine_pairs",
    with_(ITEMS_SQL, VEC_SQL, HEADS_SQL, PAIRS_SQL, body="SELECT exam_set, chapter_no, left_id, right_id, round(score, 4) AS score FROM pairs"),
)
def cosine_pairs(spark, sf):
    return D.cosine_pairs(vector_items(spark, sf), ["exam_set", "chapter_no"], 0.30).withColumn("score", F.round("score", 4))


@query(
    "nearest_registered_question",
    with_(
        ITEMS_SQL, VEC_SQL,
        body=f"""SELECT id, neighbour, score FROM (SELECT a.id, b.id AS neighbour, round({DOT}, 6) AS score,
 row_number() OVER (PARTITION BY a.id ORDER BY round({DOT}, 6) DESC, b.id) AS r FROM vecs a JOIN vecs b ON a.exam_set = b.exam_set
 WHERE a.validation_status <> 'approved' AND b.validation_status = 'approved') WHERE r = 1""",
    ),
)
def nearest_registered_question(spark, sf):
    v = vector_items(spark, sf).select("exam_set", "id", "vec", "validation_status")
    return D.nearest_registered(
        v.where("validation_status <> 'approved'"), v.where("validation_status = 'approved'"), ["exam_set"]
    )


# At 0.9 only equal vectors are close, so a candidate falls to the first fresh one with its vector.
SEMANTIC_CTES = (
    VEC_SQL, f"hashed AS MATERIALIZED (SELECT id, exam_set, validation_status, vec, vec_id, {HASH} AS h FROM vecs)",
    f"""olddup AS MATERIALIZED (SELECT a.id, CASE WHEN max(CASE WHEN a.h = b.h THEN 1 ELSE 0 END) = 1 THEN 'exact_text' ELSE 'vector' END AS kind
 FROM hashed a JOIN hashed b ON a.exam_set = b.exam_set AND (a.h = b.h OR {DOT} >= 0.9)
 WHERE a.validation_status <> 'approved' AND b.validation_status = 'approved' GROUP BY a.id)""",
    """fresh AS (SELECT *, id = min(id) OVER (PARTITION BY exam_set, h) AS lead FROM hashed WHERE validation_status <> 'approved' AND id NOT IN (SELECT id FROM olddup)),
 semdup AS (SELECT * FROM olddup UNION ALL SELECT id, 'exact_text' FROM fresh WHERE NOT lead
 UNION ALL SELECT id, 'vector' FROM (SELECT id, min(id) OVER (PARTITION BY exam_set, vec_id) AS f FROM fresh WHERE lead) WHERE id <> f)""",
)


@query("semantic_duplicates", with_(ITEMS_SQL, *SEMANTIC_CTES, body="SELECT id, kind FROM semdup"))
def semantic_duplicates(spark, sf):
    v = vector_items(spark, sf)
    return D.semantic_duplicates(v.where("validation_status <> 'approved'"), v.where("validation_status = 'approved'"), ["exam_set"])


P = {n: getattr(X, n) for n in ("SHORTCUT", "FUNCTION_KEY", "ACRONYM", "FORMULA", "FACT_NUMBER", "PROTOCOL")}


def anchors_sql(t: str) -> str:
    acr = ", ".join(f"regexp_extract_all({t}, '{P['ACRONYM']}', {g})" for g in (1, 2, 3, 4))
    return f"""list_distinct(flatten([list_transform(regexp_extract_all({t}, '{P['SHORTCUT']}'), lambda x: upper(x)),
 list_transform(regexp_extract_all({t}, '{P['FUNCTION_KEY']}'), lambda x: upper(x)),
 list_filter(list_transform(flatten([{acr}]), lambda x: lower(trim(x))), lambda x: length(x) > 1),
 list_transform(regexp_extract_all({t}, '{P['FORMULA']}', 1), lambda x: upper(x) || '()'),
 list_filter(list_transform(regexp_extract_all({t}, '{P['FACT_NUMBER']}', 1), lambda x: lower(x)), lambda x: length(x) >= 2),
 list_transform(regexp_extract_all({t}, '{P['PROTOCOL']}', 1), lambda x: lower(x))]))"""


@query("answer_anchors", f"SELECT doc_id, unnest({anchors_sql('text')}) AS anchor FROM documents")
def answer_anchors(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(X.anchors(F.col("text"))).alias("anchor"))


# Every third question asks for a fact of its own text, so that facts are answers.
LEAK_SQL = f"""facts0 AS (SELECT *, {anchors_sql("question || ' ' || array_to_string(options, ' ')")} AS a FROM items),
facts2 AS (SELECT exam_set, id, a, CASE WHEN id % 3 = 0 AND len(a) > 0 THEN 'about ' || list_min(a) ELSE correct_answer END AS answer FROM facts0),
anch AS (SELECT exam_set, id, unnest(a) AS anchor FROM facts2),
leak AS (SELECT j.exam_set, j.id, min(i.anchor) AS anchor FROM facts2 j JOIN anch i ON i.exam_set = j.exam_set AND i.id <> j.id
 WHERE length(trim(j.answer)) >= 1 AND (
 contains(replace(upper(j.answer), ' ', ''), replace(upper(i.anchor), ' ', '')) OR contains(replace(upper(i.anchor), ' ', ''), replace(upper(j.answer), ' ', ''))
 OR contains(regexp_replace(lower(trim(j.answer)), '\\s+', ' ', 'g'), i.anchor) OR contains(i.anchor, regexp_replace(lower(trim(j.answer)), '\\s+', ' ', 'g')))
 GROUP BY ALL)"""


def leak_bank(spark, sf):
    own = X.anchors(F.concat_ws(" ", F.col("question"), F.array_join("options", " ")))
    bank = items(spark, sf).select("*", F.explode(F.array(own)).alias("own"))
    return bank.withColumn(
        "correct_answer",
        F.when((F.col("id") % 3 == 0) & (F.size("own") > 0), F.concat(F.lit("about "), F.array_min("own"))).otherwise(F.col("correct_answer")),
    ).drop("own")


@query("answer_leaks", with_(ITEMS_SQL, LEAK_SQL, body="SELECT * FROM leak"))
def answer_leaks(spark, sf):
    return L.answer_leaks(leak_bank(spark, sf)).select("exam_set", "id", "anchor")
