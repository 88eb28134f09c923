"""Queries: metrics of exam sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import reference_values as R
from ..functions import text as X
from ..operators import metrics as M
from .catalog import query, with_
from .items import ITEMS_SQL, alias_sql, blueprint_sql, items

WS = X.WS
BLOOM_SQL = (
    "CASE WHEN (difficulty = 'easy' AND bloom_level IN ('remember', 'understand')) "
    "OR (difficulty = 'medium' AND bloom_level IN ('understand', 'apply')) "
    "OR (difficulty = 'hard' AND bloom_level IN ('apply', 'analyze')) THEN 1 ELSE 0 END"
)
SIMPLE = f"""simple AS (SELECT exam_set, count(*) AS total_questions,
 round_even(sum(CASE WHEN validation_status = 'approved' THEN 1 ELSE 0 END) / count(*) * 100, 1) AS question_accuracy,
 round_even(sum(CASE WHEN list_contains(options, correct_answer) THEN 1 ELSE 0 END) / count(*) * 100, 1) AS answer_accuracy,
 round_even(sum(retry_count) / (count(*) + sum(retry_count)) * 100, 1) AS rejection_rate,
 round_even(sum({BLOOM_SQL}) / count(*) * 100, 1) AS bloom_accuracy,
 coalesce(round_even(avg(CASE WHEN generation_time > 0 THEN generation_time END), 3), 0) AS avg_generation_time,
 round_even(sum(retry_count) / count(*), 2) AS avg_retry_count,
 {", ".join(f"sum(CASE WHEN difficulty = '{d}' THEN 1 ELSE 0 END) AS n_{d}" for d in ("easy", "medium", "hard"))},
 {", ".join(f"sum(CASE WHEN bloom_level = '{d}' THEN 1 ELSE 0 END) AS n_{d}" for d in ("remember", "understand", "apply", "analyze"))}
 FROM items GROUP BY exam_set)"""

TOKENS = f"""tok AS (SELECT DISTINCT exam_set, id, unnest(regexp_split_to_array(lower(question), '{WS}+')) AS w FROM items),
tok2 AS (SELECT * FROM tok WHERE w <> ''), siz AS (SELECT exam_set, id, count(*) AS n FROM tok2 GROUP BY ALL),
shared AS (SELECT a.exam_set, a.id AS i, b.id AS j, count(*) AS c FROM tok2 a JOIN tok2 b
  ON a.exam_set = b.exam_set AND a.w = b.w AND a.id < b.id GROUP BY ALL),
jac AS (SELECT s.*, s.c / (x.n + y.n - s.c) AS jaccard FROM shared s JOIN siz x ON x.id = s.i JOIN siz y ON y.id = s.j)"""
UNIQ = """uniq AS (SELECT t.exam_set, coalesce(p.c, 0) AS near_dup_pairs,
 CASE WHEN t.n > 1 THEN round_even((1 - coalesce(p.c, 0) / (t.n * (t.n - 1) / 2)) * 100, 1) ELSE 100 END AS semantic_uniqueness
 FROM (SELECT exam_set, count(*) AS n FROM items GROUP BY 1) t
 LEFT JOIN (SELECT exam_set, count(*) AS c FROM jac WHERE jaccard > 0.55 GROUP BY 1) p USING (exam_set))"""
OVER = """tg AS (SELECT exam_set, id, unnest(list_distinct(tags)) AS t FROM items), tgn AS (SELECT exam_set, id, count(*) AS n FROM tg GROUP BY ALL),
tgp AS (SELECT s.exam_set, count(*) AS c FROM (SELECT a.exam_set, a.id AS i, b.id AS j, count(*) AS c FROM tg a JOIN tg b
  ON a.exam_set = b.exam_set AND a.t = b.t AND a.id < b.id GROUP BY ALL) s JOIN tgn x ON x.id = s.i JOIN tgn y ON y.id = s.j
  WHERE s.c / least(x.n, y.n) >= 0.8 GROUP BY s.exam_set),
overlap AS (SELECT t.exam_set, coalesce(p.c, 0) AS overlap_pairs, CASE WHEN t.n > 1 THEN round_even(coalesce(p.c, 0) / (t.n * (t.n - 1) / 2) * 100, 1) ELSE 0 END AS concept_overlap
  FROM (SELECT exam_set, count(*) AS n FROM items GROUP BY 1) t LEFT JOIN tgp p USING (exam_set))"""
RESOLVE = """resolved AS (SELECT chapter, coalesce(arg_min(chapter_key, tier * 100 + alias_order), chapter) AS resolved_key, coalesce(min(tier), 4) AS tier FROM (
 SELECT n.chapter, a.alias_order, a.chapter_key, CASE WHEN n.chapter = a.display THEN 1
  WHEN regexp_replace(lower(n.chapter), '[^a-z0-9]', '', 'g') = regexp_replace(lower(a.display), '[^a-z0-9]', '', 'g') THEN 2
  WHEN contains(lower(n.chapter), lower(a.display)) OR contains(lower(a.display), lower(n.chapter)) THEN 3 END AS tier
 FROM (SELECT DISTINCT chapter FROM items) n, aliases a) GROUP BY chapter)"""
COVER = """cnt AS (SELECT exam_set, resolved_key AS chapter_key, count(*) AS actual,
  sum(CASE WHEN difficulty = 'easy' THEN 1 ELSE 0 END) AS e, sum(CASE WHEN difficulty = 'medium' THEN 1 ELSE 0 END) AS m,
  sum(CASE WHEN difficulty = 'hard' THEN 1 ELSE 0 END) AS h FROM items JOIN resolved USING (chapter) GROUP BY ALL),
cover AS (SELECT s.exam_set, b.chapter_no, b.chapter_key, b.min_q, b.max_q, coalesce(c.actual, 0) AS actual,
  coalesce(c.actual, 0) BETWEEN b.min_q AND b.max_q AS in_range,
  CASE WHEN c.actual > 0 THEN 3 - abs(c.e / c.actual - b.easy) - abs(c.m / c.actual - b.medium) - abs(c.h / c.actual - b.hard) ELSE 0 END AS score_sum,
  CASE WHEN c.actual > 0 THEN 3 ELSE 1 END AS score_n
  FROM (SELECT DISTINCT exam_set FROM items) s CROSS JOIN blueprint b LEFT JOIN cnt c ON c.exam_set = s.exam_set AND c.chapter_key = b.chapter_key),
balance AS (SELECT exam_set, round_even(sum(score_sum) / sum(score_n) * 100, 1) AS difficulty_balance,
  sum(CASE WHEN in_range THEN 1 ELSE 0 END) AS chapters_in_range FROM cover GROUP BY 1)"""
ALL = (ITEMS_SQL, SIMPLE, TOKENS, UNIQ, OVER, alias_sql(), RESOLVE, blueprint_sql(), COVER)
METRICS = "SELECT s.*, u.semantic_uniqueness, o.concept_overlap, b.difficulty_balance, b.chapters_in_range FROM simple s JOIN uniq u USING (exam_set) JOIN overlap o USING (exam_set) JOIN balance b USING (exam_set)"


@query("set_metrics", with_(*ALL, body=METRICS))
def set_metrics(spark, sf):
    return M.set_metrics(items(spark, sf))


@query("accuracy_and_rejection", with_(ITEMS_SQL, SIMPLE, body="SELECT exam_set, question_accuracy, answer_accuracy, rejection_rate FROM simple"))
def accuracy_and_rejection(spark, sf):
    return M.simple_metrics(items(spark, sf)).select("exam_set", "question_accuracy", "answer_accuracy", "rejection_rate")


@query("bloom_accuracy", with_(ITEMS_SQL, SIMPLE, body="SELECT exam_set, bloom_accuracy FROM simple"))
def bloom_accuracy(spark, sf):
    return M.simple_metrics(items(spark, sf)).select("exam_set", "bloom_accuracy")


@query("generation_averages", with_(ITEMS_SQL, SIMPLE, body="SELECT exam_set, avg_generation_time, avg_retry_count FROM simple"))
def generation_averages(spark, sf):
    return M.simple_metrics(items(spark, sf)).select("exam_set", "avg_generation_time", "avg_retry_count")


@query("level_distributions", with_(ITEMS_SQL, SIMPLE, body="SELECT exam_set, n_easy, n_medium, n_hard, n_remember, n_understand, n_apply, n_analyze FROM simple"))
def level_distributions(spark, sf):
    return M.simple_metrics(items(spark, sf)).select(
        "exam_set", "n_easy", "n_medium", "n_hard", "n_remember", "n_understand", "n_apply", "n_analyze"
    )


@query("semantic_uniqueness", with_(ITEMS_SQL, TOKENS, UNIQ, body="SELECT * FROM uniq"))
def semantic_uniqueness(spark, sf):
    return M.uniqueness(items(spark, sf))


@query("concept_overlap", with_(ITEMS_SQL, OVER, body="SELECT * FROM overlap"))
def concept_overlap(spark, sf):
    return M.concept_overlap(items(spark, sf))


@query("resolve_chapter_names", with_(ITEMS_SQL, alias_sql(), RESOLVE, body="SELECT * FROM resolved"))
def resolve_chapter_names(spark, sf):
    return M.resolve_chapters(items(spark, sf))


@query("chapter_coverage", with_(ITEMS_SQL, alias_sql(), RESOLVE, blueprint_sql(), COVER, body="SELECT exam_set, chapter_no, chapter_key, min_q, max_q, actual, in_range FROM cover"))
def chapter_coverage(spark, sf):
    return M.chapter_coverage(items(spark, sf)).drop("score_sum", "score_n")


@query("difficulty_balance", with_(ITEMS_SQL, alias_sql(), RESOLVE, blueprint_sql(), COVER, body="SELECT * FROM balance"))
def difficulty_balance(spark, sf):
    return M.difficulty_balance(items(spark, sf))


def _status_sql() -> str:
    arms = []
    for m, warn, crit, lower in R.METRIC_LIMITS:
        bad, poor = (f">= {crit}", f">= {warn}") if lower else (f"< {crit}", f"< {warn}")
        arms.append(
            f"SELECT exam_set, '{m}' AS metric, {m} AS value, CASE WHEN {m} {bad} THEN 'red' WHEN {m} {poor} THEN 'amber' ELSE 'green' END AS status FROM m"
        )
    return " UNION ALL ".join(arms)


@query("metric_status", with_(*ALL, f"m AS ({METRICS})", body=_status_sql()))
def metric_status(spark, sf):
    return M.metric_status(M.set_metrics(items(spark, sf)))


@query(
    "difficulty_shares",
    with_(ITEMS_SQL, body="SELECT exam_set, difficulty AS value, count(*) AS n, CAST(floor(count(*) / sum(count(*)) OVER (PARTITION BY exam_set) * 100 + 0.5) AS BIGINT) AS pct FROM items GROUP BY exam_set, difficulty"),
)
def difficulty_shares(spark, sf):
    return M.shares(items(spark, sf), "difficulty")


@query(
    "coverage_percent_of_max",
    with_(ITEMS_SQL, alias_sql(), RESOLVE, blueprint_sql(), COVER, body="SELECT exam_set, replace(replace(chapter_key, 'chapter_0', 'Ch '), '_', ' ') AS raw_label, round(least(actual / max_q * 100, 100), 4) AS pct FROM cover"),
)
def coverage_percent_of_max(spark, sf):
    return M.chapter_coverage(items(spark, sf)).select(
        "exam_set",
        F.lower(X.label_from_key(F.col("chapter_key"))).alias("l"),
        F.regexp_replace(F.regexp_replace("chapter_key", "^chapter_0?", "Ch "), "_", " ").alias("raw_label"),
        F.round(F.least(F.col("actual") / F.col("max_q") * 100, F.lit(100.0)), 4).alias("pct"),
    ).drop("l")


_POS = "list_position(options, correct_answer)"
_SKEW = (
    "SELECT exam_set, chapter_no, n, n_a, n_b, n_c, n_d, CASE WHEN n >= 8 AND n_a + n_b + n_c + n_d > 0 THEN CASE "
    + " ".join(f"WHEN n_{p} / (n_a + n_b + n_c + n_d) > 0.5 THEN '{p.upper()}'" for p in "abcd")
    + " END END AS skewed_option FROM (SELECT exam_set, chapter_no, count(*) AS n, "
    + ", ".join(f"sum(CASE WHEN {_POS} = {i + 1} THEN 1 ELSE 0 END) AS n_{p}" for i, p in enumerate("abcd"))
    + " FROM items GROUP BY ALL)"
)


@query("answer_position_skew", with_(ITEMS_SQL, body=_SKEW))
def answer_position_skew(spark, sf):
    return M.answer_skew(items(spark, sf), ["exam_set", "chapter_no"])
