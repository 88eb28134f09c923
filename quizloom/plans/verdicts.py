"""Queries: verdict batches, reconciliation, stage chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import reference_values as R
from ..functions import text as X
from ..operators import dedup as D
from ..operators import quality as QP
from ..operators import verdicts as V
from ..operators import vector as VE
from ..operators.ordered import batch_numbers
from .balance import POSITION_SQL
from .catalog import query, with_
from .dedup import SEMANTIC_CTES, VEC_SQL, anchors_sql, vector_items
from .items import ITEMS_SQL, items
from .bank import HASH
from .rules import BALANCE_SQL, END_SQL, FORMAT_SQL, SCOPE_SQL, SIGNAL_SQL, STATEMENT_SQL, STRUCTURE_SQL
from .vectors import DIST_REASON_SQL, DIST_SQL, OPTION_VEC_SQL, option_vectors

KEYS = ["exam_set"]
BATCH = "batched AS (SELECT *, CAST(floor((position - 1) / {n}) AS INT) AS batch_no, CAST((position - 1) % {n} + 1 AS INT) AS item_no FROM items)"
B25 = BATCH.format(n=25)
NL = "chr(10)"


def _texts(name: str, size: int, render, line_sql: str):
    @query(
        name,
        with_(ITEMS_SQL, BATCH.format(n=size), body=f"SELECT exam_set, batch_no, CAST(count(*) AS INT) AS expected, md5(string_agg({line_sql}, {NL} || {NL} ORDER BY item_no)) AS digest FROM batched GROUP BY ALL"),
    )
    def run(spark, sf):
        texts = V.batch_texts(items(spark, sf), KEYS, "position", size, render)
        return texts.select("exam_set", "batch_no", "expected", F.md5("batch_text").alias("digest"))

    return run


_OPT = "array_to_string(list_transform(options, lambda o, i: {pre}chr(CAST(64 + i AS INT)) || '){sep}' || o), {join})"
_texts(
    "verdict_batch_texts", 25, V.verdict_text,
    f"item_no || '. Q: ' || question || {NL} || '   Options: ' || " + _OPT.format(pre="", sep="", join="' '") + f" || {NL} || '   Marked answer: ' || correct_answer",
)
_texts(
    "quality_batch_texts", 20, V.quality_text,
    f"'[Q' || item_no || '] Type: ' || question_type || {NL} || 'Question: ' || question || {NL} || 'Options:' || {NL} || " + _OPT.format(pre="'   ' || ", sep=" ", join=NL) + f" || {NL} || 'Correct: ' || correct_answer",
)
_texts(
    "distractor_batch_texts", 15, V.distractor_text,
    f"'[Q' || item_no || '] Type: ' || question_type || {NL} || 'Question: ' || question || {NL} || 'Correct answer: ' || correct_answer || {NL} || 'Distractors (wrong options):' || {NL} || array_to_string(list_transform(list_filter(options, lambda o: o <> correct_answer), lambda o: '   - ' || o), {NL})",
)

ELEMENT = "struct<is_correct:boolean,reasoning:string,suggested_answer:string,independent_answer:string>"
# What a judge would say, from the labels: the verdict, a prefixed suggestion, its own answer.
VERDICT_SQL = """judge AS (SELECT *, quality = 1 AS is_correct, CASE WHEN quality = 0 AND id % 2 = 0 THEN 'B) ' || upper(options[2]) || '.' WHEN quality = 0 THEN 'none of these' ELSE '' END AS suggested_answer,
 CASE WHEN id % 7 = 0 THEN options[3] WHEN id % 3 = 0 THEN 'A) ' || correct_answer || '!' ELSE '' END AS independent_answer FROM batched WHERE TRUE)"""
FINAL_SQL = """final AS (SELECT *, coalesce(is_correct, FALSE) AS ok, id % 7 = 0 AND options[3] <> correct_answer AS disagrees FROM judge)"""


def judged_items(spark, sf):
    opt = lambda i: F.get("options", F.lit(i))
    return batch_numbers(items(spark, sf), KEYS, "position", 25).withColumns(
        {
            "is_correct": F.coalesce(F.col("quality") == 1, F.lit(False)),
            "reasoning": F.concat(F.lit("label of "), F.col("question_uuid"), F.lit(" [see notes]")),
            "suggested_answer": F.when((F.col("quality") == 0) & (F.col("id") % 2 == 0), F.concat(F.lit("B) "), F.upper(opt(1)), F.lit(".")))
            .when(F.col("quality") == 0, "none of these").otherwise(""),
            "independent_answer": F.when(F.col("id") % 7 == 0, opt(2))
            .when(F.col("id") % 3 == 0, F.concat(F.lit("A) "), "correct_answer", F.lit("!"))).otherwise(""),
        }
    )


def responses(spark, sf):
    """Free-text answers of a judge, one per batch: fenced, bare, in prose, cut off, one short."""
    fields = F.struct("item_no", F.struct("is_correct", "reasoning", "suggested_answer", "independent_answer").alias("v"))
    batches = judged_items(spark, sf).groupBy("exam_set", "batch_no").agg(F.sort_array(F.collect_list(fields)).alias("l"))
    kind = F.pmod(F.col("exam_set") + F.col("batch_no"), F.lit(5))
    full = F.to_json(F.transform("l", lambda x: x["v"]))
    short = F.to_json(F.transform(F.slice("l", 1, F.size("l") - 1), lambda x: x["v"]))
    text = (
        F.when(kind == 0, F.concat(F.lit("```json\n"), full, F.lit("\n```")))
        .when(kind == 1, full)
        .when(kind == 2, F.concat(F.lit("Here are the verdicts:\n"), full, F.lit("\nThat is all.")))
        .when(kind == 3, F.regexp_replace(F.expr("substring(" + "to_json(transform(l, x -> x.v)), 1, 200)"), "\\]", ")"))
        .otherwise(short)
    )
    return batches.select("exam_set", "batch_no", text.alias("response"))


PARSE_SQL = "nb AS (SELECT exam_set, batch_no, count(*) AS n, (exam_set + batch_no) % 5 AS kind FROM batched GROUP BY ALL)"


@query(
    "parsed_responses",
    with_(ITEMS_SQL, B25, PARSE_SQL, body="SELECT exam_set, batch_no, CASE kind WHEN 3 THEN NULL WHEN 4 THEN n - 1 ELSE n END AS parsed FROM nb"),
)
def parsed_responses(spark, sf):
    return V.parse_responses(responses(spark, sf), ELEMENT).select("exam_set", "batch_no", "parsed")


@query(
    "verdict_routes",
    with_(ITEMS_SQL, B25, PARSE_SQL, body="SELECT b.id, CASE WHEN kind < 3 THEN 'batch' ELSE 'single' END AS route, CASE WHEN kind < 3 THEN coalesce(b.quality = 1, FALSE) END AS is_correct FROM batched b JOIN nb USING (exam_set, batch_no)"),
)
def verdict_routes(spark, sf):
    batched = batch_numbers(items(spark, sf).select("id", "exam_set", "position"), KEYS, "position", 25)
    joined = V.join_verdicts(batched, V.parse_responses(responses(spark, sf), ELEMENT), KEYS)
    return joined.select("id", "route", F.col("verdict.is_correct").alias("is_correct"))


@query(
    "reconciled_verdicts",
    with_(
        ITEMS_SQL, B25, VERDICT_SQL, FINAL_SQL,
        body="SELECT id, ok AND NOT disagrees AS passed, CASE WHEN NOT ok THEN 'judge' WHEN disagrees THEN 'independent_answer' END AS verdict_reason, CASE WHEN NOT (ok AND NOT disagrees) AND quality = 0 AND id % 2 = 0 THEN list_filter(options, lambda o: lower(o) = lower(options[2]))[1] END AS suggested FROM final",
    ),
)
def reconciled_verdicts(spark, sf):
    return V.reconcile(judged_items(spark, sf)).select("id", "passed", "verdict_reason", "suggested")


@query(
    "applied_suggestions",
    with_(
        ITEMS_SQL, B25, VERDICT_SQL, FINAL_SQL,
        body="SELECT id, CASE WHEN quality = 0 AND id % 2 = 0 THEN list_filter(options, lambda o: lower(o) = lower(options[2]))[1] ELSE correct_answer END AS correct_answer, NOT (ok AND NOT disagrees) AND NOT (coalesce(quality, 1) = 0 AND id % 2 = 0) AS rejected FROM final",
    ),
)
def applied_suggestions(spark, sf):
    return V.apply_suggestions(V.reconcile(judged_items(spark, sf))).select("id", "correct_answer", "rejected")


def classified(spark, sf):
    """A classifier's answers for labelled questions; some name no valid level."""
    return items(spark, sf).where("quality IS NOT NULL").select(
        "id", F.when(F.col("id") % 10 == 0, "extreme").otherwise("medium").alias("difficulty"),
        F.when(F.col("quality") == 1, "apply").otherwise("understand").alias("bloom_level"),
    )


@query(
    "relabelled_levels",
    with_(ITEMS_SQL, body="SELECT id, CASE WHEN quality IS NOT NULL AND id % 10 <> 0 THEN 'medium' ELSE difficulty END AS difficulty, CASE quality WHEN 1 THEN 'apply' WHEN 0 THEN 'understand' ELSE bloom_level END AS bloom_level FROM items"),
)
def relabelled_levels(spark, sf):
    return V.apply_labels(items(spark, sf), classified(spark, sf)).select("id", "difficulty", "bloom_level")


# An auditor fails every sixth question; where set + batch is a multiple of four it drops one answer.
def _staged_distractors(spark, sf):
    bank = items(spark, sf)
    near = VE.distractor_reason(VE.distractor_scores(bank, option_vectors(spark, sf), R.FIXED_OPTION_TYPES), low=-0.1)
    first = bank.join(near.withColumnRenamed("reason", "near_reason"), "id", "left")
    live = first.where("near_reason IS NULL").select("id", "exam_set", "position", "question_type")
    batched = V.audit_batches(live, KEYS, "position")
    audit = batched.where("q_index IS NOT NULL").where("NOT ((exam_set + batch_no) % 4 = 0 AND q_index = 1)").select(
        "exam_set", "batch_no", "q_index", (F.col("id") % 6 != 0).alias("passed"), F.lit("implausible").alias("reason")
    )
    audited = V.join_audit(batched, audit, KEYS).select("id", "audit_reason")
    return first.join(audited, "id", "left").select(
        "id", V.staged({"embedding": F.col("near_reason"), "audit": F.col("audit_reason")}).alias("reason")
    )


STAGED_SQL = """live AS (SELECT i.*, row_number() OVER (PARTITION BY exam_set ORDER BY position) AS n FROM items i WHERE id NOT IN (SELECT id FROM dreason)),
lb AS (SELECT *, CAST(floor((n - 1) / 15) AS INT) AS batch_no, question_type NOT IN ('assertion_reason', 'sequence_order') AS free FROM live),
lx AS (SELECT *, count_if(free) OVER (PARTITION BY exam_set, batch_no) AS expected FROM lb)"""


@query(
    "staged_distractor_checks",
    with_(
        ITEMS_SQL, OPTION_VEC_SQL, DIST_SQL, DIST_REASON_SQL, STAGED_SQL,
        body="SELECT i.id, coalesce('embedding:' || d.reason, CASE WHEN x.free AND NOT ((x.exam_set + x.batch_no) % 4 = 0 AND x.expected > 0) AND x.id % 6 = 0 THEN 'audit:implausible' END) AS reason FROM items i LEFT JOIN dreason d USING (id) LEFT JOIN lx x USING (id)",
    ),
)
def staged_distractor_checks(spark, sf):
    return _staged_distractors(spark, sf)


PASS_DET = f"coalesce({END_SQL}, {BALANCE_SQL}, {STATEMENT_SQL}, CASE WHEN question_type = 'match_following' THEN 'unreadable_columns' END)"
PASS_LEAK = f"""facts2 AS (SELECT exam_set, id, correct_answer AS answer, {anchors_sql("question || ' ' || array_to_string(options, ' ')")} AS a FROM items),
anch AS (SELECT exam_set, id, unnest(a) AS anchor FROM facts2),
leak AS (SELECT j.exam_set, j.id, min(i.anchor) AS anchor FROM facts2 j JOIN anch i ON i.exam_set = j.exam_set AND i.id <> j.id
 WHERE contains(replace(upper(j.answer), ' ', ''), replace(upper(i.anchor), ' ', '')) OR contains(replace(upper(i.anchor), ' ', ''), replace(upper(j.answer), ' ', ''))
 OR contains(lower(trim(j.answer)), i.anchor) OR contains(i.anchor, lower(trim(j.answer))) GROUP BY ALL)"""


@query(
    "quality_pass",
    "WITH RECURSIVE " + ",\n".join(
        [ITEMS_SQL, VEC_SQL, OPTION_VEC_SQL, DIST_SQL, DIST_REASON_SQL, "skewed AS (SELECT * FROM items)", POSITION_SQL, PASS_LEAK,
         "sem AS (SELECT id FROM (SELECT id, min(id) OVER (PARTITION BY exam_set, chapter_no, vec_id) AS f FROM vecs) WHERE id <> f)"]
    )
    + f""" SELECT i.id, coalesce('deterministic:' || {PASS_DET}, CASE WHEN s.id IS NOT NULL THEN 'semantic:near_duplicate' END, 'distractor:' || d.reason,
 CASE WHEN i.id % 6 = 0 THEN 'distractor_audit:implausible' END, CASE WHEN i.id % 13 = 0 THEN 'wording_audit:grammar' END,
 CASE WHEN p.flagged THEN 'skew:position' END, 'leak:fact ' || l.anchor) AS reason
 FROM items i LEFT JOIN sem s ON s.id = i.id LEFT JOIN dreason d ON d.id = i.id LEFT JOIN fold p ON p.id = i.id LEFT JOIN leak l ON l.id = i.id""",
)
def quality_pass(spark, sf):
    bank = vector_items(spark, sf)
    said = lambda n, why: bank.select("id", F.when(F.col("id") % n == 0, why).alias("audit_reason"))
    return QP.quality_pass(bank, option_vectors(spark, sf), said(6, "implausible"), said(13, "grammar"), distractor_low=-0.1)


AFTER_SQL = f"""sem2 AS (SELECT DISTINCT id FROM semdup),
checked AS (SELECT i.id, i.exam_set, i.question_uuid, i.chapter, i.retry_count, {HASH} AS h, coalesce({STRUCTURE_SQL}, 'formatting:' || {FORMAT_SQL}) AS why,
 coalesce(CASE WHEN ({SIGNAL_SQL} IS NOT NULL OR question_type IN ('assertion_reason', 'scenario_based', 'sequence_order')) AND quality IS NULL THEN 'difficulty_bloom:unclassified' END,
 'course_alignment:' || {SCOPE_SQL}, CASE WHEN s.id IS NOT NULL THEN 'semantic_duplicate:semantic' END) AS later FROM items i LEFT JOIN sem2 s ON s.id = i.id),
firsts AS (SELECT h, min(id) AS head, arg_min(exam_set, id) AS head_set FROM checked WHERE why IS NULL AND later IS NULL GROUP BY h),
after AS (SELECT id, question_uuid, chapter, least(retry_count, 3) AS attempts,
 coalesce('rule_engine:' || coalesce(why, CASE WHEN head < id THEN 'duplicate:' || CASE WHEN head_set = exam_set THEN 'within_set' ELSE 'across_sets' END END), later) AS failed_stage
 FROM checked LEFT JOIN firsts USING (h))"""
AFTER_CTES = (ITEMS_SQL, *SEMANTIC_CTES, AFTER_SQL)


#: What the log of rejections reads.
LOGGED = ["id", "created_epoch", "question_uuid", "exam_set", "chapter", "question", "correct_answer", "difficulty"]


def _after(spark, sf, keep, fuzzy=False):
    bank = vector_items(spark, sf)
    sem = D.semantic_duplicates(bank.where("validation_status <> 'approved'"), bank.where("validation_status = 'approved'"), ["exam_set"])
    # The edit ratio has no SQL; the queries with SQL leave its tiers to those ``_with_fuzzy_tier``.
    return QP.after_verdict(bank, classified(spark, sf), sem, fuzzy, keep)


@query("stage_chain", with_(*AFTER_CTES, body="SELECT id, failed_stage, attempts FROM after"))
def stage_chain(spark, sf):
    return _after(spark, sf, ["id"]).select("id", "failed_stage", "attempts")


@query(
    "stage_rejections",
    with_(*AFTER_CTES, body="SELECT question_uuid, chapter, split_part(failed_stage, ':', 1) AS validator_failed, substring(failed_stage, strpos(failed_stage, ':') + 1) AS reason FROM after WHERE failed_stage IS NOT NULL"),
)
def stage_rejections(spark, sf):
    return _rejected(_after(spark, sf, LOGGED))


@query("stage_chain_with_fuzzy_tier")
def stage_chain_with_fuzzy_tier(spark, sf):
    return _after(spark, sf, ["id"], True).select("id", "failed_stage", "attempts")


@query("stage_rejections_with_fuzzy_tier")
def stage_rejections_with_fuzzy_tier(spark, sf):
    return _rejected(_after(spark, sf, LOGGED, True))


def _rejected(chain):
    from ..operators.bank import rejection_log

    failed = chain.where("failed_stage IS NOT NULL").withColumns(
        {
            "validator_failed": F.substring_index("failed_stage", ":", 1),
            "reason": F.expr("substring(failed_stage, instr(failed_stage, ':') + 1)"),
        }
    )
    return rejection_log(failed).select("question_uuid", "chapter", "validator_failed", "reason")


@query(
    "replaced_questions",
    with_(ITEMS_SQL, body="SELECT id, CASE WHEN validation_status = 'approved' THEN 'kept' WHEN position % 2 = 0 THEN 'replaced' ELSE 'short' END AS outcome, CASE WHEN validation_status <> 'approved' AND position % 2 = 0 THEN 'r-' || id ELSE question_uuid END AS question_uuid FROM items"),
)
def replaced_questions(spark, sf):
    bank = items(spark, sf)
    results = bank.select("id", F.when(F.col("validation_status") != "approved", F.col("validation_status")).alias("reason"))
    new = bank.where("position % 2 = 0").select("exam_set", "position", F.upper("question").alias("question"), F.concat(F.lit("r-"), F.col("id").cast("string")).alias("question_uuid"))
    return V.with_replacements(bank, results, new).select("id", "outcome", "question_uuid")
