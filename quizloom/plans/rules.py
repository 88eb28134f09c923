"""Queries: data-quality rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import reference_values as R
from ..functions import text as X
from ..operators import quality as QP
from ..operators import rules as Q
from .bank import HASH
from .catalog import query, with_
from .items import ITEMS_SQL, items

WS = X.WS


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


S = strip_sql("question")
END_SQL = f"CASE WHEN NOT regexp_matches({S}, '[?.:]$') AND question_type NOT IN ('match_following', 'sequence_order') THEN 'no_end_mark' END"
OPTION_SQL = (
    "coalesce("
    + ", ".join(
        f"CASE WHEN o <> s THEN 'option_{i}_untrimmed' WHEN s = '' THEN 'option_{i}_empty' WHEN length(s) < 2 THEN 'option_{i}_short' WHEN length(s) > 200 THEN 'option_{i}_long' END".replace(
            "o <>", f"options[{i}] <>"
        ).replace(" s ", f" {strip_sql(f'options[{i}]')} ").replace("(s)", f"({strip_sql(f'options[{i}]')})")
        for i in (1, 2, 3, 4)
    )
    + ")"
)
BALANCE_SQL = "CASE WHEN list_max(list_filter(list_transform(options, lambda o: length(trim(o))), lambda n: n > 0)) / list_min(list_filter(list_transform(options, lambda o: length(trim(o))), lambda n: n > 0)) > 3.5 THEN 'option_length_ratio' END"
STATEMENT_SQL = f"CASE WHEN question_type = 'statement_based' AND NOT regexp_matches(question, '{Q.STATEMENT}') THEN 'no_numbered_statements' END"
MATCH_SQL = f"""CASE WHEN question_type = 'match_following' AND NOT ((contains(lower(question), 'column a') AND contains(lower(question), 'column b'))
 OR (contains(lower(question), 'list i') AND contains(lower(question), 'list ii')) OR (contains(lower(question), 'col a') AND contains(lower(question), 'col b'))
 OR regexp_matches(question, '{Q.PAIRING}')) THEN 'no_columns_named' END"""
FORMAT_SQL = f"""coalesce(CASE WHEN length({S}) = 0 THEN 'empty_question' WHEN length({S}) < 15 THEN 'short_question' WHEN length({S}) > 600 THEN 'long_question' END,
 CASE WHEN regexp_matches({S}, '^\\p{{Ll}}') THEN 'lower_case_start' END, {END_SQL},
 CASE WHEN regexp_matches({S}, CASE WHEN question_type = 'match_following' THEN '[ \\t\\x0B\\f\\x{{A0}}]{{2,}}' ELSE '{WS}{{2,}}' END) THEN 'double_space' END,
 CASE WHEN regexp_matches({S}, '[?!.]{{2,}}') THEN 'repeated_mark' END, {OPTION_SQL}, {BALANCE_SQL}, {STATEMENT_SQL}, {MATCH_SQL})"""
STRUCTURE_SQL = f"""CASE WHEN len(options) <> 4 THEN 'option_count' WHEN NOT list_contains(options, correct_answer) THEN 'answer_not_an_option'
 WHEN len(list_distinct(list_transform(options, lambda o: lower(trim(o))))) <> 4 THEN 'equal_options' WHEN length({S}) < 10 THEN 'short_question' END"""
SCHEMA_SQL = f"""CASE WHEN len(options) <> 4 THEN 'options:' || len(options) WHEN list_contains(list_transform(options, lambda o: trim(o)), '') THEN 'blank_option'
 WHEN difficulty NOT IN ('easy', 'medium', 'hard') THEN 'difficulty' WHEN length({S}) < 10 THEN 'short_question' WHEN trim(correct_answer) = '' THEN 'blank_answer'
 WHEN NOT list_contains(options, correct_answer) THEN 'answer_not_an_option' END"""
LOW_EASY = " OR ".join(f"starts_with(lower(question), '{k}')" for k in R.EASY_SIGNALS)
LOW_HARD = " OR ".join(f"contains(lower(question), '{k}')" for k in R.HARD_SIGNALS)
SIGNAL_SQL = f"CASE WHEN difficulty = 'hard' AND ({LOW_EASY}) AND NOT ({LOW_HARD}) THEN 'easy_words_marked_hard' WHEN difficulty = 'easy' AND ({LOW_HARD}) THEN 'hard_words_marked_easy' END"
SCOPE_SQL = "CASE " + " ".join(f"WHEN contains(lower(question), '{t}') THEN 'out_of_scope:{t}'" for t in R.OUT_OF_SCOPE) + " END"
DUP_SQL = f"""dup AS (SELECT id, exam_set, CASE WHEN id <> min(id) OVER (PARTITION BY h, exam_set) THEN 'within_set' WHEN id <> min(id) OVER (PARTITION BY h) THEN 'across_sets' END AS duplicate
 FROM (SELECT id, exam_set, {HASH} AS h FROM items))"""


def _reason(name: str, column, sql: str):
    @query(name, with_(ITEMS_SQL, body=f"SELECT id, {sql} AS reason FROM items"))
    def run(spark, sf):
        return items(spark, sf).select("id", column().alias("reason"))

    return run


_reason("record_schema_rules", Q.schema_reason, SCHEMA_SQL)
_reason("structure_rules", Q.structure_reason, STRUCTURE_SQL)
_reason("formatting_rules", Q.formatting_reason, FORMAT_SQL)
_reason("option_length_balance", Q.balance_reason, BALANCE_SQL)
_reason("statement_layout", Q.statement_reason, STATEMENT_SQL)
_reason("match_columns_named", Q.match_mention_reason, MATCH_SQL)
_reason("difficulty_signals", Q.difficulty_signal_reason, SIGNAL_SQL)
_reason("course_scope", Q.scope_reason, SCOPE_SQL)
_reason("bloom_for_difficulty", Q.bloom_reason, "CASE WHEN NOT ((difficulty = 'easy' AND bloom_level IN ('remember', 'understand')) OR (difficulty = 'medium' AND bloom_level IN ('understand', 'apply')) OR (difficulty = 'hard' AND bloom_level IN ('apply', 'analyze'))) THEN 'bloom_level' END")


@query(
    "classifier_routing",
    with_(ITEMS_SQL, body=f"SELECT id, {SIGNAL_SQL} IS NOT NULL OR question_type IN ('assertion_reason', 'scenario_based', 'sequence_order') AS needs_classifier, CASE difficulty WHEN 'easy' THEN 'remember' WHEN 'medium' THEN 'understand' ELSE 'apply' END AS assumed_bloom FROM items"),
)
def classifier_routing(spark, sf):
    return items(spark, sf).select("id", Q.needs_classifier().alias("needs_classifier"), Q.default_bloom().alias("assumed_bloom"))


@query(
    "chapter_relabel",
    with_(ITEMS_SQL, body="SELECT id, lower(trim(chapter)) <> lower(trim(display)) AS relabelled, CASE WHEN lower(trim(chapter)) <> lower(trim(display)) THEN display ELSE chapter END AS chapter FROM items"),
)
def chapter_relabel(spark, sf):
    return Q.relabel_chapter(items(spark, sf), "display").select("id", "relabelled", "chapter")


@query(
    "repaired_question_type",
    with_(ITEMS_SQL, body="SELECT id, CASE WHEN id % 3 = 0 THEN 'standard' ELSE question_type END AS question_type FROM items"),
)
def repaired_question_type(spark, sf):
    broken = F.when(F.col("id") % 6 == 0, F.lit(None)).when(F.col("id") % 3 == 0, "essay").otherwise(F.col("question_type"))
    return items(spark, sf).withColumn("question_type", broken).select("id", Q.repaired_type().alias("question_type"))


@query("exact_duplicates", with_(ITEMS_SQL, DUP_SQL, body="SELECT * FROM dup"))
def exact_duplicates(spark, sf):
    return Q.duplicate_kinds(items(spark, sf))


@query(
    "unseen_questions",
    with_(ITEMS_SQL, body=f"SELECT id FROM items WHERE validation_status <> 'approved' AND {HASH} NOT IN (SELECT {HASH} FROM items WHERE validation_status = 'approved')"),
)
def unseen_questions(spark, sf):
    bank = items(spark, sf)
    return Q.unseen(bank.where("validation_status <> 'approved'"), bank.where("validation_status = 'approved'")).select("id")


@query(
    "rule_engine",
    with_(
        ITEMS_SQL,
        f"cheap AS (SELECT id, exam_set, {HASH} AS h, coalesce({STRUCTURE_SQL}, 'formatting:' || {FORMAT_SQL}) AS why FROM items)",
        "firsts AS (SELECT h, min(id) AS head, arg_min(exam_set, id) AS head_set FROM cheap WHERE why IS NULL GROUP BY h)",
        body="SELECT id, coalesce(why, CASE WHEN head < id THEN 'duplicate:' || CASE WHEN head_set = exam_set THEN 'within_set' ELSE 'across_sets' END END) AS reason FROM cheap LEFT JOIN firsts USING (h)",
    ),
)
def rule_engine(spark, sf):
    return QP.rule_engine(items(spark, sf), fuzzy=False)


@query("rule_engine_with_fuzzy_tier")
def rule_engine_with_fuzzy_tier(spark, sf):
    return QP.rule_engine(items(spark, sf))


# Match stems in four layouts, made of every question's options.
_LAYOUT = [
    "concat('Match the items in Column A with Column B:{n}{n}Column A:{n}1. ', {0}, '{n}2. ', {1}, '{n}{n}Column B:{n}a. ', {2}, '{n}b. ', {3})",
    "concat('Match the following.{n}List I{n}1) ', {0}, '{n}2) ', {1}, '{n}List II{n}(a) ', {2}, '{n}(b) ', {3})",
    "concat('Match each entry:{n}1 ', {0}, '{n}2 ', {1}, '{n}3 ', {2}, '{n}a ', {3}, '{n}b ', {0})",
    "question",
]
STEM_SQL = "CASE id % 4 " + " ".join(
    f"WHEN {i} THEN " + s.replace("{n}", "' || chr(10) || '").format(*[f"options[{k}]" for k in (1, 2, 3, 4)])
    for i, s in enumerate(_LAYOUT)
) + " END"
STEMS = f"stems AS (SELECT * EXCLUDE (question, question_type), {STEM_SQL} AS question, 'match_following' AS question_type FROM items)"


def match_bank(spark, sf):
    opts = [F.get("options", F.lit(i)) for i in range(4)]
    a, b, c, d = opts
    t = F.lit
    stem = (
        F.when(F.col("id") % 4 == 0, F.concat(t("Match the items in Column A with Column B:\n\nColumn A:\n1. "), a, t("\n2. "), b, t("\n\nColumn B:\na. "), c, t("\nb. "), d))
        .when(F.col("id") % 4 == 1, F.concat(t("Match the following.\nList I\n1) "), a, t("\n2) "), b, t("\nList II\n(a) "), c, t("\n(b) "), d))
        .when(F.col("id") % 4 == 2, F.concat(t("Match each entry:\n1 "), a, t("\n2 "), b, t("\n3 "), c, t("\na "), d, t("\nb "), a))
        .otherwise(F.col("question"))
    )
    return items(spark, sf).withColumns({"question": stem, "question_type": F.lit("match_following")})


_CANON = "concat('Match the items in Column A with Column B:' || chr(10) || chr(10) || 'Column A:' || chr(10) || '1. ', options[1], chr(10) || '2. ', options[2], {more} chr(10) || chr(10) || 'Column B:' || chr(10) || 'a. ', {x}, chr(10) || 'b. ', {y})"


@query(
    "normalised_match_stems",
    with_(
        ITEMS_SQL, STEMS,
        body="SELECT id, CASE id % 4 WHEN 0 THEN question WHEN 1 THEN "
        + _CANON.format(more="", x="options[3]", y="options[4]")
        + " WHEN 2 THEN " + _CANON.format(more="chr(10) || '3. ', options[3],", x="options[4]", y="options[1]")
        + " ELSE question END AS question FROM stems",
    ),
)
def normalised_match_stems(spark, sf):
    return Q.normalise_match_stems(match_bank(spark, sf)).select("id", "question")


@query(
    "match_layout",
    with_(ITEMS_SQL, STEMS, body="SELECT id, CASE id % 4 WHEN 2 THEN 'unequal_columns' WHEN 3 THEN 'unreadable_columns' END AS reason FROM stems"),
)
def match_layout(spark, sf):
    return Q.normalise_match_stems(match_bank(spark, sf)).select("id", Q.match_layout_reason().alias("reason"))


@query(
    "quality_bundle",
    with_(ITEMS_SQL, body=f"SELECT id, coalesce({END_SQL}, {BALANCE_SQL}, {STATEMENT_SQL}, CASE WHEN question_type = 'match_following' THEN 'unreadable_columns' END) AS reason FROM items"),
)
def quality_bundle(spark, sf):
    return Q.normalise_match_stems(items(spark, sf)).select("id", Q.deterministic_reason().alias("reason"))
