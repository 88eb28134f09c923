"""Data-quality rules. Each is a nullable reason column; null means passed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import reference_values as R
from ..functions import text as X

# Limits of the formatting rules.
QUESTION_MIN, QUESTION_MAX = 15, 600
OPTION_MIN, OPTION_MAX = 2, 200
LENGTH_RATIO = 3.5
FREE_END_TYPES = ["match_following", "sequence_order"]

# Patterns of the layout rules.
STATEMENT = r"(?i)(I\.|II\.|III\.|1\.|2\.|Statement\s+1|Statement\s+2)"
PAIRING = r"1[\-–.]\s*[a-d]"
SECTION_A = r"(?i)column\s*a|list\s*(?:i|1)\b|col\.?\s*a|part\s*a|group\s*a"
SECTION_B = r"(?i)column\s*b|list\s*(?:ii|2)\b|col\.?\s*b|part\s*b|group\s*b"
INSTRUCTION = r"(?i)match\s+the|match\s+each|match\s+column"
NUMBERED = r"^[\(\[]?(\d+)[\)\].\-–]?\s+(.+)$"
LETTERED = r"^[\(\[]?([a-dA-D])[\)\].\-–]?\s+(.+)$"


def first_reason(*reasons: Column) -> Column:
    return F.coalesce(*reasons)


def _stem() -> Column:
    return X.strip(F.col("question"))


def schema_reason() -> Column:
    """Raw record: keys, four filled options, difficulty, question length, answer."""
    c = F.col
    missing = F.array_compact(
        F.array(*[F.when(c(k).isNull(), k) for k in ("question", "options", "correct_answer", "difficulty", "chapter")])
    )
    blank = F.exists("options", lambda o: o.isNull() | (X.strip(o) == ""))
    return first_reason(
        F.when(F.size(missing) > 0, F.concat(F.lit("missing:"), F.array_join(missing, ","))),
        F.when(F.size("options") != 4, F.concat(F.lit("options:"), F.size("options").cast("string"))),
        F.when(blank, "blank_option"),
        F.when(~c("difficulty").isin(list(R.BLOOM_FOR)), "difficulty"),
        F.when(F.length(_stem()) < 10, "short_question"),
        F.when(X.strip(c("correct_answer")) == "", "blank_answer"),
        F.when(~F.array_contains("options", c("correct_answer")), "answer_not_an_option"),
    )


def structure_reason() -> Column:
    distinct = F.size(F.array_distinct(F.transform("options", X.dedup_key)))
    return first_reason(
        F.when(F.size("options") != 4, "option_count"),
        F.when(~F.array_contains("options", F.col("correct_answer")), "answer_not_an_option"),
        F.when(distinct != 4, "equal_options"),
        F.when(F.length(_stem()) < 10, "short_question"),
    )


def end_reason() -> Column:
    return F.when(
        ~_stem().rlike(r"[?.:]$") & ~F.col("question_type").isin(FREE_END_TYPES), "no_end_mark"
    )


def option_reason() -> Column:
    """First broken option, by place."""

    def one(o: Column, i: Column) -> Column:
        s = X.strip(o)
        what = (
            F.when(o != s, "untrimmed").when(s == "", "empty")
            .when(F.length(s) < OPTION_MIN, "short").when(F.length(s) > OPTION_MAX, "long")
        )
        return F.when(what.isNotNull(), F.concat(F.lit("option_"), (i + 1).cast("string"), F.lit("_"), what))

    return F.get(F.array_compact(F.transform("options", one)), F.lit(0))


def balance_reason() -> Column:
    sizes = F.filter(F.transform("options", lambda o: F.length(X.strip(o))), lambda n: n > 0)
    return F.when(F.array_max(sizes) / F.array_min(sizes) > LENGTH_RATIO, "option_length_ratio")


def statement_reason() -> Column:
    return F.when(
        (F.col("question_type") == "statement_based") & ~F.col("question").rlike(STATEMENT), "no_numbered_statements"
    )


def match_mention_reason() -> Column:
    low = F.lower("question")
    both = lambda a, b: low.contains(a) & low.contains(b)
    named = both("column a", "column b") | both("list i", "list ii") | both("col a", "col b")
    return F.when(
        (F.col("question_type") == "match_following") & ~(named | F.col("question").rlike(PAIRING)), "no_columns_named"
    )


def formatting_reason() -> Column:
    """All formatting rules in their order. Line breaks are allowed in match stems."""
    s = _stem()
    n = F.length(s)
    gap = F.when(F.col("question_type") == "match_following", s.rlike(r"[ \t\x0B\f\x{A0}]{2,}")).otherwise(
        s.rlike(f"{X.WS}{{2,}}")
    )
    return first_reason(
        F.when(n == 0, "empty_question"),
        F.when(n < QUESTION_MIN, "short_question"),
        F.when(n > QUESTION_MAX, "long_question"),
        F.when(s.rlike(r"^\p{Ll}"), "lower_case_start"),
        end_reason(),
        F.when(gap, "double_space"),
        F.when(s.rlike(r"[?!.]{2,}"), "repeated_mark"),
        option_reason(),
        balance_reason(),
        statement_reason(),
        match_mention_reason(),
    )


def match_columns(stem: Column) -> Column:
    """Items of both columns of a match stem: struct of arrays ``a`` and ``b``."""
    lines = F.filter(F.transform(F.split(stem, "\n"), X.strip), lambda x: x != "")
    empty = F.array().cast("array<string>")
    start = F.struct(F.lit("").alias("at"), empty.alias("a"), empty.alias("b"))

    def put(acc: Column, item: Column, default: str) -> Column:
        to_a = (acc["at"] == "a") | ((acc["at"] == "") & F.lit(default == "a"))
        one = F.array(X.strip(item))
        return F.struct(
            acc["at"].alias("at"),
            F.when(to_a, F.concat(acc["a"], one)).otherwise(acc["a"]).alias("a"),
            F.when(to_a, acc["b"]).otherwise(F.concat(acc["b"], one)).alias("b"),
        )

    def section(acc: Column, name: str) -> Column:
        return F.struct(F.lit(name).alias("at"), acc["a"].alias("a"), acc["b"].alias("b"))

    def step(acc: Column, line: Column) -> Column:
        return (
            F.when(line.rlike(SECTION_A), section(acc, "a"))
            .when(line.rlike(SECTION_B), section(acc, "b"))
            .when(line.rlike(INSTRUCTION), acc)
            .when(line.rlike(NUMBERED), put(acc, F.regexp_extract(line, NUMBERED, 2), "a"))
            .when(line.rlike(LETTERED), put(acc, F.regexp_extract(line, LETTERED, 2), "b"))
            .otherwise(acc)
        )

    return F.aggregate(lines, start, step)


def is_canonical(stem: Column) -> Column:
    return (
        stem.contains("Column A:") & stem.contains("Column B:") & stem.rlike(r"\n\d+\.") & stem.rlike(r"\n[a-d]\.")
    )


def canonical_stem(columns: Column) -> Column:
    """Column A numbered, Column B lettered, each item on its own line."""
    numbered = F.transform(columns["a"], lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    lettered = F.transform(columns["b"], lambda x, i: F.concat(F.char((i + 97).cast("bigint")), F.lit(". "), x))
    return F.concat(
        F.lit("Match the items in Column A with Column B:\n\nColumn A:\n"), F.array_join(numbered, "\n"),
        F.lit("\n\nColumn B:\n"), F.array_join(lettered, "\n"),
    )


def normalise_match_stems(bank: DataFrame) -> DataFrame:
    """Match stems in the canonical layout where both columns could be read."""
    q = F.col("question")
    cols = F.when((F.col("question_type") == "match_following") & ~is_canonical(q), match_columns(q))
    read = bank.withColumn("_cols", cols)
    usable = (F.size("_cols.a") >= 2) & (F.size("_cols.b") >= 2)
    return read.withColumn("question", F.when(usable, canonical_stem(F.col("_cols"))).otherwise(q)).drop("_cols")


def match_layout_reason() -> Column:
    """Layout of already normalised match stems: readable, two items or more, equally many."""
    q = F.col("question")
    cols = match_columns(q)
    a, b = F.size(cols["a"]), F.size(cols["b"])
    return F.when(
        F.col("question_type") == "match_following",
        first_reason(
            F.when(~is_canonical(q), "unreadable_columns"),
            F.when(a < 2, "column_a_short"),
            F.when(b < 2, "column_b_short"),
            F.when(a != b, "unequal_columns"),
        ),
    )


def deterministic_reason() -> Column:
    """Quality bundle on normalised stems."""
    return first_reason(end_reason(), balance_reason(), statement_reason(), match_layout_reason())


def _of_lower_case(value: Callable[[Column], Column]) -> Column:
    """``value`` of the question in lower case. The one-element transform binds that text, which would else be made
    again for every word it is searched for."""
    return F.get(F.transform(F.array(F.lower("question")), value), F.lit(0))


def difficulty_signal_reason() -> Column:
    easy = _of_lower_case(lambda low: F.exists(F.array(*[F.lit(k) for k in R.EASY_SIGNALS]), lambda k: F.startswith(low, k)))
    hard = _of_lower_case(lambda low: F.exists(F.array(*[F.lit(k) for k in R.HARD_SIGNALS]), lambda k: F.contains(low, k)))
    return first_reason(
        F.when((F.col("difficulty") == "hard") & easy & ~hard, "easy_words_marked_hard"),
        F.when((F.col("difficulty") == "easy") & hard, "hard_words_marked_easy"),
    )


def needs_classifier() -> Column:
    return difficulty_signal_reason().isNotNull() | F.coalesce("question_type", F.lit("standard")).isin(R.CLASSIFIED_TYPES)


def default_bloom() -> Column:
    out = F.lit("remember")
    for level, bloom in R.BLOOM_DEFAULT.items():
        out = F.when(F.col("difficulty") == level, bloom).otherwise(out)
    return out


def bloom_reason() -> Column:
    from .metrics import bloom_fits

    return F.when(~bloom_fits(), "bloom_level")


def scope_reason() -> Column:
    """First out-of-scope term a question mentions."""
    terms = F.array(*[F.lit(t) for t in R.OUT_OF_SCOPE])
    return F.concat(F.lit("out_of_scope:"), _of_lower_case(lambda low: F.get(F.filter(terms, lambda t: F.contains(low, t)), F.lit(0))))


def chapter_mismatch(expected: Column) -> Column:
    return F.coalesce(X.dedup_key(F.col("chapter")) != X.dedup_key(expected), F.lit(True))


def relabel_chapter(bank: DataFrame, expected: str) -> DataFrame:
    """A wrong chapter label is replaced, never a reason to reject."""
    return bank.withColumn("relabelled", chapter_mismatch(F.col(expected))).withColumn(
        "chapter", F.when(F.col("relabelled"), F.col(expected)).otherwise(F.col("chapter"))
    )


def repaired_type() -> Column:
    known = ["standard", "assertion_reason", "statement_based", "scenario_based", "fill_blank", "match_following", "sequence_order"]
    return F.when(F.col("question_type").isin(known), F.col("question_type")).otherwise("standard")


def duplicate_kinds(bank: DataFrame) -> DataFrame:
    """Exact duplicates by content hash: ``id`` and ``duplicate`` (within_set / across_sets).

    Firsts are found by aggregation and met again by ``id``; no join or window runs on
    the hash, so a text copied millions of times makes no hot partition.
    """
    keyed = bank.select("id", "exam_set", X.content_hash(F.col("question")).alias("h"))
    per_set = keyed.groupBy("h", "exam_set").agg(F.min("id").alias("id"))
    overall = per_set.groupBy("h").agg(F.min_by("id", F.struct("exam_set", "id")).alias("id"))
    return (
        keyed.join(per_set.select("id", F.lit(True).alias("first_in_set")), "id", "left")
        .join(overall.select("id", F.lit(True).alias("first_overall")), "id", "left")
        .select(
            "id", "exam_set",
            F.when(F.col("first_in_set").isNull(), "within_set").when(F.col("first_overall").isNull(), "across_sets").alias("duplicate"),
        )
    )


def unseen(candidates: DataFrame, registry: DataFrame) -> DataFrame:
    """Candidates whose text the registry does not hold."""
    known = registry.select(X.content_hash(F.col("question")).alias("_h")).distinct()
    return candidates.withColumn("_h", X.content_hash(F.col("question"))).join(known, "_h", "left_anti").drop("_h")
