"""Judge verdicts as tables: batch texts out, responses parsed, verdicts joined and applied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import reference_values as R
from ..functions import text as X
from .ordered import batch_numbers

VERDICT_BATCH = 25
QUALITY_BATCH = 20
DISTRACTOR_BATCH = 15
MAX_ATTEMPTS = 3


def _letter(i: Column) -> Column:
    return F.char((i + 65).cast("bigint"))


def verdict_text(no: Column) -> Column:
    opts = F.array_join(F.transform("options", lambda o, i: F.concat(_letter(i), F.lit(")"), o)), " ")
    return F.concat(
        no.cast("string"), F.lit(". Q: "), F.col("question"), F.lit("\n   Options: "), opts,
        F.lit("\n   Marked answer: "), F.col("correct_answer"),
    )


def quality_text(no: Column) -> Column:
    opts = F.array_join(F.transform("options", lambda o, i: F.concat(F.lit("   "), _letter(i), F.lit(") "), o)), "\n")
    return F.concat(
        F.lit("[Q"), no.cast("string"), F.lit("] Type: "), F.col("question_type"), F.lit("\nQuestion: "), F.col("question"),
        F.lit("\nOptions:\n"), opts, F.lit("\nCorrect: "), F.col("correct_answer"),
    )


def distractor_text(no: Column) -> Column:
    wrong = F.filter("options", lambda o: o != F.col("correct_answer"))
    return F.concat(
        F.lit("[Q"), no.cast("string"), F.lit("] Type: "), F.col("question_type"), F.lit("\nQuestion: "), F.col("question"),
        F.lit("\nCorrect answer: "), F.col("correct_answer"), F.lit("\nDistractors (wrong options):\n"),
        F.array_join(F.transform(wrong, lambda o: F.concat(F.lit("   - "), o)), "\n"),
    )


def batch_texts(bank: DataFrame, keys: list[str], order: str, size: int, render) -> DataFrame:
    """One text per batch; a batch never holds more than ``size`` questions."""
    numbered = batch_numbers(bank, keys, order, size).withColumn("line", render(F.col("item_no")))
    joined = numbered.groupBy(*keys, "batch_no").agg(
        F.count("*").cast("int").alias("expected"), F.sort_array(F.collect_list(F.struct("item_no", "line"))).alias("l")
    )
    return joined.select(*keys, "batch_no", "expected", F.array_join(F.transform("l", lambda x: x["line"]), "\n\n").alias("batch_text"))


def _unfenced(text: Column) -> Column:
    bare = X.strip(F.regexp_replace(text, "(?i)```(?:json)?", ""))
    return X.strip(F.btrim(bare, F.lit("`")))


def _between(text: Column, first: str, last: str) -> Column:
    a = F.instr(text, first)
    b = F.length(text) - F.instr(F.reverse(text), last) + 1
    return F.when((a > 0) & (F.instr(text, last) > 0), F.substring(text, a, F.greatest(b - a + 1, F.lit(0))))


def json_array(text: Column, element: str) -> Column:
    """The array inside a free-text answer, null when there is none or it does not parse."""
    return F.from_json(_between(_unfenced(text), "[", "]"), f"array<{element}>", {"allowSingleQuotes": "false"})


def json_object(text: Column, schema: str) -> Column:
    return F.from_json(_between(_unfenced(text), "{", "}"), schema, {"allowSingleQuotes": "false"})


def parse_responses(responses: DataFrame, element: str) -> DataFrame:
    """Adds ``items`` (null for a quarantined response) and ``parsed`` (their number)."""
    return responses.withColumn("items", json_array(F.col("response"), element)).withColumn(
        "parsed", F.when(F.col("items").isNotNull(), F.size("items"))
    )


def join_verdicts(batched: DataFrame, parsed: DataFrame, keys: list[str]) -> DataFrame:
    """Verdict of every question by place in its batch, if the batch answered completely.

    ``route`` is ``batch`` where the counts agree and ``single`` where they do not.
    """
    expected = batched.groupBy(*keys, "batch_no").agg(F.count("*").alias("expected"))
    whole = parsed.join(expected, [*keys, "batch_no"]).where(F.col("parsed") == F.col("expected"))
    rows = whole.select(*keys, "batch_no", F.posexplode("items").alias("p", "verdict")).select(
        *keys, "batch_no", (F.col("p") + 1).alias("item_no"), "verdict"
    )
    joined = batched.join(rows, [*keys, "batch_no", "item_no"], "left")
    return joined.withColumn("route", F.when(F.col("verdict").isNotNull(), "batch").otherwise("single"))


def matching_option(answer: Column) -> Column:
    """First option equal to the answer in canonical form."""
    form = X.answer_form(answer)
    return F.get(F.filter("options", lambda o: X.answer_form(o) == form), F.lit(0))


def reconcile(judged: DataFrame) -> DataFrame:
    """Final verdict: the judge's, unless the independent answer disagrees.

    Needs ``is_correct``, ``suggested_answer``, ``independent_answer``. Adds ``passed``,
    ``verdict_reason`` and ``suggested`` (a real option, only for failed rows).
    """
    ok = F.coalesce("is_correct", F.lit(False))
    solved = F.coalesce("independent_answer", F.lit(""))
    disagrees = (solved != "") & (X.answer_form(solved) != X.answer_form(F.col("correct_answer")))
    passed = ok & ~disagrees
    hint = F.when(F.coalesce("suggested_answer", F.lit("")) != "", matching_option(F.col("suggested_answer")))
    return judged.withColumns(
        {
            "passed": passed,
            "verdict_reason": F.when(~ok, "judge").when(disagrees, "independent_answer"),
            "suggested": F.when(~passed, hint),
        }
    )


def apply_suggestions(judged: DataFrame) -> DataFrame:
    """A failed row with a suggestion takes it and goes on; one without is rejected."""
    return judged.withColumns(
        {
            "correct_answer": F.coalesce("suggested", "correct_answer"),
            "rejected": ~F.col("passed") & F.col("suggested").isNull(),
        }
    )


def apply_labels(bank: DataFrame, classified: DataFrame) -> DataFrame:
    """Classified difficulty and Bloom level replace the stated ones; unknown values are ignored."""
    c = classified.select("id", F.col("difficulty").alias("_d"), F.col("bloom_level").alias("_b"))
    known_d = F.when(F.col("_d").isin(list(R.BLOOM_FOR)), F.col("_d"))
    known_b = F.when(F.col("_b").isin("remember", "understand", "apply", "analyze"), F.col("_b"))
    return bank.join(c, "id", "left").withColumns(
        {"difficulty": F.coalesce(known_d, "difficulty"), "bloom_level": F.coalesce(known_b, "bloom_level")}
    ).drop("_d", "_b")


def audit_batches(bank: DataFrame, keys: list[str], order: str, size: int = DISTRACTOR_BATCH) -> DataFrame:
    """Batches of live rows; rows with fixed options are not audited and hold no place.

    ``q_index`` is null for them. Ranks run inside a batch, so over ``size`` rows at most.
    """
    from pyspark.sql import Window

    numbered = batch_numbers(bank, keys, order, size)
    free = ~F.col("question_type").isin(R.FIXED_OPTION_TYPES)
    w = Window.partitionBy(*keys, "batch_no").orderBy("item_no")
    return numbered.withColumn(
        "q_index", F.when(free, F.sum(F.when(free, 1).otherwise(0)).over(w)).cast("int")
    )


def join_audit(batched: DataFrame, audit: DataFrame, keys: list[str]) -> DataFrame:
    """Audit reason per row; a batch whose answer has the wrong count passes as a whole."""
    expected = batched.groupBy(*keys, "batch_no").agg(F.count("q_index").alias("expected"))
    given = audit.groupBy(*keys, "batch_no").agg(F.count("*").alias("given"))
    whole = expected.join(given, [*keys, "batch_no"]).where("expected = given").select(*keys, "batch_no")
    valid = audit.join(whole, [*keys, "batch_no"], "left_semi")
    return batched.join(valid.withColumnRenamed("reason", "audit_reason"), [*keys, "batch_no", "q_index"], "left").withColumn(
        "audit_reason", F.when(~F.col("passed"), F.col("audit_reason"))
    ).drop("passed")


def staged(reasons: dict[str, Column]) -> Column:
    """First failing stage as ``stage:reason``, in the order given."""
    return F.coalesce(*[F.concat(F.lit(f"{name}:"), c) for name, c in reasons.items()])


def with_replacements(bank: DataFrame, results: DataFrame, replacements: DataFrame) -> DataFrame:
    """Failed rows replaced at their place; failed rows without a replacement are marked short."""
    new = replacements.select("exam_set", "position", F.col("question").alias("_q"), F.col("question_uuid").alias("_u"))
    joined = bank.join(results.select("id", "reason"), "id", "left").join(new, ["exam_set", "position"], "left")
    failed = F.col("reason").isNotNull()
    return joined.withColumns(
        {
            "outcome": F.when(~failed, "kept").when(F.col("_u").isNotNull(), "replaced").otherwise("short"),
            "question": F.when(failed, F.coalesce("_q", "question")).otherwise(F.col("question")),
            "question_uuid": F.when(failed, F.coalesce("_u", "question_uuid")).otherwise(F.col("question_uuid")),
        }
    ).drop("_q", "_u")
