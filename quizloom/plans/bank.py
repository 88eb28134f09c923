"""Queries: the bank as a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import bank as B
from ..operators import pages as P
from ..operators.ordered import batch_numbers, first_n, row_numbers
from ..session import scratch_path
from .catalog import query, with_
from .items import ITEMS_SQL, items

HASH = f"sha256(lower(regexp_replace(question, '^{X.WS}+|{X.WS}+$', '', 'g')))"
OPT = ", ".join(f"options[{i + 1}] AS option_{n}" for i, n in enumerate("abcd"))


def q(name: str, body: str, *more: str):
    return query(name, with_(ITEMS_SQL, *more, body=body))


@q("set_listing", "SELECT exam_set, count(*) AS total_questions, max(created_epoch) AS generated_epoch FROM items GROUP BY 1")
def set_listing(spark, sf):
    return B.set_listing(items(spark, sf))


@q(
    "bank_statistics",
    """SELECT 'total' AS kind, NULL AS value, count(*) AS n, count(DISTINCT exam_set) AS sets FROM items
 UNION ALL SELECT 'difficulty', difficulty, count(*), count(DISTINCT exam_set) FROM items GROUP BY 2
 UNION ALL SELECT 'bloom_level', bloom_level, count(*), count(DISTINCT exam_set) FROM items GROUP BY 2
 UNION ALL SELECT 'chapter', chapter, count(*), count(DISTINCT exam_set) FROM items GROUP BY 2""",
)
def bank_statistics(spark, sf):
    return B.statistics(items(spark, sf))


@q(
    "landing_cards",
    "SELECT count(*) AS total_questions, count(DISTINCT exam_set) AS total_sets, count_if(difficulty = 'easy') AS easy, count_if(difficulty = 'medium') AS medium, count_if(difficulty = 'hard') AS hard, count(DISTINCT chapter) AS chapters_covered FROM items",
)
def landing_cards(spark, sf):
    return B.landing_cards(items(spark, sf))


@q(
    "filter_values",
    "SELECT DISTINCT 'chapter' AS filter_name, chapter AS value FROM items UNION ALL SELECT DISTINCT 'difficulty', difficulty FROM items UNION ALL SELECT DISTINCT 'bloom_level', bloom_level FROM items",
)
def filter_values(spark, sf):
    return B.filter_values(items(spark, sf))


@q("set_breakdown", "SELECT exam_set, chapter, difficulty, count(*) AS n FROM items GROUP BY ALL")
def set_breakdown(spark, sf):
    return B.breakdown(items(spark, sf))


@q("filtered_search", "SELECT id, exam_set, chapter FROM items WHERE difficulty = 'easy' AND bloom_level = 'remember' AND contains(lower(question), 'the ')")
def filtered_search(spark, sf):
    return B.filter_bank(items(spark, sf), difficulty="easy", bloom_level="remember", search="The ").select("id", "exam_set", "chapter")


@q("wildcard_search", "SELECT id, exam_set FROM items WHERE lower(question) LIKE '%on_the%'")
def wildcard_search(spark, sf):
    return B.filter_bank(items(spark, sf), search="on_the", literal=False).select("id", "exam_set")


@q(
    "question_page",
    "SELECT id, exam_set, question, correct_answer, (SELECT count(*) FROM items WHERE difficulty = 'medium') AS total FROM items WHERE difficulty = 'medium' ORDER BY exam_set, id LIMIT 50 OFFSET 50",
)
def question_page(spark, sf):
    return B.page(B.filter_bank(items(spark, sf), difficulty="medium"), 2).select("id", "exam_set", "question", "correct_answer", "total")


@q(
    "question_page_by_counts",
    "SELECT id, exam_set, question, correct_answer, (SELECT count(*) FROM items WHERE difficulty = 'medium') AS total FROM items WHERE difficulty = 'medium' ORDER BY exam_set, id LIMIT 50 OFFSET 50",
)
def question_page_by_counts(spark, sf):
    stored = P.store(items(spark, sf).select("id", "exam_set", "question", "correct_answer", "difficulty"), ["exam_set", "difficulty"])
    return stored.page(2, difficulty="medium").drop("difficulty")


@q(
    "question_page_after_row",
    "SELECT id, exam_set FROM items WHERE exam_set > 1 OR (exam_set = 1 AND id > 60) ORDER BY exam_set, id LIMIT 50",
)
def question_page_after_row(spark, sf):
    return B.page_after(items(spark, sf), 1, 60).select("id", "exam_set")


@q("one_set_in_order", f"SELECT id, question, {OPT}, correct_answer FROM items WHERE exam_set = 1")
def one_set_in_order(spark, sf):
    return B.to_flat_options(B.read_set(items(spark, sf), 1)).select("id", "question", *[f"option_{n}" for n in "abcd"], "correct_answer")


@q("answer_key", "SELECT exam_set, row_number() OVER (PARTITION BY exam_set ORDER BY id) AS q_no, question, correct_answer, difficulty, chapter FROM items")
def answer_key(spark, sf):
    return B.answer_key(items(spark, sf))


@q("print_listing", f"SELECT exam_set, id, question, {OPT}, correct_answer, difficulty, bloom_level, chapter, max(created_epoch) OVER (PARTITION BY exam_set) AS set_epoch FROM items")
def print_listing(spark, sf):
    return B.print_listing(items(spark, sf))


@q("options_round_trip", "SELECT id, array_to_string(options, '|') AS joined FROM items")
def options_round_trip(spark, sf):
    return B.to_option_list(B.to_flat_options(items(spark, sf))).select("id", F.array_join("options", "|").alias("joined"))


@q(
    "append_new_questions",
    f"""SELECT id, exam_set, h AS question_hash FROM arrived WHERE list_contains((SELECT ids FROM steps ORDER BY n DESC LIMIT 1), id)""",
    f"""keyed AS (SELECT id, exam_set, validation_status, CASE WHEN id % 3 = 1 AND validation_status <> 'approved' THEN 'q-' || (id - 1) ELSE question_uuid END AS u, {HASH} AS h FROM items),
arrived AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY id) AS n FROM keyed WHERE validation_status <> 'approved'
 AND h NOT IN (SELECT h FROM keyed WHERE validation_status = 'approved') AND u NOT IN (SELECT u FROM keyed WHERE validation_status = 'approved')),
steps(n, us, hs, ids) AS (SELECT CAST(0 AS BIGINT), []::VARCHAR[], []::VARCHAR[], []::BIGINT[]
 UNION ALL SELECT a.m, CASE WHEN new THEN list_append(us, a.u) ELSE us END, CASE WHEN new THEN list_append(hs, a.h) ELSE hs END, CASE WHEN new THEN list_append(ids, a.id) ELSE ids END
 FROM (SELECT s.*, a.u, a.h, a.id, a.n AS m, NOT list_contains(s.us, a.u) AND NOT list_contains(s.hs, a.h) AS new FROM steps s JOIN arrived a ON a.n = s.n + 1) a)""",
)
def append_new_questions(spark, sf):
    """A third of the arriving rows carry the uuid of the row before, so keys cross."""
    bank = items(spark, sf)
    old, new = bank.where("validation_status = 'approved'"), bank.where("validation_status <> 'approved'")
    crossed = F.when(F.col("id") % 3 == 1, F.concat(F.lit("q-"), (F.col("id") - 1).cast("string"))).otherwise(F.col("question_uuid"))
    return B.new_rows(old, new.withColumn("question_uuid", crossed)).select("id", "exam_set", "question_hash")


_LOG = """logged AS (SELECT id, question_uuid, exam_set, chapter, question AS question_text, correct_answer, difficulty,
 substring('validator ' || question_type || ' ' || source_name || repeat('-', 80), 1, 60) AS validator_failed, 'status ' || validation_status AS reason, created_epoch
 FROM (SELECT *, chapter_key AS source_name FROM items) WHERE validation_status <> 'approved')"""


def _log_rows(bank):
    return bank.where("validation_status <> 'approved'").withColumns(
        {
            "validator_failed": F.concat(
                F.lit("validator "), "question_type", F.lit(" "), "chapter_key", F.repeat(F.lit("-"), F.lit(80))
            ),
            "reason": F.concat(F.lit("status "), "validation_status"),
        }
    )


@q("rejection_log", "SELECT id, created_epoch, question_uuid, exam_set, chapter, question_text, correct_answer, difficulty, validator_failed, reason FROM logged", _LOG)
def rejection_log(spark, sf):
    return B.rejection_log(_log_rows(items(spark, sf)))


@q("newest_log_entries", "SELECT id, validator_failed, reason FROM logged WHERE chapter = 'Word Processing' ORDER BY created_epoch DESC, id DESC LIMIT 100", _LOG)
def newest_log_entries(spark, sf):
    log = B.rejection_log(_log_rows(items(spark, sf)))
    return B.newest_log(log, 100, chapter="Word Processing").select("id", "validator_failed", "reason")


@q(
    "evolve_old_bank",
    f"SELECT id, {HASH} AS question_hash, question_uuid, CASE WHEN exam_set > 1 THEN bloom_level ELSE 'remember' END AS bloom_level, 1.0::DOUBLE AS weightage, CASE WHEN exam_set > 1 THEN question_type ELSE 'standard' END AS question_type, '' AS model_name, 'v1' AS prompt_version, CASE WHEN exam_set > 1 THEN retry_count ELSE 0 END AS retry_count FROM items",
)
def evolve_old_bank(spark, sf):
    bank = items(spark, sf)
    old = B.read_set(bank, 1).select("id", "question", "question_uuid")
    new = B.drop_set(bank, 1).select("id", "question", "question_uuid", "bloom_level", "question_type", "retry_count")
    return B.evolve(B.merge_banks(new, old)).select(
        "id", "question_hash", "question_uuid", "bloom_level", "weightage", "question_type", "model_name", "prompt_version", "retry_count"
    )


@q("registry_without_set", f"SELECT id, exam_set, {HASH} AS question_hash FROM items WHERE exam_set <> 2")
def registry_without_set(spark, sf):
    return B.drop_set(items(spark, sf), 2).select("id", "exam_set", X.content_hash(F.col("question")).alias("question_hash"))


@q(
    "set_documents",
    "SELECT exam_set, 0 AS part, 1 AS n_parts, 'course' AS course, count(*) AS total_questions, max(created_epoch) AS generated_epoch, md5(string_agg(correct_answer || '#' || difficulty, '|' ORDER BY id)) AS digest FROM items GROUP BY 1",
)
def set_documents(spark, sf):
    docs = B.set_documents(items(spark, sf).select("exam_set", "id", "question", "correct_answer", "difficulty", "created_epoch"))
    inner = F.transform("questions", lambda x: F.concat_ws("#", x["correct_answer"], x["difficulty"]))
    return docs.withColumn("digest", F.md5(F.array_join(inner, "|"))).drop("questions")


@q(
    "answer_key_documents",
    "SELECT exam_set, 0 AS part, 1 AS n_parts, md5(string_agg(id % 100 + 1 || '#' || correct_answer, '|' ORDER BY id)) AS digest FROM items GROUP BY 1",
)
def answer_key_documents(spark, sf):
    inner = F.transform("answer_key", lambda x: F.concat_ws("#", x["q_no"], x["correct_answer"]))
    return B.answer_key_documents(items(spark, sf)).select("exam_set", "part", "n_parts", F.md5(F.array_join(inner, "|")).alias("digest"))


@q("combined_header", "SELECT count(DISTINCT exam_set) AS total_sets, count_if(exam_set = 1) AS questions_per_set, 'course' AS course FROM items")
def combined_header(spark, sf):
    return B.combined_header(items(spark, sf))


@q(
    "combined_export",
    """SELECT 'course' AS course, (SELECT count(DISTINCT exam_set) FROM items) AS total_sets, (SELECT count(*) FROM items WHERE exam_set = 1) AS questions_per_set,
 CAST((SELECT max(created_epoch) FROM items) AS VARCHAR) AS generated_at, exam_set AS set_number, CAST(0 AS INT) AS part, CAST(1 AS INT) AS n_parts, count(*) AS questions, md5(string_agg(question, '|' ORDER BY id)) AS digest
 FROM items GROUP BY exam_set""",
)
def combined_export(spark, sf):
    path = scratch_path(spark, "combined")
    B.write_combined(items(spark, sf), path, F.max("created_epoch"))
    texts = F.array_join(F.transform("questions", lambda x: x["question"]), "|")
    return B.read_combined(spark, path).select(
        "course", "total_sets", "questions_per_set", "generated_at", "set_number", "part", "n_parts",
        F.size("questions").cast("bigint").alias("questions"), F.md5(texts).alias("digest"),
    )


@q("audit_batches", "SELECT id, exam_set, chapter_no, CAST(floor((rn - 1) / 25) AS INT) AS batch_no, CAST((rn - 1) % 25 + 1 AS INT) AS item_no FROM (SELECT *, row_number() OVER (PARTITION BY exam_set ORDER BY id) AS rn FROM items)")
def audit_batches(spark, sf):
    return batch_numbers(items(spark, sf).select("id", "exam_set", "chapter_no"), ["exam_set"], "id", 25)


@q("first_question_per_text", f"SELECT min(id) AS id, {HASH} AS question_hash FROM items GROUP BY 2")
def first_question_per_text(spark, sf):
    bank = items(spark, sf).select("id", X.content_hash(F.col("question")).alias("question_hash"))
    return bank.groupBy("question_hash").agg(F.min("id").alias("id"))


@q("sorted_sets", "SELECT DISTINCT exam_set FROM items ORDER BY 1")
def sorted_sets(spark, sf):
    return items(spark, sf).select("exam_set").distinct().orderBy("exam_set")


@q(
    "shuffled_set_order",
    "SELECT exam_set, question_uuid, row_number() OVER (PARTITION BY exam_set ORDER BY CAST('0x' || substring(md5(question_uuid || '|' || exam_set), 1, 15) AS BIGINT)) AS shuffled_no FROM items",
)
def shuffled_set_order(spark, sf):
    return B.shuffled(items(spark, sf).select("exam_set", "question_uuid")).select("exam_set", "question_uuid", "shuffled_no")
