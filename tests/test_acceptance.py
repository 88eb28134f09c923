"""Acceptance in order: only rows that stand register, nothing is lost, ties have one winner."""

import difflib

from pyspark.sql import functions as F

from quizloom.operators import bank as B
from quizloom.operators import balance as BA
from quizloom.operators import dedup as D
from quizloom.operators import enrich as E
from quizloom.operators import leaks as L
from quizloom.operators import quality as QP
from quizloom.operators import segment as S
from quizloom.operators import vector as V
from quizloom.sources import files as IO
from quizloom.streaming import acceptance as A


def _keep_in_order(rows, known=()):
    us, hs = {u for u, _ in known}, {h for _, h in known}
    kept = []
    for i, u, h in sorted(rows):
        if u not in us and h not in hs:
            kept.append(i)
            us.add(u)
            hs.add(h)
    return kept


def test_insert_with_crossed_keys(spark):
    schema = "id bigint, question_uuid string, question string"
    none = spark.createDataFrame([], schema)
    crossed = [(1, "u1", "alpha"), (2, "u1", "beta"), (3, "u3", "beta")]
    assert sorted(r.id for r in B.new_rows(none, spark.createDataFrame(crossed, schema)).collect()) == [1, 3]
    known = spark.createDataFrame([(0, "u1", "zeta")], schema)
    blocked = spark.createDataFrame([(1, "u1", "gamma"), (2, "u2", "gamma")], schema)
    assert [r.id for r in B.new_rows(known, blocked).collect()] == [2]
    many = [(i, f"u{i * 7 % 23}", f"t{i * 5 % 31}") for i in range(120)]
    got = sorted(r.id for r in B.new_rows(none, spark.createDataFrame(many, schema)).collect())
    assert got == _keep_in_order(many)


def _ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


def test_a_fallen_row_flags_nobody(spark):
    a, b, c = "abcdefgh", "abcdefgX", "abcdefYX"
    assert _ratio(b, a) >= 0.85 and _ratio(c, b) >= 0.85 > _ratio(c, a)
    df = spark.createDataFrame([(1, 1, a), (2, 1, b), (3, 1, c), (4, 1, b)], "id bigint, exam_set int, question string")
    assert {(r.id, r.matched_id) for r in D.fuzzy_first_match(df, ["exam_set"]).collect()} == {(2, 1), (4, 1)}


def test_rejected_rows_register_nothing(spark):
    schema = "id bigint, exam_set int, question string, passes boolean"
    base = "which of these keys opens the window of the program"
    rows = [
        (1, 1, base, False), (2, 1, base, True), (3, 1, base, True), (4, 2, base, True),
        (5, 1, base + "s", True), (6, 2, base + "s", True), (7, 1, "quite another text", True), (8, 2, "quite another tex", False), (9, 2, "quite another tex", True),
    ]
    df = spark.createDataFrame(rows, schema)
    got = {r.id: r.duplicate for r in QP.standing_duplicates(df).collect()}
    assert got == {3: "within_set", 4: "across_sets", 6: "across_sets"}
    got = {r.id: r.duplicate for r in QP.standing_duplicates(df, True).collect()}
    assert got == {3: "within_set", 4: "across_sets", 5: "near_in_set", 6: "near_across_sets", 8: "near_across_sets", 9: "near_across_sets"}


def test_new_candidates_meet_each_other(spark):
    schema = "id bigint, exam_set int, question string, vec array<double>"
    registry = spark.createDataFrame([(1, 1, "old", [1.0, 0.0])], schema)
    new = [(2, 1, "old", [0.0, 1.0]), (3, 1, "x", [1.0, 0.0]), (4, 1, "y", [0.6, 0.8]), (5, 1, "Y ", [0.0, -1.0]), (6, 1, "z", [0.6, 0.8]), (7, 2, "z", [0.6, 0.8])]
    got = {r.id: r.kind for r in D.semantic_duplicates(spark.createDataFrame(new, schema), registry, ["exam_set"]).collect()}
    assert got == {2: "exact_text", 3: "vector", 5: "exact_text", 6: "vector"}


def test_equal_vectors_below_the_limit_stand(spark):
    df = spark.createDataFrame([(1, 1, [0.5, 0.5]), (2, 1, [0.5, 0.5]), (3, 1, [1.0, 0.0]), (4, 1, [1.0, 0.0])], "id bigint, g int, vec array<double>")
    assert [(r.id, r.flagged_by) for r in D.cosine_duplicates(df, ["g"], 0.88).collect()] == [(4, 3)]


def test_upsert_keeps_one_row_per_key(spark):
    schema = "namespace string, id bigint, vec array<double>, origin string"
    store = spark.createDataFrame([("n", 1, [0.0], "old")], schema)
    new = spark.createDataFrame([("n", 1, [1.0], "a", 3), ("n", 1, [2.0], "b", 3), ("n", 1, [9.0], "c", 2)], schema + ", batch_no int")
    rows = V.upsert(store, new).collect()
    assert len(rows) == 1 and rows[0].origin in "ab"
    assert V.upsert(store, new.repartition(3)).collect() == rows


def test_stream_of_batches_with_repeats(spark, tmp_path):
    source, schema = tmp_path / "in", "id bigint, question string"
    batches = [[(5, "A"), (5, "A"), (6, "a "), (7, "b")], [(1, "A"), (8, "c"), (7, "b")], [(8, "c"), (9, "d"), (2, "C")]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        A.accept_stream(stream, str(tmp_path / "reg"), str(tmp_path / "ck"), schema + ", question_hash string, batch_id int")
    got = spark.read.parquet(str(tmp_path / "reg"))
    assert sorted((r.id, r.question.strip().lower()) for r in got.collect()) == [(5, "a"), (7, "b"), (8, "c"), (9, "d")]
    assert got.select("batch_id").distinct().count() == 3


def test_nothing_is_capped(spark):
    p = spark.range(1, 26).select(F.lit(1).alias("k"), F.col("id").cast("int").alias("rank"), F.lit("s").alias("section"), F.lit("").alias("subsection"), F.lit("t").alias("text"))
    assert E.passage_blocks(p, "k").first().block.count("[Passage ") == 25
    accepted = spark.range(150_000).select(F.lit(1).alias("exam_set"), F.col("id").alias("place"), F.lit(1).alias("chapter_no"), F.col("id").cast("string").alias("question_uuid"))
    later = accepted.limit(1).withColumn("chapter_no", F.lit(2))
    ordered = BA.in_blueprint_order(accepted.unionByName(later))
    assert ordered.select("blueprint_chapter", "blueprint_place").distinct().count() == 150_001
    leak = spark.createDataFrame([(1, 1, "Press F5 now", ["a", "b"], "zz"), (2, 1, "Which?", ["5", "6"], "5")], "id bigint, exam_set int, question string, options array<string>, correct_answer string")
    assert [r.id for r in L.answer_leaks(leak).collect()] == [2]


def test_a_set_of_2500_rows_says_its_parts(spark, tmp_path):
    cols = "question options correct_answer difficulty bloom_level chapter validation_status tags".split()
    bank = spark.range(2500).select(
        F.lit(1).alias("exam_set"), "id", F.lit(5).cast("bigint").alias("created_epoch"),
        *[(F.array(F.lit("x")) if c in ("options", "tags") else F.lit("x")).alias(c) for c in cols],
    )
    IO.write_sets(bank, str(tmp_path / "sets"))
    docs = IO.read_sets(spark, str(tmp_path / "sets"))
    assert sorted((r.part, r.n_parts) for r in docs.collect()) == [(0, 3), (1, 3), (2, 3)]
    assert IO.questions_of(docs).select("id").distinct().count() == 2500
    assert IO.list_sets(docs).first().total_questions == 2500


def test_log_is_read_back_newest_first(spark, tmp_path):
    rows = [(i, f"u{i}", 1, "c", "q", "a", "easy", "v" * 70, "r", 100 + i % 3) for i in range(9)]
    df = spark.createDataFrame(rows, "id bigint, question_uuid string, exam_set int, chapter string, question string, correct_answer string, difficulty string, validator_failed string, reason string, created_epoch bigint")
    IO.append_log(B.rejection_log(df), str(tmp_path / "log"))
    log = B.newest_log(spark.read.parquet(str(tmp_path / "log")), 4)
    assert [(r.id, len(r.validator_failed)) for r in log.collect()] == [(8, 60), (5, 60), (2, 60), (7, 60)]


def test_a_thousand_tag_rules(spark):
    rules = [("ch1", i, f"word{i}$", f"slug{i}", ["apply"], ["easy"]) for i in range(1000)]
    rules = spark.createDataFrame(rules, "chapter_id string, ordinal int, pattern string, slug string, bloom_levels array<string>, difficulty array<string>")
    rows = spark.createDataFrame([("ch1", "a word998", "t"), ("ch1", "none", "has word3"), ("ch2", "word1", "t")], "chapter_id string, section_heading string, text string")
    got = {r.section_heading: r.topic_slug for r in S.tag_slugs(rows, rules).collect()}
    assert got["a word998"] == "slug998" and got["none"] == "slug3" and got["word1"] not in ("slug1",)
