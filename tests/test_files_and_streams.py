"""File sources, appends and streams, with restarts."""

import json

import numpy as np
from pyspark.sql import functions as F

from quizloom import schemas
from quizloom.operators import bank as B
from quizloom.operators import rules as Q
from quizloom.operators import segment as G2
from quizloom.operators import slugs as G
from quizloom.operators import vector as V
from quizloom.plans import streams as P
from quizloom.sources import files as IO
from quizloom.streaming import acceptance as A

STREAM = "id bigint, question string"
REGISTRY = "id bigint, question string, question_hash string, batch_id int"


def _feed(spark, path, rows):
    spark.createDataFrame(rows, STREAM).coalesce(1).write.mode("append").json(path)


def test_acceptance_over_batches_and_restarts(spark, tmp_path):
    src, reg, chk = (str(tmp_path / n) for n in ("in", "reg", "chk"))
    batches = [
        [(1, "Alpha"), (2, "alpha "), (3, "Beta")],
        [(4, "BETA"), (5, "Gamma"), (6, "gamma")],
        [(7, "Alpha"), (8, "Delta")],
    ]
    for rows in batches:
        _feed(spark, src, rows)
        stream = spark.readStream.schema(STREAM).json(src)
        A.accept_stream(stream, reg, chk, REGISTRY)
    got = sorted(r.id for r in spark.read.schema(REGISTRY).parquet(reg).collect())
    assert got == [1, 3, 5, 8]
    every = spark.createDataFrame([(i, 1, t) for b in batches for i, t in b], "id bigint, exam_set int, question string")
    kept = sorted(r.id for r in Q.duplicate_kinds(every).where("duplicate IS NULL").collect())
    assert kept == got


def test_vector_registry_last_version_wins(spark, tmp_path):
    src, store, chk = (str(tmp_path / n) for n in ("vin", "store", "vchk"))
    schema = "namespace string, id bigint, vec array<float>, version int"
    for v, ids in enumerate([[1, 2], [2, 3]]):
        spark.createDataFrame([("n", i, [float(v)], v) for i in ids], schema).coalesce(1).write.mode("append").parquet(src)
        A.register_vectors(spark.readStream.schema(schema).parquet(src), store, chk)
    got = {r.id: r.vec[0] for r in A.current_vectors(spark, store, schema).collect()}
    assert got == {1: 0.0, 2: 1.0, 3: 1.0}


def test_json_lines_quarantine(spark, tmp_path):
    p = tmp_path / "c.jsonl"
    p.write_text('{"id": "a", "text": "x"}\n\n{"id": "b", "te\n{"id": "c", "text": "y"}\n')
    good, bad = IO.read_json_lines(spark, str(p), schemas.RAW_CHUNK)
    assert sorted(r.id for r in good.collect()) == ["a", "c"] and bad.count() == 1


def test_markdown_is_the_second_choice(spark, tmp_path):
    md = tmp_path / "b.md"
    md.write_text("## One\nbody\n### Sub\nmore\n")
    chunks, name = IO.read_raw_chunks(spark, str(tmp_path / "none.jsonl"), str(md))
    assert name == "b.md" and [(r.chapter, r.section) for r in chunks.orderBy("id").collect()] == [("One", ""), ("One", "Sub")]


def test_chunks_of_two_markdown_files_have_ids_of_their_own(spark, tmp_path):
    (tmp_path / "md").mkdir()
    for name in ("a", "b"):
        (tmp_path / "md" / f"{name}.md").write_text("## One\nthe same body\n")
    chunks, name = IO.read_raw_chunks(spark, str(tmp_path / "none.jsonl"), str(tmp_path / "md"))
    final = G2.chunk_metadata(G2.expand_chunks(chunks, name)).collect()
    assert len(final) == 2 == len({r.id for r in final}) and sorted(r.document for r in chunks.collect()) == ["a.md", "b.md"]
    one = G2.expand_chunks(chunks.drop("document").limit(1), name).first()
    assert one.source_id == "md-00000"


def test_chapter_files(spark, tmp_path):
    doc = {"course": "c", "chapter": "Ch", "summary": "s", "topics": [{"topic": "t1", "notes": "n1"}, {"topic": "t2", "notes": "n2"}]}
    (tmp_path / "one.json").write_text(json.dumps(doc, indent=2))
    rows = IO.read_chapters(spark, str(tmp_path)).orderBy("place").collect()
    assert [(r.topic, r.notes) for r in rows] == [("t1", "n1"), ("t2", "n2")]


def test_slug_rules_are_read_in_order(spark, tmp_path):
    rules = [{"chapter_id": "ch1", "ordinal": i, "pattern": p, "slug": p, "bloom_levels": ["apply"], "difficulty": ["easy"]} for i, p in ((2, "b"), (1, "a"))]
    (tmp_path / "r.json").write_text("\n".join(json.dumps(r) for r in rules))
    assert [r.slug for r in IO.read_slug_rules(spark, str(tmp_path)).orderBy("ordinal").collect()] == ["a", "b"]


def test_append_skips_known_uuid_and_hash(spark):
    schema = "id bigint, question_uuid string, question string"
    bank = spark.createDataFrame([(1, "u1", "Alpha")], schema)
    new = spark.createDataFrame([(2, "u2", " alpha"), (3, "u1", "Beta"), (4, "u4", "Gamma"), (5, "u5", "gamma"), (6, "u4", "Delta")], schema)
    assert [r.id for r in B.new_rows(bank, new).collect()] == [4]


def test_set_documents_are_cut_into_parts(spark):
    bank = spark.range(25).select(F.lit(1).alias("exam_set"), "id", F.lit(5).cast("bigint").alias("created_epoch"))
    parts = B.set_documents(bank, part_rows=10).orderBy("part").collect()
    assert [len(p.questions) for p in parts] == [10, 10, 5]
    assert [q.id for p in parts for q in p.questions] == list(range(25))


def test_slug_sampling_borrows(spark):
    rows = [(1, 1, f"s{i}", i, ["easy"] if i < 6 else ["hard", "easy"], 0.5) for i in range(9)]
    av = spark.createDataFrame(rows, "exam_set int, chapter_no int, topic_slug string, id bigint, difficulty array<string>, score double")
    q = spark.createDataFrame([(1, 1, 8, 4, 3, 1)], "exam_set int, chapter_no int, n_questions int, quota_easy int, quota_medium int, quota_hard int")
    got = G.sample_by_difficulty(av, q).collect()
    assert len(got) == 8 and len({r.topic_slug for r in got}) == 8
    assert sum(r.target_difficulty == "easy" for r in got) == 6


def test_all_used_slugs_may_be_reused(spark):
    vec = [1.0, 0.0]
    pool = spark.createDataFrame([(1, 1, "a", ["1"], vec, ["easy"]), (2, 1, "b", [], vec, ["easy"])], "id bigint, chapter_no int, topic_slug string, used_in_sets array<string>, vec array<double>, difficulty array<string>")
    ask = spark.createDataFrame([(1, vec)], "chapter_no int, vec array<double>")
    sets = spark.createDataFrame([(1,), (2,)], "exam_set int")
    got = {(r.exam_set, r.topic_slug) for r in G.available_slugs(pool, ask, sets).collect()}
    assert got == {(1, "b"), (2, "a"), (2, "b")}
    used = pool.where("topic_slug = 'a'")
    assert {(r.exam_set, r.topic_slug) for r in G.available_slugs(used, ask, sets).collect()} == {(1, "a"), (2, "a")}


def test_distractor_limits(spark):
    vec = {"ans": [1.0, 0.0], "far": [0.29, float(np.sqrt(1 - 0.29**2))], "ok": [0.5, float(np.sqrt(0.75))], "near": [0.98, float(np.sqrt(1 - 0.98**2))]}
    vectors = spark.createDataFrame([(k, v) for k, v in vec.items()], "text string, vec array<double>")
    bank = spark.createDataFrame(
        [(1, ["ans", "ok", "far", "near"], "ans", "standard"), (2, ["near", "ans", "ok", "ok"], "ans", "standard"), (3, ["far", "ans", "ok", "ok"], "ans", "sequence_order")],
        "id bigint, options array<string>, correct_answer string, question_type string",
    )
    got = {r.id: r.reason for r in V.distractor_reason(V.distractor_scores(bank, vectors, ["sequence_order"])).collect()}
    assert got == {1: "option_3_distant", 2: "option_1_too_close"}


def test_streams_read_a_table_that_is_a_folder(spark, tmp_path):
    docs = [(i, f"text {i % 5}") for i in range(20)]
    spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    vectors = [(i, i, [float(i)]) for i in range(7)]
    spark.createDataFrame(vectors, "vec_id bigint, label int, embedding array<float>").repartition(2).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert sorted(r.id for r in P.stream_acceptance(spark, str(tmp_path)).collect()) == [0, 1, 2, 3, 4]
    got = {(r.namespace, r.id) for r in P.stream_vector_registry(spark, str(tmp_path)).collect()}
    assert got == {(f"set{i % 3}", i) for i in range(7)}


def test_pieces_are_held_a_few_texts_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(G2, "SPLIT_ROWS", 2)
    texts = {f"c{i}": " ".join(f"word{i * j % 97}." for j in range(i * 40)) for i in range(1, 12)}
    columns = ["book", "chapter", "section", "subsection", "content_type", "question_type"]
    raw = spark.createDataFrame(list(texts.items()), "id string, text string").coalesce(1)
    raw = raw.select("*", *[F.lit(None).cast("string").alias(c) for c in columns])
    final = G2.expand_chunks(raw, "f.jsonl")
    want = [(i, k, p) for i, t in texts.items() for k, p in enumerate(G2.split_text(t) if len(t) > 800 else [t])]
    assert sorted((r.source_id, r.chunk_index, r.text) for r in final.collect()) == sorted(want)
    assert "ArrowEvalPython" not in final._jdf.queryExecution().optimizedPlan().toString()
