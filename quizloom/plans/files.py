"""Queries: write what the tables give, read it back through the file sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import bank as B
from ..operators import segment as G
from ..operators.enrich import slug_metadata
from ..session import scratch_path
from ..sources import files as IO
from .catalog import query, with_
from .items import ITEMS_SQL, items, table
from .segments import _ASCII as ASCII_SQL
from .segments import _HOME as HOME_SQL
from .segments import _KW as KEYWORDS_SQL
from .segments import BOOK_LINES, TAGGED, _raw_chunks, _tagged


@query(
    "chapter_files",
    "SELECT doc_id, CAST(i - 1 AS INT) AS place, md5(l[i]) AS notes FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)",
)
def chapter_files(spark, sf):
    d = table(spark, sf, "documents")
    topics = F.transform(F.split("text", "\n"), lambda x: F.struct(F.col("source").alias("topic"), x.alias("notes")))
    path = scratch_path(spark, "chapters")
    IO.write_json_lines(d.select(F.lit("course").alias("course"), F.col("doc_id").cast("string").alias("chapter"), F.col("lang").alias("summary"), topics.alias("topics")), path)
    topics = IO.read_chapters(spark, path, lines=True)
    return topics.select(F.col("chapter").cast("bigint").alias("doc_id"), "place", F.md5("notes").alias("notes"))


@query(
    "json_lines_with_bad_rows",
    "SELECT CASE WHEN doc_id % 13 = 0 THEN 'bad' ELSE 'good' END AS kind, count(*) AS n, CAST(sum(CASE WHEN doc_id % 13 = 0 THEN 0 ELSE length(text) END) AS BIGINT) AS chars FROM documents GROUP BY 1",
)
def json_lines_with_bad_rows(spark, sf):
    record = F.to_json(F.struct(*[F.col(c) for c in ("id", "text", "chapter", "content_type", "section")]))
    no = F.regexp_extract("id", r"(\d+)$", 1).cast("bigint")
    lines = _raw_chunks(spark, sf).select(
        F.when(no % 13 == 0, F.regexp_replace(record, r"\}$", "")).otherwise(F.concat(record, F.lit("\n"))).alias("value")
    )
    path = scratch_path(spark, "lines")
    lines.write.text(path)
    good, bad = IO.read_json_lines(spark, path, S.RAW_CHUNK)
    return (
        good.select(F.lit("good").alias("kind"), F.length("text").alias("c"))
        .unionByName(bad.select(F.lit("bad").alias("kind"), F.lit(0).alias("c")))
        .groupBy("kind").agg(F.count("*").alias("n"), F.sum("c").alias("chars"))
    )


@query("raw_chunk_source", "SELECT 'chunk-' || lpad(CAST(doc_id AS VARCHAR), CAST(greatest(4, length(CAST(doc_id AS VARCHAR))) AS INT), '0') AS id, lang AS chapter, md5(text) AS digest FROM documents")
def raw_chunk_source(spark, sf):
    path = scratch_path(spark, "raw")
    IO.write_json_lines(_raw_chunks(spark, sf), path)
    chunks, _ = IO.read_raw_chunks(spark, path, path + "-missing.md")
    return chunks.select("id", "chapter", F.md5("text").alias("digest"))


@query(
    "slug_chunk_files",
    "WITH RECURSIVE " + BOOK_LINES + ",\n" + TAGGED
    + f""" SELECT chapter_id || '_' || topic_slug || '_' || doc_id || '_' || section_no AS chunk_id, chapter_id || ':' || topic_slug AS concept_id, 'book_v1' AS book_id,
 array_to_string({KEYWORDS_SQL}, ',') AS keywords, CAST(least(n, 2000) AS INTEGER) AS n, {HOME_SQL} AS home_chapter
 FROM (SELECT * REPLACE ({ASCII_SQL} AS text), length(text) AS n FROM tg)""",
)
def slug_chunk_files(spark, sf):
    tagged = _tagged(spark, sf).select(
        F.concat_ws("_", "chapter_id", "topic_slug", F.col("doc_id").cast("string"), F.col("section_no").cast("string")).alias("chunk_id"),
        "chapter_id", F.lit("book").alias("chapter_name"), "section_heading", "topic_slug", "concept_id", F.lit(None).cast("string").alias("book_id"),
        "chunk_type", "bloom_levels", "difficulty", "keywords", "used_in_sets", "q_count", "home_chapter", "cross_ref", "text",
    )
    path = scratch_path(spark, "slugs")
    IO.write_json_lines(tagged, path)
    m = slug_metadata(IO.read_slug_chunks(spark, path))
    return m.select("chunk_id", "concept_id", "book_id", F.array_join("keywords", ",").alias("keywords"), F.length("text").alias("n"), "home_chapter")


def _exported(spark, sf):
    bank = items(spark, sf).select(
        "exam_set", "id", "question", "options", "correct_answer", "difficulty", "bloom_level", "chapter", "validation_status", "tags", "created_epoch"
    )
    path = scratch_path(spark, "sets")
    IO.write_sets(bank, path)
    return IO.read_sets(spark, path)


@query("exported_set_listing", with_(ITEMS_SQL, body="SELECT exam_set, count(*) AS total_questions, max(created_epoch) AS generated_epoch FROM items GROUP BY 1"))
def exported_set_listing(spark, sf):
    return IO.list_sets(_exported(spark, sf))


@query("exported_questions", with_(ITEMS_SQL, body="SELECT exam_set, id, CAST(position AS BIGINT) AS q_no, md5(question) AS digest, array_to_string(options, '|') AS options, correct_answer, array_to_string(tags, ',') AS tags FROM items"))
def exported_questions(spark, sf):
    return IO.questions_of(_exported(spark, sf)).select(
        "exam_set", "id", "q_no", F.md5("question").alias("digest"), F.array_join("options", "|").alias("options"), "correct_answer", F.array_join("tags", ",").alias("tags")
    )


@query("appended_log", with_(ITEMS_SQL, body="SELECT id, created_epoch, chapter, validation_status AS validator_failed, md5(question) AS digest FROM items WHERE validation_status <> 'approved' ORDER BY created_epoch DESC, id DESC LIMIT 100"))
def appended_log(spark, sf):
    bank = items(spark, sf)
    path = scratch_path(spark, "log")
    for status in ("rejected", "pending"):
        rows = bank.where(F.col("validation_status") == status).withColumns({"validator_failed": F.lit(status), "reason": F.lit("label")})
        IO.append_log(B.rejection_log(rows), path)
    log = B.newest_log(spark.read.schema(S.VALIDATION_LOG).parquet(path), 100)
    return log.select("id", "created_epoch", "chapter", "validator_failed", F.md5("question_text").alias("digest"))


@query("final_chunk_files")
def final_chunk_files(spark, sf):
    path = scratch_path(spark, "final")
    IO.write_json_lines(G.chunk_metadata(G.expand_chunks(_raw_chunks(spark, sf), "chunks.jsonl")), path)
    return spark.read.schema("id string, chapter string, char_count int, chunk_index int, text string").json(path)
