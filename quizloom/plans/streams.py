"""Queries: streams over the driver tables, run until the input is used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.files import is_folder
from ..streaming import acceptance as A
from .bank import HASH
from .catalog import query
from .items import table


def _stream(spark, sf, name):
    """A table as a stream of files, be it one file or a folder of files."""
    schema, path = table(spark, sf, name).schema, f"{sf}/{name}.parquet"
    stream = spark.readStream.schema(schema)
    return stream.parquet(path) if is_folder(spark, path) else stream.option("pathGlobFilter", f"{name}.parquet").parquet(sf)


@query("stream_acceptance", f"SELECT min(doc_id) AS id, {HASH} AS question_hash FROM (SELECT doc_id, text AS question FROM documents) GROUP BY 2")
def stream_acceptance(spark, sf):
    path, check = scratch_path(spark, "registry"), scratch_path(spark, "check")
    stream = _stream(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("question"))
    A.accept_stream(stream, path, check, "id bigint, question string, question_hash string, batch_id int")
    return spark.read.schema("id bigint, question_hash string, batch_id int").parquet(path).select("id", "question_hash")


@query("stream_distinct_hashes", f"SELECT DISTINCT {HASH} AS question_hash FROM (SELECT text AS question FROM conversations)")
def stream_distinct_hashes(spark, sf):
    path, check = scratch_path(spark, "distinct"), scratch_path(spark, "check")
    stream = _stream(spark, sf, "conversations").select(F.col("text").alias("question"))
    out = A.distinct_hashes(stream).select("question_hash").writeStream.format("parquet")
    out.option("path", path).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("question_hash string").parquet(path)


@query("stream_vector_registry", "SELECT 'set' || (label % 3) AS namespace, vec_id AS id, 0 AS version FROM embeddings")
def stream_vector_registry(spark, sf):
    path, check = scratch_path(spark, "vectors"), scratch_path(spark, "check")
    stream = _stream(spark, sf, "embeddings").select(
        F.concat(F.lit("set"), (F.col("label") % 3).cast("string")).alias("namespace"), F.col("vec_id").alias("id"),
        F.col("embedding").alias("vec"), F.lit(0).alias("version"),
    )
    A.register_vectors(stream, path, check)
    return A.current_vectors(spark, path, "namespace string, id bigint, vec array<float>, version int").select("namespace", "id", "version")


@query(
    "stream_event_messages",
    "SELECT event_type, count(DISTINCT sha256(lower(event_type || ' ' || CAST(user_id AS VARCHAR)))) AS n FROM events GROUP BY 1",
)
def stream_event_messages(spark, sf):
    path, check = scratch_path(spark, "events"), scratch_path(spark, "check")
    stream = _stream(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("question"), "event_type"
    )
    A.accept_stream(stream, path, check, "id bigint, question string, event_type string, question_hash string, batch_id int")
    return spark.read.schema("event_type string, batch_id int").parquet(path).groupBy("event_type").agg(F.count("*").alias("n"))
