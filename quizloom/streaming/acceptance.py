"""Running acceptance: a question is accepted once, whatever order the batches come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators.vector import last_versions
from ..sources.files import exists


def distinct_hashes(stream: DataFrame, event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Stateful form: first row per content hash.

    With ``event_time`` the state is dropped after ``delay``; the durable registry of
    ``accept_stream`` then catches what comes later still.
    """
    keyed = stream.withColumn("question_hash", X.content_hash(F.col("question")))
    if event_time is None:
        return keyed.dropDuplicates(["question_hash"])
    return keyed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["question_hash"])


def _batch_path(path: str, batch_id: int) -> str:
    return f"{path}/batch_id={batch_id}"


def accept_stream(stream: DataFrame, registry_path: str, checkpoint: str, registry_schema: T.StructType | str) -> None:
    """Accept unseen questions batch by batch into a registry folder.

    In a batch the row with the smallest id of a hash wins, and a row that arrives again is
    accepted once; earlier batches win over later ones. A
    batch writes its own sub-folder in overwrite mode and reads only the folders of
    earlier batches, so a replayed batch gives the same result.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        keyed = batch.withColumn("question_hash", X.content_hash(F.col("question")))
        whole = F.struct(*keyed.columns)
        firsts = keyed.groupBy("question_hash").agg(F.min_by(whole, F.struct("id", F.xxhash64(*keyed.columns))).alias("r"))
        fresh = firsts.select("r.*")
        if batch_id > 0 and exists(spark, registry_path):
            known = spark.read.schema(registry_schema).parquet(registry_path).where(F.col("batch_id") < batch_id)
            fresh = fresh.join(known.select("question_hash").distinct(), "question_hash", "left_anti")
        fresh.write.mode("overwrite").parquet(_batch_path(registry_path, batch_id))

    query = (
        stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def register_vectors(stream: DataFrame, store_path: str, checkpoint: str) -> None:
    """Upsert of arriving vectors: each batch is its own folder, readers take the last one.

    Nothing stored is rewritten when a batch arrives; ``current_vectors`` merges on read.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        last_versions(batch).write.mode("overwrite").parquet(_batch_path(store_path, batch_id))

    query = (
        stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def current_vectors(spark: SparkSession, store_path: str, schema: str) -> DataFrame:
    """Last registered version of every vector."""
    rows = spark.read.schema(f"{schema}, batch_id int").parquet(store_path)
    return last_versions(rows, "batch_id")
