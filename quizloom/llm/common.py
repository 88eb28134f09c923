"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: what follows starts from files
    that outlive any executor, and Python or shuffles above are not run twice."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def kept_in_worker(key: str, make, version: str = ""):
    """A value that lives as long as the Python worker, so that the next task finds it filled;
    another version takes its place. The first word of ``key`` names the operator: what others
    have kept is freed, and so is what earlier tasks left unused in the worker."""
    store = sys.__dict__.setdefault("_kept_in_worker", {})
    if any(k.split()[0] != key.split()[0] for k in store):
        drop_kept_in_worker()
        store = sys.__dict__.setdefault("_kept_in_worker", {})
    if key not in store or store[key][0] != version:
        store.pop(key, None)
        _release_unused()
        store[key] = (version, make())
    return store[key][1]


def drop_kept_in_worker() -> None:
    """Free what operators kept in this Python worker, and hand the memory back to the system."""
    if sys.__dict__.pop("_kept_in_worker", None):
        _release_unused()


def _release_unused() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


class Memo(dict):
    """``fn`` remembered for up to ``limit`` arguments; then it starts anew."""

    def __init__(self, fn, limit: int):
        super().__init__()
        self.fn, self.limit = fn, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.fn(key)
        return value


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list: columns ``node``, ``comp`` (its smallest
    node), for nodes with an edge to another one. Large-star and small-star rounds: a round is
    two grouped minima, combined before the shuffle, and joins that Spark can split at a hub."""

    def lowest(df: DataFrame) -> DataFrame:
        return df.groupBy("v").agg(F.min("m").alias("low")).select(F.col("v").alias("k"), "low")

    start = edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("m")).where("v <> m").distinct()
    now, state = _counted(start)
    while state[0]:
        both = now.unionByName(now.select(F.col("m").alias("v"), F.col("v").alias("m")))
        low = lowest(both).withColumn("low", F.least("k", "low"))
        large = both.where("m > v").join(low, F.col("v") == F.col("k")).select(F.col("m").alias("v"), F.col("low").alias("m"))
        large = saved(large.where("v <> m"), "edges")
        low = lowest(large)
        small = large.join(low, F.col("v") == F.col("k")).select(F.col("m").alias("v"), F.col("low").alias("m"))
        small = small.where("v <> m").unionByName(low.select(F.col("k").alias("v"), F.col("low").alias("m")))
        before = state
        now, state = _counted(small.distinct())
        if state == before:
            break
    roots = now.select(F.col("m").alias("node"), F.col("m").alias("comp")).distinct()
    return now.select(F.col("v").alias("node"), F.col("m").alias("comp")).unionByName(roots)


def _counted(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The saved edges with their number and checksum, taken while they are written."""
    seen = Observation()
    out = saved(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(v, m))").alias("sum")), "edges")
    return out, (seen.get["n"], seen.get["sum"])
