"""A bank stored for paging: page n reads the files that hold it, and nothing before them.

Rows lie in files of bounded length, in set and id order from file to file. A table of counts tells how many rows of each
combination of filter values a file holds, so the files of a page and the total come from the counts alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import scratch_path
from .bank import PAGE_LIMIT

ORDER = ["exam_set", "id"]
#: Rows of a file. The counts have a row for each file and combination of filter values.
FILE_ROWS = 100_000


@dataclass
class PagedBank:
    spark: SparkSession
    path: str
    schema: StructType
    filters: list[str]

    def spans(self, **conditions) -> DataFrame:
        """Files with rows that meet the conditions, in order: ``file``, ``n`` such rows, ``before`` in earlier files, ``total``."""
        counts = self.spark.read.parquet(f"{self.path}/counts")
        for name, value in conditions.items():
            counts = counts.where(F.col(name) == value)
        files = counts.groupBy("file", "place").agg(F.sum("n").alias("n"))
        # One window over the files (not the rows) of the bank.
        order = Window.partitionBy(F.lit("files")).orderBy("place")
        before = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1))
        every = F.sum("n").over(Window.partitionBy(F.lit("files")))
        return files.select("file", "n", F.coalesce(before, F.lit(0)).alias("before"), every.alias("total"))

    def page(self, number: int, size: int = 50, seen: dict | None = None, **conditions) -> DataFrame:
        """One page in set and id order, with the total on every row; ``conditions`` are equalities on filter columns.

        ``seen`` receives the number of files that are read: as many as hold the page's rows.
        """
        if number < 1 or not 1 <= size <= PAGE_LIMIT:
            raise ValueError(f"page starts at 1 and holds 1 to {PAGE_LIMIT} rows")
        unknown = set(conditions) - set(self.filters)
        if unknown:
            raise ValueError(f"no counts by {sorted(unknown)}")
        start = (number - 1) * size
        # A file on the page holds one of its rows at least, so there are no more than rows.
        spans = self.spans(**conditions).where((F.col("before") < start + size) & (F.col("before") + F.col("n") > start)).collect()
        if seen is not None:
            seen["files"] = len(spans)
        if not spans:
            return self.spark.createDataFrame([], self.schema).withColumn("total", F.lit(0).cast("bigint"))
        rows = self.spark.read.schema(self.schema).parquet(*[s.file for s in spans])
        for name, value in conditions.items():
            rows = rows.where(F.col(name) == value)
        first = start - min(s.before for s in spans)
        return rows.orderBy(*ORDER).offset(first).limit(size).withColumn("total", F.lit(spans[0].total))


def store(bank: DataFrame, filters: list[str], path: str | None = None, file_rows: int = FILE_ROWS) -> PagedBank:
    """Store ``bank`` (with ``exam_set`` and ``id``) for paging below ``path`` (a new folder of the shared one if none is named)."""
    spark = bank.sparkSession
    path = path or scratch_path(spark, "pages")
    bank.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).write.option("maxRecordsPerFile", file_rows).parquet(f"{path}/rows")
    rows = spark.read.schema(bank.schema).parquet(f"{path}/rows").withColumn("_file", F.input_file_name())
    counts = rows.groupBy("_file", *filters).agg(F.count("*").alias("n"), F.min(F.struct(*ORDER)).alias("_first"))
    # A file's place is that of its first row, which each of its combinations has to carry.
    place = F.min("_first").over(Window.partitionBy("_file"))
    counts.select(F.col("_file").alias("file"), place.alias("place"), *filters, "n").write.parquet(f"{path}/counts")
    return PagedBank(spark, path, bank.schema, filters)
