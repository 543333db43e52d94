"""Sinks for timed rows, and what reads them back in order of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class EventSink:
    """Appends batches of rows to a folder, each with its time; use write_batch as a foreachBatch function."""

    def __init__(self, path: str):
        self.path = path

    def write(self, df: DataFrame, time: int) -> None:
        df.withColumn("_time", F.lit(time).cast("long")).write.mode("append").parquet(self.path)

    def write_batch(self, df: DataFrame, epoch: int) -> None:
        """A repeated epoch replaces what it wrote before."""
        df.withColumn("_time", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{self.path}/epoch={epoch}")

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.option("recursiveFileLookup", "true").parquet(self.path)


def extract_by_time(events: DataFrame, time: str = "_time", out: str = "data") -> DataFrame:
    """One row per time that has data, with its sorted rows. Collecting a whole time is the operator's contract; for large times use sorted_by_time()."""
    cols = [c for c in events.columns if c != time]
    item = F.col(cols[0]) if len(cols) == 1 else F.struct(*cols)
    return events.groupBy(time).agg(F.array_sort(F.collect_list(item)).alias(out))


def sorted_by_time(events: DataFrame, time: str = "_time") -> DataFrame:
    """All rows by time and value, range-partitioned."""
    return events.orderBy(time, *(c for c in events.columns if c != time))
