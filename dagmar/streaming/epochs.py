"""Epochs as micro-batches: relations that change, kept up to date in tables.

A source of changes carries payload columns and _diff. Each micro-batch is one
epoch; its state is written as a new version, so a batch that is repeated after
a failure starts from the same state and gives the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dagmar.operators.rowwise import DIFF
from dagmar.operators.zset import concat, consolidate


class VersionedState:
    """A Z-set in a folder per version; a version holds all changes up to its epoch, consolidated."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), f"{schema}, {DIFF} bigint"

    def _versions(self) -> list[int]:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        done = [n for n in names if n.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(int(n[2:]) for n in done)

    def read(self, before: int | None = None) -> DataFrame:
        """The newest version, or the newest one older than an epoch."""
        held = [v for v in self._versions() if before is None or v < before]
        if not held:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={held[-1]}")

    def write(self, df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v={epoch}")

    def compact(self, keep: int = 2) -> None:
        """Drop all but the newest versions."""
        jvm = self.spark._jvm
        for v in self._versions()[:-keep]:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/v={v}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def maintain(changes: DataFrame, state: VersionedState, checkpoint: str, on_epoch: Callable[[DataFrame, DataFrame, int], None] | None = None, monotone: bool = False, available_now: bool = True) -> StreamingQuery:
    """Keep a relation up to date from a stream of signed changes.

    on_epoch(delta, state, epoch) sees each epoch's consolidated changes and the
    state after them. With monotone, retractions are dropped on the way in.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        delta = consolidate(batch.where(F.col(DIFF) >= 0) if monotone else batch)
        state.write(consolidate(concat(state.read(before=epoch), delta)), epoch)
        state.compact(keep=8)
        if on_epoch:
            on_epoch(delta, state.read(), epoch)

    writer = changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def counts_by_key(changes: DataFrame, *key: str) -> DataFrame:
    """A streaming count of each key's multiplicity, for outputMode("update")."""
    return changes.groupBy(*key).agg(F.sum(DIFF).alias("n"))


def probe_done(query: StreamingQuery) -> int:
    """Wait for all available input; the number of epochs that were worked through."""
    query.processAllAvailable() if query.isActive else query.awaitTermination()
    progress = query.lastProgress
    return -1 if progress is None else progress["batchId"]


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """An extension: events per type and window of event time, with late data bounded by a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
