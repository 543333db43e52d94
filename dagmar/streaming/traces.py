"""Shared indexes by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dagmar.operators.exchange import arrange_by_key
from dagmar.operators.rowwise import DIFF
from dagmar.operators.zset import consolidate
from dagmar.plans.lineage import materialise


class TraceManager:
    """Arranged relations that several queries read.

    A trace with _time holds its history; advance_by forgets the difference
    between times before a frontier, distinguish_since rewrites the table.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._traces: dict[str, DataFrame] = {}

    def insert_trace(self, name: str, df: DataFrame, *key: str) -> DataFrame:
        if name in self._traces:
            raise KeyError(f"there is a trace {name}")
        self._traces[name] = arrange_by_key(df, *(key or df.columns[:1]))
        return self._traces[name]

    def get_trace(self, name: str) -> DataFrame:
        return self._traces[name]

    def remove_trace(self, name: str) -> DataFrame:
        return self._traces.pop(name).unpersist()

    def advance_by(self, name: str, frontier: int) -> DataFrame:
        """Changes of times before the frontier count as of the frontier; equal rows add up."""
        from pyspark.sql import functions as F

        old = self._traces[name]
        if not {DIFF, "_time"} <= set(old.columns):
            raise ValueError(f"{name} has no times")
        moved = consolidate(old.withColumn("_time", F.greatest(F.col("_time"), F.lit(frontier))))
        new = materialise(self.spark, moved.select(*old.columns))
        old.unpersist()
        self._traces[name] = new
        return new

    def distinguish_since(self, name: str) -> DataFrame:
        """Rewrite the trace into one table."""
        old = self._traces[name]
        self._traces[name] = materialise(self.spark, old)
        old.unpersist()
        return self._traces[name]
