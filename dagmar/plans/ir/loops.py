"""Loops of the block IR."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dagmar.operators.graph import sources_on_targets
from dagmar.sources.program import Program


def loops(spark: SparkSession, p: Program) -> DataFrame:
    """(src, dst): jump edges whose source is on a cycle or is led to from one."""
    return sources_on_targets(spark, p.jump_edges())
