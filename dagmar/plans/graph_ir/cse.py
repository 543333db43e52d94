"""Common subexpressions of the graph IR."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dagmar.plans.graph_ir.folding import reroute
from dagmar.plans.lineage import materialise
from dagmar.sources.program import ProgramGraph


def equal_constants(spark: SparkSession, graph: ProgramGraph) -> DataFrame:
    """(node, other): constants with an equal one of a smaller id in the same function, and the smallest of those."""
    owned = graph.nodes.where("kind = 'Constant'").join(graph.node_memberships(spark), "node_id")
    value = ["u8", "b", "arr"]
    least = owned.groupBy("end_id", *value).agg(F.min("node_id").alias("other"), F.count("*").alias("_n")).where("_n > 1").withColumnRenamed("end_id", "_end").withColumnsRenamed({c: f"_{c}" for c in value})
    same = F.col("end_id") == F.col("_end")
    for c in value:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return owned.join(least, same).where("node_id <> other").select(F.col("node_id").alias("node"), "other")


def cse(spark: SparkSession, graph: ProgramGraph) -> ProgramGraph:
    """Consumers of equal constants take the smallest; the others are left for dead code elimination."""
    return reroute(graph, materialise(spark, equal_constants(spark, graph)))
