"""Loops, inline costs and the pass pipeline of the graph IR."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dagmar.functions.scalars import node_inline_cost
from dagmar.operators.graph import sources_on_targets, strongly_connected
from dagmar.plans.graph_ir.dce import dce
from dagmar.plans.graph_ir.folding import constant_folding
from dagmar.sources.program import ProgramGraph

#: Fixed value: the cost up to which a function counts as trivial.
THRESHOLD = 100


def detect_loops(spark: SparkSession, graph: ProgramGraph) -> DataFrame:
    """(src, dst): control edges on cycles."""
    return sources_on_targets(spark, strongly_connected(spark, graph.control_edges))


def function_costs(spark: SparkSession, graph: ProgramGraph) -> DataFrame:
    """(end_id, cost): the inline cost of all nodes of each function."""
    costs = graph.nodes.select("node_id", node_inline_cost(F.col("kind")).alias("cost"))
    return graph.node_memberships(spark).join(costs, "node_id").groupBy("end_id").agg(F.sum("cost").cast("long").alias("cost"))


def trivial_inline(spark: SparkSession, graph: ProgramGraph, threshold: int = THRESHOLD) -> DataFrame:
    """Functions that cost no more than the threshold."""
    return function_costs(spark, graph).where(F.col("cost") <= threshold)


def optimise(spark: SparkSession, graph: ProgramGraph) -> ProgramGraph:
    """Dead code, folding, dead code."""
    return dce(spark, constant_folding(spark, dce(spark, graph).written(spark))).written(spark)
