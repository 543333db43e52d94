"""Folding of the graph IR: algebra first, then nodes whose operands are constants.

An operation's operands are its lhs and rhs, in that order, and its value edges
lead to them; a rewrite changes both.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dagmar.functions.scalars import compare, wrap_u8
from dagmar.operators.graph import NotConverged
from dagmar.plans.fixpoint import fixpoint
from dagmar.plans.lineage import materialise
from dagmar.sources.program import ProgramGraph


def reroute(graph: ProgramGraph, to: DataFrame) -> ProgramGraph:
    """Consumers of node take other instead, for (node, other): value edges and operands."""
    edges = graph.value_edges.join(to.select(F.col("node").alias("dst"), F.col("other").alias("_to")), "dst", "left").select("src", F.coalesce("_to", "dst").alias("dst"))
    nodes = graph.nodes
    for side in ("lhs", "rhs"):
        nodes = nodes.join(to.select(F.col("node").alias(side), F.col("other").alias("_to")), side, "left").withColumn(side, F.coalesce("_to", side)).drop("_to")
    return replace(graph, value_edges=edges, nodes=nodes.select(*graph.nodes.columns))


def _constants(graph: ProgramGraph) -> DataFrame:
    return graph.nodes.where("kind = 'Constant'").select(F.col("node_id").alias("const_id"), "u8", "b")


def zero_additions(spark: SparkSession, graph: ProgramGraph) -> DataFrame:
    """(node, other): additions of zero, with the operand they are equal to; chains of them lead to their end."""
    zeros = graph.nodes.where("kind = 'Constant' and u8 = 0").select("node_id")
    z = lambda side: zeros.select(F.col("node_id").alias(side), F.lit(True).alias(f"_{side}"))
    adds = graph.nodes.where("kind = 'Add'").select("node_id", "lhs", "rhs").join(z("lhs"), "lhs", "left").join(z("rhs"), "rhs", "left")
    found = adds.select(F.col("node_id").alias("node"), F.when(F.col("_rhs"), F.col("lhs")).when(F.col("_lhs"), F.col("rhs")).alias("other")).where("other is not null and other <> node")

    def halve(df: DataFrame) -> DataFrame:
        beyond = df.select(F.col("node").alias("other"), F.col("other").alias("_next"))
        return df.join(beyond, "other", "left").select("node", F.coalesce("_next", "other").alias("other")).where("node <> other")

    return fixpoint(spark, found, halve)


def zero_addition(spark: SparkSession, graph: ProgramGraph) -> ProgramGraph:
    """x + 0 and 0 + x are x: their consumers take x."""
    return reroute(graph, zero_additions(spark, graph))


def _become_constants(graph: ProgramGraph, values: DataFrame) -> ProgramGraph:
    """Nodes of values (node_id, u8, b) become constants and lose their value edges."""
    new = values.select("node_id", F.col("u8").alias("_u8"), F.col("b").alias("_b"), F.lit(True).alias("_hit"))
    rows = graph.nodes.join(new, "node_id", "left")
    hit = F.coalesce("_hit", F.lit(False))
    none = F.lit(None)
    to = {"kind": F.lit("Constant"), "lhs": none.cast("long"), "rhs": none.cast("long"), "cmp_kind": none.cast("string"), "u8": F.col("_u8").cast("int"), "b": F.col("_b"), "ty": F.when(F.col("_b").isNotNull(), "bool").otherwise("u8")}
    nodes = rows.select(*(F.when(hit, to[c]).otherwise(F.col(c)).alias(c) if c in to else F.col(c) for c in graph.nodes.columns))
    edges = graph.value_edges.join(values.select(F.col("node_id").alias("src")), "src", "left_anti").select("src", "dst")
    return replace(graph, nodes=nodes, value_edges=edges)


def self_subtractions(graph: ProgramGraph) -> DataFrame:
    """(node_id): subtractions of a node from itself."""
    return graph.nodes.where("kind = 'Sub' and lhs = rhs").select("node_id")


def self_subtract(graph: ProgramGraph) -> ProgramGraph:
    """x - x is 0."""
    return _become_constants(graph, self_subtractions(graph).select("node_id", F.lit(0).alias("u8"), F.lit(None).cast("boolean").alias("b")))


def algebraic_simplification(spark: SparkSession, graph: ProgramGraph) -> ProgramGraph:
    return self_subtract(zero_addition(spark, graph))


def foldable(graph: ProgramGraph) -> DataFrame:
    """(node_id, u8, b): operations on two byte constants, with their results."""
    c = lambda side: _constants(graph).select(F.col("const_id").alias(side), F.col("u8").alias(f"_{side}"))
    ops = graph.nodes.where(F.col("kind").isin("Add", "Sub", "Mul", "Cmp")).select("node_id", "kind", "cmp_kind", "lhs", "rhs").join(c("lhs"), "lhs").join(c("rhs"), "rhs")
    ops = ops.where("_lhs is not null and _rhs is not null")
    cmp = F.col("kind") == "Cmp"
    return ops.select("node_id", F.when(~cmp, wrap_u8(F.col("kind"), F.col("_lhs"), F.col("_rhs"))).alias("u8"), F.when(cmp, compare(F.col("cmp_kind"), F.col("_lhs"), F.col("_rhs"))).alias("b"))


def fold_constants(graph: ProgramGraph) -> ProgramGraph:
    return _become_constants(graph, foldable(graph))


def constant_folding(spark: SparkSession, graph: ProgramGraph, max_rounds: int = 100_000) -> ProgramGraph:
    """Simplify and fold until no node changes."""
    for _ in range(max_rounds):
        graph = algebraic_simplification(spark, graph).written(spark)
        found = materialise(spark, foldable(graph))
        if found.isEmpty():
            return graph
        graph = _become_constants(graph, found).written(spark)
    raise NotConverged(f"still folding after {max_rounds} rounds")
