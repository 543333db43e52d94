"""Dead code of the graph IR: what no End needs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dagmar.operators.graph import reachable
from dagmar.operators.joins import cull_edges
from dagmar.plans.lineage import materialise
from dagmar.sources.program import ProgramGraph


def remove_places(graph: ProgramGraph) -> ProgramGraph:
    """Places with no neighbouring place are bypassed: (up, place), (place, down) become (up, down)."""
    places = graph.nodes.where("kind = 'Place'").select(F.col("node_id").alias("place")).distinct()
    as_ = lambda end: places.select(F.col("place").alias(end))
    between = graph.value_edges.join(as_("src"), "src", "left_semi").join(as_("dst"), "dst", "left_semi")
    crowded = between.select(F.explode(F.array("src", "dst")).alias("place")).distinct()
    free = places.join(crowded, "place", "left_anti")
    ups = graph.value_edges.select(F.col("src").alias("up"), F.col("dst").alias("place")).join(free, "place", "left_semi")
    downs = graph.value_edges.select(F.col("src").alias("place"), F.col("dst").alias("down")).join(free, "place", "left_semi")
    joined = ups.join(downs, "place").select(F.col("up").alias("src"), F.col("down").alias("dst"))
    bypassed = ups.select("place").distinct().join(downs.select("place").distinct(), "place", "left_semi")
    kept = graph.value_edges
    for end in ("src", "dst"):
        kept = kept.join(bypassed.select(F.col("place").alias(end)), end, "left_anti").select("src", "dst")
    return replace(graph, value_edges=kept.unionByName(joined))


def live_nodes(spark: SparkSession, graph: ProgramGraph) -> DataFrame:
    return reachable(spark, graph.all_edges(), graph.end_node_ids().select(F.col("node_id").alias("node")))


def dce(spark: SparkSession, graph: ProgramGraph) -> ProgramGraph:
    """Bypass places, then keep the nodes that an End leads to and the edges between them."""
    graph = remove_places(graph)
    live = materialise(spark, live_nodes(spark, graph))
    ids = live.select(F.col("node").alias("node_id"))
    return replace(
        graph,
        **{k: cull_edges(getattr(graph, k), live) for k in ("value_edges", "effect_edges", "control_edges")},
        nodes=graph.nodes.join(ids, "node_id", "left_semi").select(*graph.nodes.columns),
        function_nodes=graph.function_nodes.join(ids, "node_id", "left_semi").select(*graph.function_nodes.columns),
    )
