"""Graph IR as DOT text, for graphs small enough to be drawn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dagmar.sources.program import ProgramGraph

#: Edge colours and node shapes by kind.
COLOURS = {"control": "black", "effect": "cornflowerblue", "value": "forestgreen"}
CONTROL, OPERATION, STRUCTURE = ("Return", "Branch", "LoopHead", "LoopTail"), ("Mul", "Add", "Sub", "Cmp", "Load", "Store"), ("Start", "End", "Merge")


def node_lines(graph: ProgramGraph) -> DataFrame:
    """(kind_order, line): nodes, and an Error node for each edge end that is missing."""
    label = (
        F.when(F.col("u8").isNotNull(), F.concat(F.lit('label = "'), F.col("u8").cast("string"), F.lit(': u8", shape = circle')))
        .when(F.col("b").isNotNull(), F.concat(F.lit('label = "'), F.col("b").cast("string"), F.lit(': bool", shape = circle')))
        .when(F.col("arr").isNotNull(), F.concat(F.lit('label = "['), F.array_join(F.col("arr").cast("array<string>"), ", "), F.lit(']: array", shape = circle')))
        .when(F.col("kind") == "Parameter", F.concat(F.lit('label = "param: '), F.coalesce("ty", F.lit("?")), F.lit('", shape = doublecircle')))
        .when(F.col("kind") == "Pointer", 'label = "pointer", shape = doublecircle')
        .when(F.col("kind").isin(*CONTROL), F.concat(F.lit('label = "'), "kind", F.lit('", shape = diamond')))
        .when(F.col("kind").isin(*OPERATION), F.concat(F.lit('label = "'), "kind", F.lit('", shape = box')))
        .when(F.col("kind").isin(*STRUCTURE), F.concat(F.lit('label = "'), "kind", F.lit('", shape = box, peripheries = 2')))
        .when(F.col("kind") == "Place", "shape = point")
        .otherwise('label = "Error", shape = diamond')
    )
    ends = graph.all_edges().select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    lost = ends.join(graph.nodes, "node_id", "left_anti").select(F.concat(F.lit("    "), F.col("node_id").cast("string"), F.lit(' [ label = "Error", shape = diamond ]')).alias("line"))
    known = graph.nodes.select(F.concat(F.lit("    "), F.col("node_id").cast("string"), F.lit(" [ "), label, F.lit(" ]")).alias("line"))
    return known.unionByName(lost).select(F.lit(0).alias("part"), "line")


def edge_lines(graph: ProgramGraph) -> DataFrame:
    parts = [getattr(graph, f"{k}_edges").select(F.lit(1).alias("part"), F.format_string(f"    %d -> %d [ color = {c} ]", "src", "dst").alias("line")) for k, c in COLOURS.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def lines(graph: ProgramGraph) -> DataFrame:
    return node_lines(graph).unionByName(edge_lines(graph))


def render(graph: ProgramGraph, most: int = 100_000) -> str:
    """The DOT text, nodes first. It is for people to look at: more lines than `most` are refused."""
    rows = lines(graph).orderBy("part", "line").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} lines: too large to draw; write lines() to files instead")
    return "\n".join(["digraph {", *(r["line"] for r in rows), "}", ""])
