"""Graph algorithms as rounds of joins and aggregates; every round is written, so lineage stays short."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dagmar.plans.lineage import materialise, release, written


class NotConverged(RuntimeError):
    """A fixpoint was not reached within the allowed number of rounds."""


def connected_components(spark: SparkSession, edges: DataFrame, max_rounds: int = 100_000) -> DataFrame:
    """(node, component) for the ends of undirected edges (src, dst); a component is named by its smallest node.

    Each round takes the smallest label among the neighbours and then jumps to
    the label's own label, so that the rounds grow with the logarithm of a
    path's length.
    """
    both = edges.select("src", "dst").where(F.col("src") != F.col("dst"))
    loops = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node")))
    both = written(spark, both.union(both.select("dst", "src")).distinct())
    labels = written(
        spark,
        both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("near"))
        .select("node", F.least("node", "near").alias("component"), F.lit(True).alias("changed")),
    )
    for _ in range(max_rounds):
        if labels.where("changed").isEmpty():
            release(both)
            alone = loops.join(labels, "node", "left_anti").distinct()
            return labels.select("node", "component").union(alone.select("node", F.col("node").alias("component")))
        near = both.join(labels.select(F.col("node").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", F.least("component", "near").alias("to"), F.col("component").alias("was"))
        jump = labels.select(F.col("node").alias("to"), F.col("component").alias("beyond"))
        older, labels = labels, written(
            spark,
            lower.join(jump, "to").select("node", F.least("to", "beyond").alias("component"), "was")
            .select("node", "component", (F.col("component") != F.col("was")).alias("changed")),
        )
        release(older)
    raise NotConverged(f"components still change after {max_rounds} rounds")


def reachable(spark: SparkSession, edges: DataFrame, roots: DataFrame, max_rounds: int = 100_000) -> DataFrame:
    """(node): what can be reached from roots (node) along edges (src, dst), roots included. Cycles are no harm."""
    from dagmar.plans.fixpoint import seminaive

    steps = materialise(spark, edges.select(F.col("src").alias("node"), "dst"))
    out = seminaive(spark, roots.select("node"), lambda new: new.join(steps, "node").select(F.col("dst").alias("node")), max_rounds)
    release(steps)
    return out


def propagate(spark: SparkSession, edges: DataFrame, labels: DataFrame, max_rounds: int = 100_000, unroll: int = 8) -> DataFrame:
    """(node, label): the smallest label that reaches each node along edges, from labels (node, label).

    The order in which labels spread does not show in the result, so there is no
    priority to give.
    """
    steps = materialise(spark, edges.select(F.col("src").alias("node"), F.col("dst")).distinct())

    def spread(now: DataFrame) -> DataFrame:
        # one reference to `now`, so that unrolled plans grow by a step at a time: each edge's source and target get the source's label
        ends = F.explode(F.array("node", F.coalesce("dst", "node"))).alias("_end")
        return now.join(steps, "node", "left").select("label", ends).groupBy(F.col("_end").alias("node")).agg(F.min("label").alias("label"))

    now = materialise(spark, labels.groupBy("node").agg(F.min("label").alias("label")))
    for _ in range(max_rounds):
        new = now
        for _ in range(unroll):
            new = spread(new)
        new = materialise(spark, new)
        lower = new.join(now.withColumnRenamed("label", "was"), "node", "left").where(F.col("was").isNull() | (F.col("label") < F.col("was")))
        settled = lower.isEmpty()
        release(now)
        if settled:
            release(steps)
            return new
        now = new
    raise NotConverged(f"labels still change after {max_rounds} rounds")


def sources_on_targets(spark: SparkSession, edges: DataFrame, max_rounds: int = 100_000, unroll: int = 4) -> DataFrame:
    """Edges whose source is reached from a cycle: keep edges whose source is a kept edge's target, until all are."""
    from dagmar.plans.fixpoint import fixpoint

    return fixpoint(spark, edges.distinct(), lambda e: e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select(*edges.columns), max_rounds, unroll)


def strongly_connected(spark: SparkSession, edges: DataFrame, max_rounds: int = 100_000) -> DataFrame:
    """The edges (src, dst) inside strongly connected components.

    First edges that lie on no path from a cycle to a cycle go. Then labels
    spread forwards and backwards by turns; an edge between different labels
    goes, until none does.
    """
    kept = sources_on_targets(spark, edges.select("src", "dst"))
    kept = sources_on_targets(spark, kept.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    kept = materialise(spark, kept)
    size = kept.count()
    for _ in range(max_rounds):
        for forward in (True, False):
            turned = kept if forward else kept.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
            nodes = turned.select(F.col("src").alias("node")).union(turned.select(F.col("dst").alias("node"))).distinct()
            labels = propagate(spark, turned, nodes.withColumn("label", F.col("node")))
            a, b = (labels.select(F.col("node").alias(end), F.col("label").alias(f"_{end}")) for end in ("src", "dst"))
            kept = materialise(spark, kept.join(a, "src").join(b, "dst").where(F.col("_src") == F.col("_dst")).select("src", "dst"))
        now = kept.count()
        if now == size:
            return kept
        size = now
    raise NotConverged(f"components still split after {max_rounds} rounds")


def union_find(spark: SparkSession, pairs: DataFrame) -> DataFrame:
    """The pairs (src, dst) that join two sets as root pairs: a spanning star of each component, from its smallest member. There are as many as nodes less components, whatever the order of pairs."""
    return connected_components(spark, pairs).where(F.col("node") != F.col("component")).select(F.col("component").alias("root"), F.col("node").alias("joined"))
