"""Equi-joins and what is built of them.

Bag joins multiply the numbers of equal rows; Z-set joins multiply _diff. Which
physical join runs is Catalyst's and AQE's choice; nothing here forces a
broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dagmar.operators.rowwise import DIFF

Key = str | Sequence[str]


def _key(key: Key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def join(left: DataFrame, right: DataFrame, key: Key) -> DataFrame:
    """(K, V1) and (K, V2) to (K, V1, V2)."""
    if DIFF in left.columns and DIFF in right.columns:
        return left.join(right.withColumnRenamed(DIFF, "_diff_r"), _key(key)).withColumn(DIFF, F.col(DIFF) * F.col("_diff_r")).drop("_diff_r")
    return left.join(right, _key(key))


def join_map(left: DataFrame, right: DataFrame, key: Key, **columns: Column) -> DataFrame:
    joined = join(left, right, key)
    return joined.select(*(c.alias(k) for k, c in columns.items()), *([DIFF] if DIFF in joined.columns else []))


def join_core(left: DataFrame, right: DataFrame, key: Key, residual: Column, columns: Mapping[str, Column]) -> DataFrame:
    """Join with a condition beyond the key and a projection: no row or one for each match."""
    return join(left, right, key).where(residual).select(*(c.alias(k) for k, c in columns.items()))


def semijoin(df: DataFrame, others: DataFrame, key: Key, product: bool = False) -> DataFrame:
    """Rows whose key is among the others' keys; with product, once for each time it is there."""
    wanted = others.select(*_key(key))
    return df.join(wanted, _key(key)) if product else df.join(wanted, _key(key), "left_semi").select(*df.columns)


def antijoin(df: DataFrame, others: DataFrame, key: Key) -> DataFrame:
    """Rows whose key is not among the others' keys."""
    return df.join(others.select(*_key(key)), _key(key), "left_anti").select(*df.columns)


def upsert(base: DataFrame, changes: DataFrame, key: Key) -> DataFrame:
    """Rows of changes in place of those of base with the same key."""
    return antijoin(base, changes, key).unionByName(changes.select(*base.columns))


def default_fill(everything: DataFrame, found: DataFrame, key: Key, **defaults) -> DataFrame:
    """One row per key of everything, with defaults where found has none."""
    return everything.select(*_key(key)).join(found, _key(key), "left").fillna(defaults)


def selfjoin_pairs(df: DataFrame, group: Key, ident: str, value: str | None = None) -> DataFrame:
    """Ordered pairs of different ids in a group, with equal values if a value is named. The output is quadratic in a group: where one representative will do, use duplicates()."""
    on = [*_key(group), *([value] if value else [])]
    other = df.select(*on, F.col(ident).alias("other"))
    return df.select(*on, F.col(ident)).join(other, on).where(F.col(ident) != F.col("other")).select(*on, ident, "other")


def duplicates(df: DataFrame, group: Key, ident: str) -> DataFrame:
    """(ident, keep) for every row that is not the smallest of its group: linear in the group."""
    least = df.groupBy(*_key(group)).agg(F.min(ident).alias("keep"))
    return df.join(least, _key(group)).where(F.col(ident) != F.col("keep")).select(ident, "keep")


def cull_edges(edges: DataFrame, nodes: DataFrame, node: str = "node") -> DataFrame:
    """Edges with both ends among nodes."""
    alive = nodes.select(F.col(node).alias("src")).distinct()
    return edges.join(alive, "src", "left_semi").join(alive.withColumnRenamed("src", "dst"), "dst", "left_semi").select(*edges.columns)


def delta_cull_edges(edges: DataFrame, d_edges: DataFrame, nodes: DataFrame, d_nodes: DataFrame) -> DataFrame:
    """The change of cull_edges(edges, nodes) when d_edges and d_nodes (signed, _diff) come in.

    One rule per input, each against the old state of the inputs before it and
    the new state of those after it, so that no change counts twice:
    dE(a,b) R'(a) R'(b), then E(a,b) dR(a) R'(b), then E(a,b) R(a) dR(b).
    """
    new = nodes.unionByName(d_nodes)
    at = lambda df, end: df.select(F.col("node").alias(end), F.col(DIFF).alias(f"_{end}"))
    rules = [(d_edges, new, new), (edges, d_nodes, new), (edges, nodes, d_nodes)]
    parts = [e.join(at(a, "src"), "src").join(at(b, "dst"), "dst").select("src", "dst", (F.col(DIFF) * F.col("_src") * F.col("_dst")).alias(DIFF)) for e, a, b in rules]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.groupBy("src", "dst").agg(F.sum(DIFF).alias(DIFF)).where(F.col(DIFF) != 0)


def differentiate(now: DataFrame, before: DataFrame) -> DataFrame:
    """The signed change from one state to the next."""
    cols = now.columns
    signed = now.withColumn(DIFF, F.lit(1)).unionByName(before.withColumn(DIFF, F.lit(-1)))
    return signed.groupBy(*cols).agg(F.sum(DIFF).alias(DIFF)).where(F.col(DIFF) != 0)


def integrate(spark: SparkSession, changes: Sequence[DataFrame]) -> DataFrame:
    """The state that changes add up to, as a Z-set."""
    total = changes[0]
    for c in changes[1:]:
        total = total.unionByName(c)
    cols = [c for c in total.columns if c != DIFF]
    return total.groupBy(*cols).agg(F.sum(DIFF).alias(DIFF)).where(F.col(DIFF) != 0)
