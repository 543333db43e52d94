"""Grouped reductions. All are declarative aggregates with map-side partial sums."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dagmar.operators.rowwise import DIFF

Key = str | Sequence[str]


def _key(key: Key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def weight(df: DataFrame) -> Column:
    return F.sum(DIFF) if DIFF in df.columns else F.count("*")


def count_core(df: DataFrame, key: Key, out: str = "n") -> DataFrame:
    """The multiplicity of each key as data; keys that come to nothing are absent."""
    return df.groupBy(*_key(key)).agg(weight(df).alias(out)).where(F.col(out) != 0)


def sum_by(df: DataFrame, key: Key, value: Column, out: str) -> DataFrame:
    """The sum of a value per key: its count once the value is the multiplicity."""
    return df.groupBy(*_key(key)).agg(F.sum(value * F.col(DIFF) if DIFF in df.columns else value).alias(out))


def distinct(df: DataFrame, *columns: str) -> DataFrame:
    """Every row of non-zero multiplicity once; always over the whole relation."""
    if DIFF in df.columns:
        cols = [c for c in df.columns if c != DIFF]
        return df.groupBy(*cols).agg(F.sum(DIFF).alias(DIFF)).where(F.col(DIFF) != 0).withColumn(DIFF, F.lit(1).cast("long"))
    return df.dropDuplicates(list(columns)) if columns else df.distinct()


def distinct_exchange(df: DataFrame, *route: Column) -> DataFrame:
    """distinct() with rows dealt out by a route first; rows that are equal must agree on it, so the result is the same."""
    return distinct(df.repartition(*route))


def threshold(df: DataFrame, fn: Callable[[Column], Column]) -> DataFrame:
    """A new multiplicity from the old one, as _diff; zero drops the row."""
    cols = [c for c in df.columns if c != DIFF]
    return df.groupBy(*cols).agg(weight(df).alias(DIFF)).withColumn(DIFF, fn(F.col(DIFF)).cast("long")).where(F.col(DIFF) != 0)


def reduce_list(df: DataFrame, key: Key, value: Column, out: str) -> DataFrame:
    """The sorted distinct values of each key."""
    return df.groupBy(*_key(key)).agg(F.array_sort(F.collect_set(value)).alias(out))


def reduce_all(df: DataFrame, key: Key, predicate: Column, out: str) -> DataFrame:
    return df.groupBy(*_key(key)).agg(F.bool_and(predicate).alias(out))


def reduce_min(df: DataFrame, key: Key, value: str, out: str) -> DataFrame:
    return df.groupBy(*_key(key)).agg(F.min(value).alias(out))


def star_edges(df: DataFrame, key: Key, ident: str) -> DataFrame:
    """(least, other) from the smallest id of each group to each of the others."""
    least = df.groupBy(*_key(key)).agg(F.min(ident).alias("least"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return df.join(least, _key(key)).where(F.col(ident) != F.col("least")).select("least", F.col(ident).alias("other")).distinct()


def argmin(df: DataFrame, key: Key, cost: str, ident: str) -> DataFrame:
    """The id of least cost per key, the smallest one of equals."""
    return df.groupBy(*_key(key)).agg(F.min(F.struct(cost, ident)).alias("_b")).select(*_key(key), F.col(f"_b.{ident}").alias(ident), F.col(f"_b.{cost}").alias(cost))


def pivot_sides(df: DataFrame, key: Key, side: str, value: str) -> DataFrame:
    """Rows tagged Left and Right become the two operands of one row."""
    return df.groupBy(*_key(key)).agg(F.min(F.when(F.col(side) == "Left", F.col(value))).alias("lhs"), F.min(F.when(F.col(side) == "Right", F.col(value))).alias("rhs"))


def all_equal(df: DataFrame, key: Key, value: str, times: int = 2) -> DataFrame:
    """Keys that have one distinct value, `times` times."""
    return df.groupBy(*_key(key)).agg(F.min(value).alias(value), F.max(value).alias("_max"), weight(df).alias("_n")).where((F.col(value) == F.col("_max")) & (F.col("_n") == times)).select(*_key(key), value)


def max_diff(df: DataFrame, key: Key, value: str) -> DataFrame:
    """Consolidation under max: + is max."""
    return df.groupBy(*_key(key)).agg(F.max(value).alias(value))


def min_diff(df: DataFrame, key: Key, value: str) -> DataFrame:
    """Consolidation under min: + is min."""
    return df.groupBy(*_key(key)).agg(F.min(value).alias(value))


def _plus_join(left: DataFrame, right: DataFrame, key: Key, out: Sequence[str], value: str, agg) -> DataFrame:
    # several ways into or out of a hub are one before they meet
    best = lambda df: df.groupBy(*dict.fromkeys([*_key(key), *(c for c in out if c in df.columns)])).agg(agg(F.col(value)).alias(value))
    left, other = best(left), best(right).withColumnRenamed(value, "_w")
    return left.join(other, _key(key)).groupBy(*out).agg(agg(F.col(value) + F.col("_w")).alias(value))


def minplus_join(left: DataFrame, right: DataFrame, key: Key, out: Sequence[str], value: str) -> DataFrame:
    """Join in the (min, +) semiring: weights of a match add, equal results keep the least."""
    return _plus_join(left, right, key, out, value, F.min)


def maxplus_join(left: DataFrame, right: DataFrame, key: Key, out: Sequence[str], value: str) -> DataFrame:
    """Join in the (max, +) semiring."""
    return _plus_join(left, right, key, out, value, F.max)


def scale_extremum(df: DataFrame, value: str, times: Column) -> DataFrame:
    """Multiply an extremum by a plain multiplicity: rows of a multiplicity below 1 vanish."""
    return df.where(times >= 1)
