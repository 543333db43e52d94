"""Collections with signed multiplicities: payload columns and _diff."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dagmar.operators.rowwise import DIFF


def lift(df: DataFrame, times: int = 1) -> DataFrame:
    """A bag as a Z-set: each row `times` times."""
    return df.withColumn(DIFF, F.lit(times).cast("long"))


def concat(*frames: DataFrame) -> DataFrame:
    """Multiplicities add."""
    return reduce(DataFrame.unionByName, frames)


def concatenate(frames) -> DataFrame:
    return concat(*frames)


def union_distinct(*frames: DataFrame) -> DataFrame:
    return concat(*frames).distinct()


def negate(df: DataFrame) -> DataFrame:
    return df.withColumn(DIFF, -F.col(DIFF))


def consolidate(df: DataFrame) -> DataFrame:
    """Equal rows become one with the sum of their multiplicities; zeros vanish. A bag has nothing to consolidate."""
    if DIFF not in df.columns:
        return df
    cols = [c for c in df.columns if c != DIFF]
    return df.groupBy(*cols).agg(F.sum(DIFF).alias(DIFF)).where(F.col(DIFF) != 0)


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """a minus b: signed for Z-sets, not below zero for bags."""
    return consolidate(concat(a, negate(b))) if DIFF in a.columns else a.exceptAll(b)


def to_bag(df: DataFrame) -> DataFrame:
    """Rows as often as their multiplicity says; a negative one is an error."""
    held = consolidate(df)
    n = F.when(F.col(DIFF) > 0, F.col(DIFF)).otherwise(F.raise_error(F.lit("negative multiplicity")).cast("long"))
    return held.select(*(c for c in df.columns if c != DIFF), F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("_i")).drop("_i")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """What a has more than b (_diff > 0) or less (_diff < 0)."""
    lifted = [df if DIFF in df.columns else lift(df) for df in (a, b)]
    return consolidate(concat(lifted[0], negate(lifted[1])))


def assert_eq(a: DataFrame, b: DataFrame) -> None:
    """Fail unless both hold the same rows equally often."""
    odd = differences(a, b).limit(5).collect()
    if odd:
        raise AssertionError(f"relations differ: {odd}")
