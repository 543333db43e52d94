"""One input, several outputs. Outputs are plans over the same input: persist it if it is costly."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split(df: DataFrame, left: Mapping[str, Column], right: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Every row goes to both outputs, projected for each."""
    return tuple(df.select(*(c.alias(k) for k, c in side.items())) for side in (left, right))


def filter_split(df: DataFrame, left: tuple[Column, Mapping[str, Column]], right: tuple[Column, Mapping[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Independent optional outputs: a row may go to both, one or neither."""
    return tuple(df.where(p).select(*(c.alias(k) for k, c in side.items())) for p, side in (left, right))


def flat_split(df: DataFrame, left: Column, right: Column, out: str = "item", keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Any number of items to either side, from an array each."""
    return tuple(df.select(*keep, F.explode(side).alias(out)) for side in (left, right))


def split_by(df: DataFrame, *parts: Mapping[str, Column]) -> tuple[DataFrame, ...]:
    """Unzip rows into as many relations as there are projections, up to 26."""
    if not 1 <= len(parts) <= 26:
        raise ValueError("split_by makes 1 to 26 relations")
    return tuple(df.select(*(c.alias(k) for k, c in part.items())) for part in parts)


def partition(df: DataFrame, parts: int, route: Column) -> list[DataFrame]:
    """Each row goes to exactly one of `parts` outputs; a route out of range fails the job."""
    if parts < 1:
        raise ValueError("at least one part")
    checked = F.when(route.between(0, parts - 1), route).otherwise(F.raise_error(F.concat(F.lit("route out of range: "), F.coalesce(route.cast("string"), F.lit("null")))).cast("int"))
    routed = df.withColumn("_part", checked)
    return [routed.where(F.col("_part") == i).drop("_part") for i in range(parts)]


def partition_array(df: DataFrame, parts: int, route: Column) -> tuple[DataFrame, ...]:
    """partition() as a tuple of fixed length."""
    return tuple(partition(df, parts, route))


def constness(lhs_const: Column, rhs_const: Column) -> Column:
    """Which operands are constants: 0 neither, 1 left, 2 right, 3 both."""
    return lhs_const.isNotNull().cast("int") + rhs_const.isNotNull().cast("int") * 2


def branch_when(df: DataFrame, time: Column, limit: int) -> tuple[DataFrame, DataFrame]:
    """Rows from before a time, and from it on."""
    return df.where(time < limit), df.where(time >= limit)
