"""Projections, filters and flat-maps. None of them shuffles; expressions stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIFF = "_diff"


def map_named(name: str, df: DataFrame, **columns: Column) -> DataFrame:
    """A projection whose jobs show `name` in the plan as the alias of the relation."""
    return df.select(*(c.alias(k) for k, c in columns.items()), *([DIFF] if DIFF in df.columns and DIFF not in columns else [])).alias(name)


def map_in_place(df: DataFrame, **columns: Column) -> DataFrame:
    """Replace columns, all of them computed from the row as it was (so that a swap works)."""
    return df.select(*(columns[c].alias(c) if c in columns else F.col(c) for c in df.columns), *(v.alias(k) for k, v in columns.items() if k not in df.columns))


def keys(df: DataFrame, *key: str) -> DataFrame:
    """The key columns with all their repetitions."""
    return df.select(*key)


def reverse(df: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """Exchange the contents of two columns."""
    return map_in_place(df, **{a: F.col(b), b: F.col(a)})


def filter_rows(df: DataFrame, predicate: Column) -> DataFrame:
    return df.where(predicate)


def filter_map(df: DataFrame, predicate: Column, **columns: Column) -> DataFrame:
    """Keep rows of a predicate and project them; the predicate decides, so a null payload survives."""
    return df.where(predicate).select(*(c.alias(k) for k, c in columns.items()))


def filter_diff(df: DataFrame, predicate: Callable[[Column], Column]) -> DataFrame:
    """Filter on multiplicity: on _diff where there is one, else on the number of equal rows, which stay as often as they were."""
    if DIFF in df.columns:
        return df.where(predicate(F.col(DIFF)))
    counted = df.groupBy(*df.columns).agg(F.count("*").alias("_n")).where(predicate(F.col("_n")))
    return counted.select(*df.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_i")).drop("_i")


def flat_map(df: DataFrame, out: str, items: Iterable[Column] | Column, keep: Iterable[str] = ()) -> DataFrame:
    """One row per item: of an array column, or of a list of columns."""
    array = items if isinstance(items, Column) else F.array(*items)
    return df.select(*keep, F.explode(array).alias(out))


def flatten(df: DataFrame, column: str) -> DataFrame:
    """One row per element in place of the array; empty and null arrays vanish."""
    return df.select(*(F.explode(c).alias(c) if c == column else F.col(c) for c in df.columns))


class AppendBuffer(list):
    """An output buffer that grows at its end only."""

    def push(self, row) -> None:
        super().append(row)

    def __delitem__(self, _):
        raise TypeError("rows can only be appended")

    pop = remove = clear = __setitem__ = insert = __delitem__


def buffered_flat_map(df: DataFrame, fn: Callable[[dict, AppendBuffer], None], schema: str, batch: int = 4096) -> DataFrame:
    """Arbitrary one-to-many logic over Arrow batches: fn pushes output tuples for each row; output leaves in bounded batches."""
    from pyspark.sql.types import _parse_datatype_string

    names = _parse_datatype_string(schema).names if " " in schema else [schema]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buffer = AppendBuffer()
        for frame in frames:
            for row in frame.to_dict("records"):
                fn(row, buffer)
                if len(buffer) >= batch:
                    yield pd.DataFrame(list(buffer), columns=names)
                    buffer = AppendBuffer()
        if buffer:
            yield pd.DataFrame(list(buffer), columns=names)

    return df.mapInPandas(run, schema)


def collect_castable(df: DataFrame, variant: str, *fields: str, tag: str = "op") -> DataFrame:
    """The rows of one variant of a tagged union, with that variant's fields."""
    return df.where(F.col(tag) == variant).select(*fields)


def explode_weighted(df: DataFrame, weight: Column, *payload: str) -> DataFrame:
    """Move a value into the multiplicity; consolidating the result sums it."""
    old = F.col(DIFF) if DIFF in df.columns else F.lit(1)
    return df.select(*payload, (weight * old).alias(DIFF))
