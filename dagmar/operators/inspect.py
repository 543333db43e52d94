"""Looking at relations without changing them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: As in a release build, taps do nothing unless this is set.
DEBUG = bool(os.environ.get("DAGMAR_DEBUG"))


def debug_inspect(df: DataFrame, fn: Callable[[DataFrame], None], on: bool | None = None) -> DataFrame:
    """Call fn on a bounded sample of rows when debugging."""
    if DEBUG if on is None else on:
        fn(df.limit(100))
    return df


def debug(df: DataFrame, name: str = "", on: bool | None = None) -> DataFrame:
    return debug_inspect(df, lambda d: print(name, *d.collect(), sep="\n"), on)


def inspect(df: DataFrame, **metrics: Column) -> tuple[DataFrame, Observation]:
    """Metrics of all rows that pass, gathered while another action runs."""
    seen = Observation()
    return df.observe(seen, *(m.alias(k) for k, m in (metrics or {"rows": F.count(F.lit(1))}).items())), seen


def inspect_aggregate(df: DataFrame, time: str, fn: Callable[[object, list], None], on: bool | None = None, most: int = 10_000) -> DataFrame:
    """Call fn(time, rows) with each time's consolidated rows in order of time, of at most `most` rows in all, when debugging."""
    if DEBUG if on is None else on:
        cols = [c for c in df.columns if c != time]
        rows = df.limit(most).groupBy(time).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("rows")).orderBy(time).collect()
        for r in rows:
            fn(r[time], r["rows"])
    return df


def diff_report(before: DataFrame, after: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of keys that went, and of keys that came."""
    return before.join(after.select(key), key, "left_anti"), after.join(before.select(key), key, "left_anti")
