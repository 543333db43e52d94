"""Where rows live: exchanges, and arrangements (rows laid out by key for several readers)."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame


def exchange(df: DataFrame, route: Column, parts: int | None = None) -> DataFrame:
    """Deal out rows by a routing expression."""
    return df.repartition(parts, route) if parts else df.repartition(route)


def arrange_by_key(df: DataFrame, *key: str) -> DataFrame:
    """Rows of a key together and sorted, kept for several readers in memory or on disk. Call unpersist() when done."""
    return df.repartition(*key).sortWithinPartitions(*key).persist(StorageLevel.MEMORY_AND_DISK)


def arrange_by_key_exchange(df: DataFrame, route: Column, *key: str) -> DataFrame:
    return df.repartition(route).sortWithinPartitions(*key).persist(StorageLevel.MEMORY_AND_DISK)


def arrange_by_key_pipelined(df: DataFrame, *key: str) -> DataFrame:
    """Sorted where it is, without a shuffle."""
    return df.sortWithinPartitions(*key)


def arrange_by_self(df: DataFrame) -> DataFrame:
    return arrange_by_key(df, *df.columns)


def arrange_by_self_exchange(df: DataFrame, route: Column) -> DataFrame:
    return arrange_by_key_exchange(df, route, *df.columns)


def arrange_by_self_pipelined(df: DataFrame) -> DataFrame:
    return arrange_by_key_pipelined(df, *df.columns)


def as_collection(arranged: DataFrame) -> DataFrame:
    return arranged
