"""Minting ids for distinct records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dagmar.plans.lineage import materialise


def hash_identifier(columns: list[str], round_: int) -> Column:
    """The default strategy: a 64-bit hash of the record, and of the round it is minted in."""
    return F.xxhash64(*columns, F.lit(round_))


def discriminated_idents(spark: SparkSession, df: DataFrame, discriminant: int, identify: Callable[[list[str], int], Column] = hash_identifier, max_rounds: int = 16) -> DataFrame:
    """Distinct records with ident (discriminant, hash), unique among them.

    Of records that share a hash, the smallest keeps it; the others take the
    hash of the next round, as long as there are any.
    """
    cols = df.columns
    todo, done = materialise(spark, df.distinct()), None
    for round_ in range(max_rounds):
        tried = todo.select(*cols, identify(cols, round_).alias("_hash"))
        if done is not None:
            taken = done.select(F.col("_hash"))
            clash = tried.join(taken, "_hash", "left_semi")
            tried = tried.join(taken, "_hash", "left_anti")
        owner = tried.groupBy("_hash").agg(F.min(F.struct(*cols)).alias("_owner"))
        marked = materialise(spark, tried.join(owner, "_hash").withColumn("_won", F.struct(*cols).eqNullSafe(F.col("_owner"))).drop("_owner"))
        won = marked.where("_won").select(*cols, "_hash")
        lost = marked.where("not _won").select(*cols)
        if done is not None:
            lost = lost.unionByName(clash.select(*cols))
        done = won if done is None else done.unionByName(won)
        todo = materialise(spark, lost)
        if todo.isEmpty():
            return done.select(*cols, F.struct(F.lit(discriminant).cast("short").alias("discriminant"), F.col("_hash").alias("hash")).alias("ident"))
    raise RuntimeError(f"hashes still collide after {max_rounds} rounds")


def show_ident(ident: Column) -> Column:
    """0x, the discriminant in two hex digits, the hash in eight at least."""
    digits = F.hex(ident["hash"])
    return F.concat(F.lit("0x"), F.lpad(F.hex(ident["discriminant"].cast("int")), 2, "0"), F.when(F.length(digits) < 8, F.lpad(digits, 8, "0")).otherwise(digits))
