"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Each source has a target of words. Its documents get ``floor(target / size)``
certain whole copies; the rest of the target, R words, is a sample without
replacement, of a fixed size in words, with unequal inclusion odds:

* a document's inclusion probability is p = min(1, k * measure(size)), with the
  square root of the size as measure, so that a document's odds grow with its
  size, but less than in proportion. k is such that the expected words are R:
  sizes so large that p would exceed 1 are certain, and are split off from the
  largest down until what is left of R, shared among the others, makes none
  exceed 1. That is a running sum over a source's distinct sizes;
* every document draws u in (0, 1) from a hash of its id and is ranked by its
  random odds over its inclusion odds, (u / (1 - u)) / (p / (1 - p)). Ranks are
  kept as v = rank / (1 + rank), in 52 bits;
* the sample is the head of that order: a document is taken if more than half of
  it lies within R words, so a source comes within half a document of its target.

The order is never sorted as a whole. Where the words run out is found by a
histogram over v of 2 ** ``LEVEL_BITS`` buckets, refined in the bucket of the
cut until it is one value wide; a document is then judged by its own v. Rows
that repeat an id share u, and if they meet at the cut, as many of them are
taken as fit, told apart by their place in the partitions.

Defined cases: a null text has size 0; a null id draws u from the text; a null
source is a source of its own, last in order; a source of size 0 has target 0; a
document of size 0 is never part of the sample; an empty table gives an empty
result; of docs only doc_id, text and source are looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dagmar.llm.common import WORD, materialise, release, table

V_BITS, LEVEL_BITS = 52, 13
#: Up to so many sources the plan, a row of under 200 bytes for each, is broadcast; beyond that it is joined by shuffle.
BROADCAST_SOURCES = 10_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, text: Column, seed: str = "") -> Column:
    """52 random bits of the id, never 0."""
    key = F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), text, F.lit("")))
    return F.conv(F.substring(F.sha2(key, 256), 1, 13), 16, 10).cast("long").bitwiseOR(F.lit(1))


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source: its size and target.

    ``share`` of all words is dealt out by weight; no target is above ``most``
    times its source's size, and what is cut off goes to the others by weight
    until none is above. That is the water level L with sum(min(cap, weight * L))
    = total, and L is the largest of the levels that result when the sources of
    the smallest cap per weight are full.
    """
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    src = src.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    fill = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    before, after, whole = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing), fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(whole) * F.lit(float(share))
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    src = src.withColumn("_level", level).withColumn("_level", F.max("_level").over(whole))
    return src.select("source", "source_size", "n", F.least("cap", F.col("weight") * F.col("_level")).alias("target"))


def _joined(rows: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    """rows with the plan's columns, whose names begin with an underscore."""
    plan = plan.select(*(F.col(c).alias(f"_{c}") for c in plan.columns))
    return rows.join(F.broadcast(plan) if few else plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def inclusion(sizes: DataFrame, targets: DataFrame, measure: Callable[[Column], Column]) -> DataFrame:
    """targets with copies, left (R), and what gives each document its probability: factor (k), and certain, above which sizes have probability 1."""
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = targets.withColumn("copies", copies).withColumn("left", F.greatest(F.col("target") - F.col("copies") * F.col("source_size"), F.lit(0.0)))
    by_size = sizes.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    down = Window.partitionBy("source").orderBy(F.col("size").desc())
    own = (F.col("n") * F.col("size")).cast("double")
    runs = by_size.select(
        "source", "size",
        F.coalesce(F.sum(own).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("above"),
        F.sum(own * measure(F.col("size"))).over(down.rowsBetween(0, Window.unboundedFollowing)).alias("mass"),
    )
    runs = runs.join(plan.select(F.col("source").alias("_source"), "left"), F.col("source").eqNullSafe(F.col("_source")))
    factor = (F.col("left") - F.col("above")) / F.col("mass")
    least = runs.withColumn("factor", factor).where(F.col("factor") * measure(F.col("size")) <= 1).groupBy("source").agg(F.max_by("factor", "size").alias("factor"), F.max("size").alias("certain"))
    found = least.withColumnRenamed("source", "_source")
    return plan.join(found, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")


def _value(measure: Callable[[Column], Column]) -> Column:
    """v of a row with u and size that is joined with the plan."""
    p = F.when(F.col("size") > F.col("_certain"), F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.col("_factor") * measure(F.col("size"))))
    u = F.col("u") / F.lit(float(1 << V_BITS))
    rank = u * (1 - p)
    return F.floor(rank / (rank + (1 - u) * p) * F.lit(float(1 << V_BITS))).cast("long")


def mix_plan(spark: SparkSession, sizes: DataFrame, measure: Callable[[Column], Column] = F.sqrt, **how) -> tuple[DataFrame, bool]:
    """The decision of every source as one row, and whether there are few enough of them to broadcast.

    cut: the v at which the words run out; quota: how many of the rows of that v are taken, of n.
    """
    plan = materialise(spark, inclusion(sizes, source_targets(sizes, **how).drop("n"), measure))
    few = plan.count() <= BROADCAST_SOURCES
    ranked = _joined(sizes.where("size > 0"), plan.where("left > 0").select("source", "left", "factor", "certain"), few)
    ranked = materialise(spark, ranked.select("source", "size", F.col("_left").alias("left"), _value(measure).alias("v")))
    cut = None
    for shift in range(V_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        rows = ranked.select("source", "size", "left", F.shiftright("v", shift).alias("b"), F.lit(0).cast("long").alias("base"))
        if cut is not None:
            inside = _joined(ranked, cut.select("source", "b", "before"), few).where(F.shiftright("v", shift + LEVEL_BITS) == F.col("_b"))
            rows = inside.select("source", "size", "left", F.shiftright("v", shift).alias("b"), F.col("_before").alias("base"))
        upto = Window.partitionBy("source").orderBy("b")
        buckets = rows.groupBy("source", "b").agg(F.sum("size").alias("words"), F.first("left").alias("left"), F.first("base").alias("base"), F.count("*").alias("n"), F.max("size").alias("size"))
        buckets = buckets.withColumn("upto", F.col("base") + F.sum("words").over(upto)).where(F.col("upto") > F.col("left"))
        found = buckets.groupBy("source").agg(F.min(F.struct("b", (F.col("upto") - F.col("words")).alias("before"), "left", "n", "size")).alias("at")).select("source", "at.*")
        older, cut = cut, materialise(spark, found)
        if older is not None:
            release(older)
    fit = F.floor((F.col("left") - F.col("before")) / F.col("size") + 0.5).cast("long")
    ends = cut.select(F.col("source").alias("_source"), F.col("b").alias("cut"), F.least(fit, F.col("n")).alias("quota"), "n")
    done = materialise(spark, plan.join(ends, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source"))
    release(ranked, cut, plan)
    return done, few


def apply_plan(spark: SparkSession, rows: DataFrame, plan: DataFrame, few: bool, measure: Callable[[Column], Column] = F.sqrt) -> DataFrame:
    """rows (doc_id, source, u, size and any others) with source_size, target, taken and times, the copies taken."""
    kept = [c for c in rows.columns if c not in ("source_size", "target", "taken", "times")]
    joined = _joined(rows.select(*kept), plan, few).withColumn("_v", F.when(F.col("_left") > 0, _value(measure)))
    within = (F.col("size") > 0) & ((F.col("_v") < F.col("_cut")) | F.col("_cut").isNull())
    at_cut = (F.col("size") > 0) & (F.col("_v") == F.col("_cut"))
    extra = F.when(F.col("_left") > 0, within | (at_cut & (F.col("_quota") == F.col("_n"))))
    torn = F.coalesce(at_cut & (F.col("_quota") > 0) & (F.col("_quota") < F.col("_n")), F.lit(False))

    def result(df: DataFrame, taken: Column) -> DataFrame:
        times = F.col("_copies") + F.coalesce(taken, F.lit(False)).cast("long")
        return df.select(*kept, F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("size") * times).alias("taken"), times.alias("times"))

    if plan.where((F.col("quota") > 0) & (F.col("quota") < F.col("n"))).isEmpty():
        return result(joined, extra)
    # rows alike in id and size lie across the cut: they are numbered by partition and place in it
    lump = materialise(spark, joined.where(torn).withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    of = F.struct(F.col("source")).alias("_of")
    counts = lump.groupBy(of, "_part").agg(F.count("*").alias("_rows"))
    before = counts.select("_of", "_part", F.coalesce(F.sum("_rows").over(Window.partitionBy("_of").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    numbered = lump.select("*", of).join(before, ["_of", "_part"]).withColumn("_number", F.col("_base") + F.row_number().over(Window.partitionBy("_of", "_part").orderBy("_at")))
    return result(joined.where(~torn), extra).union(result(numbered, F.col("_number") <= F.col("_quota")))


def sized(docs: DataFrame, *more: Column, seed: str = "") -> DataFrame:
    return docs.select(*more, "doc_id", "source", draw(F.col("doc_id"), F.col("text"), seed).alias("u"), words(F.col("text")).alias("size"))


def pareto_mix(spark: SparkSession, docs: DataFrame, measure: Callable[[Column], Column] = F.sqrt, seed: str = "", **how) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every document."""
    sizes = materialise(spark, sized(docs, seed=seed))
    plan, few = mix_plan(spark, sizes, measure, **how)
    return apply_plan(spark, sizes, plan, few, measure).drop("u", "times")


def mixed(spark: SparkSession, docs: DataFrame, measure: Callable[[Column], Column] = F.sqrt, seed: str = "", **how) -> DataFrame:
    """The rows of docs, each as often as the mix takes it. The plan has one row per source, so no text is shuffled."""
    sizes = materialise(spark, sized(docs, seed=seed))
    plan, few = mix_plan(spark, sizes, measure, **how)
    release(sizes)
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    times = apply_plan(spark, sized(docs, whole, seed=seed), plan, few, measure).where(F.col("times") > 0)
    return times.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy")).select("row.*")


def op3(spark, sf_dir: str) -> DataFrame:
    return pareto_mix(spark, table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(sha256(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 13) AS BIGINT) | 1 AS u
  FROM documents
),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight, source_size * 2.0::DOUBLE AS cap FROM s0),
s2 AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
               - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
               / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM s1),
s3 AS (SELECT *, least(cap, weight * max(lv) OVER ()) AS target FROM s2),
s4 AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM s3),
s AS (SELECT *, greatest(target - copies * source_size, 0) AS left_over FROM s4),
z AS (SELECT source, size, CAST(count(*) * size AS DOUBLE) AS words FROM d WHERE size > 0 GROUP BY source, size),
y AS (SELECT source, size,
             coalesce(sum(words) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above,
             sum(words * sqrt(size)) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS mass FROM z),
x AS (SELECT y.source, max(y.size) AS certain, max_by((s.left_over - y.above) / y.mass, y.size) AS factor
      FROM y JOIN s ON y.source IS NOT DISTINCT FROM s.source WHERE (s.left_over - y.above) / y.mass * sqrt(y.size) <= 1 GROUP BY y.source),
w AS (SELECT d.*, s.source_size, s.target, s.copies, s.left_over, d.u / 4503599627370496.0::DOUBLE AS r,
             CASE WHEN d.size > x.certain THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, x.factor * sqrt(d.size)) END AS p
      FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source LEFT JOIN x ON d.source IS NOT DISTINCT FROM x.source),
v AS (SELECT *, CASE WHEN left_over > 0 AND size > 0 THEN CAST(floor(r * (1 - p) / (r * (1 - p) + (1 - r) * p) * 4503599627370496.0::DOUBLE) AS BIGINT) END AS v FROM w),
t AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY v NULLS LAST, doc_id ROWS UNBOUNDED PRECEDING) - size AS before FROM v)
SELECT doc_id, size, source_size, target,
       CAST(size * (copies + CASE WHEN v IS NOT NULL AND before + size / 2.0::DOUBLE <= left_over THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM t
"""
