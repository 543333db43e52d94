"""Dropping what a program does not need, and merging blocks."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dagmar.operators.graph import reachable
from dagmar.plans.fixpoint import fixpoint, seminaive
from dagmar.plans.ir.collect import collect_usages
from dagmar.plans.lineage import by_shuffles, materialise, release
from dagmar.sources.program import Program


def live_instructions(spark: SparkSession, p: Program) -> DataFrame:
    """(inst_id): calls, what returns and branches use, and what those use in turn."""
    declared = p.instructions.select(F.col("dest").alias("var"), "inst_id")
    asked = p.terminators.select(F.explode(F.array("ret_var", "cond_var")).alias("var")).where("var is not null")
    roots = declared.join(asked.distinct(), "var", "left_semi").select("inst_id").unionByName(p.instructions.where("op = 'Call'").select("inst_id"))
    needs = collect_usages(p.instructions).select("inst_id", "var").join(declared.withColumnRenamed("inst_id", "needed"), "var").select("inst_id", "needed").distinct()
    needs = materialise(spark, needs)
    out = seminaive(spark, roots, lambda new: new.join(needs, "inst_id").select(F.col("needed").alias("inst_id")))
    release(needs)
    return out


def reachable_blocks(spark: SparkSession, p: Program) -> DataFrame:
    """(block_id): blocks that jumps lead to from a function's entry."""
    entries = p.functions.where("entry is not null").select(F.col("entry").alias("node"))
    return reachable(spark, p.jump_edges(), entries).select(F.col("node").alias("block_id"))


def _restrict(p: Program, insts: DataFrame | None = None, blocks: DataFrame | None = None) -> Program:
    block_instructions = p.block_instructions
    if insts is not None:
        block_instructions = block_instructions.join(insts, "inst_id", "left_semi").select(*p.block_instructions.columns)
    if blocks is not None:
        block_instructions = block_instructions.join(blocks, "block_id", "left_semi").select(*p.block_instructions.columns)
        p = replace(p, **{k: getattr(p, k).join(blocks, "block_id", "left_semi").select(*getattr(p, k).columns) for k in ("terminators", "blocks", "function_blocks")})
    return replace(p, instructions=p.instructions.join(by_shuffles(block_instructions.select("inst_id")), "inst_id", "left_semi").select(*p.instructions.columns), block_instructions=block_instructions)


def cull_unreachable_blocks(spark: SparkSession, p: Program) -> Program:
    return _restrict(p, blocks=materialise(spark, reachable_blocks(spark, p).join(p.blocks.select("block_id"), "block_id", "left_semi")))


def required_functions(spark: SparkSession, p: Program) -> DataFrame:
    """(func_id): functions with blocks, and those they call."""
    calls = p.located().where("op = 'Call'").select(F.col("func_id").alias("src"), F.col("callee").alias("dst")).distinct()
    return reachable(spark, calls, p.function_blocks.select(F.col("func_id").alias("node"))).select(F.col("node").alias("func_id"))


def cleanup(spark: SparkSession, p: Program) -> Program:
    """Keep live instructions, reachable blocks, and functions that have blocks or are called."""
    p = _restrict(p, materialise(spark, live_instructions(spark, p)), materialise(spark, reachable_blocks(spark, p).join(p.blocks.select("block_id"), "block_id", "left_semi")))
    return replace(p, functions=p.functions.join(materialise(spark, required_functions(spark, p)), "func_id", "left_semi").select(*p.functions.columns))


def merge_targets(spark: SparkSession, p: Program) -> DataFrame:
    """(block_id, last, steps): blocks that merge into another, with the chain's last block and how many jumps lead there.

    A block merges into its target if it ends in a jump and the target has no
    other way in, is in the same function and is no entry. A chain that closes
    on itself is left alone.
    """
    of = p.function_blocks
    edges = p.jump_edges()
    lone = edges.groupBy("dst").agg(F.count("*").alias("_n")).where("_n = 1").select("dst")
    entries = p.functions.where("entry is not null").select(F.col("entry").alias("dst"))
    links = (
        p.terminators.where("kind = 'Jump' and t1 <> block_id").select("block_id", F.col("t1").alias("dst"))
        .join(lone, "dst", "left_semi").join(entries, "dst", "left_anti")
        .join(of, "block_id").join(of.select(F.col("block_id").alias("dst"), F.col("func_id").alias("_f")), "dst").where("func_id = _f")
        .select("block_id", F.col("dst").alias("last"), F.lit(1).cast("long").alias("steps"))
    )

    def halve(df: DataFrame) -> DataFrame:
        beyond = df.select(F.col("block_id").alias("last"), F.col("last").alias("_next"), F.col("steps").alias("_more"))
        return df.join(beyond, "last", "left").select("block_id", F.coalesce("_next", "last").alias("last"), (F.col("steps") + F.coalesce("_more", F.lit(0))).alias("steps")).where("block_id <> last")

    found = fixpoint(spark, links, halve)
    return found.join(found.select(F.col("block_id").alias("last")), "last", "left_anti").select("block_id", "last", "steps")


def compact_basic_blocks(spark: SparkSession, p: Program) -> Program:
    """Merge chains of blocks into their last block; instructions keep their order, and the chain's first block's place as entry goes to the last."""
    chains = materialise(spark, merge_targets(spark, p))
    place = p.block_instructions.join(chains, "block_id", "left")
    order = F.row_number().over(_window())
    moved = place.select("inst_id", F.coalesce("last", "block_id").alias("block_id"), F.coalesce("steps", F.lit(0)).alias("_steps"), "pos").withColumn("pos", (order - 1).cast("long"))
    into = chains.select(F.col("block_id").alias("_old"), F.col("last").alias("_new"))

    def through(df: DataFrame, column: str) -> DataFrame:
        return df.join(into, F.col(column) == F.col("_old"), "left").withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")

    gone = chains.select("block_id")
    ends = through(through(p.terminators.join(gone, "block_id", "left_anti"), "t1"), "t2")
    return replace(
        p,
        block_instructions=moved.select(*p.block_instructions.columns),
        terminators=ends.select(*p.terminators.columns),
        blocks=p.blocks.join(gone, "block_id", "left_anti").select(*p.blocks.columns),
        function_blocks=p.function_blocks.join(gone, "block_id", "left_anti").select(*p.function_blocks.columns),
        functions=through(p.functions, "entry").select(*p.functions.columns),
    )


def _window():
    from pyspark.sql import Window

    return Window.partitionBy("block_id").orderBy(F.col("_steps").desc(), "pos", "inst_id")
