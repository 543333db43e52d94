"""What inlining would cost, and where it would happen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dagmar.functions.scalars import estimated_instructions, function_inline_cost, is_branching, is_pure
from dagmar.sources.program import Program

#: Fixed value: the cost up to which a function counts as trivial.
THRESHOLD = 100.0


def harvest_heuristics(p: Program) -> DataFrame:
    """One row per function: branches, invocations, block_length, ssa_inst_length, function_calls, is_pure, is_recursive, estimated_asm, inline_cost.

    All measures that go by the containing function are one aggregation of
    instructions and one of terminators.
    """
    call = F.col("op") == "Call"
    insts = p.located().groupBy("func_id").agg(
        F.count("*").alias("ssa_inst_length"), F.count_if(call).alias("function_calls"), F.bool_and(is_pure(F.col("op"))).alias("is_pure"),
        F.bool_or(call & F.coalesce(F.col("callee") == F.col("func_id"), F.lit(False))).alias("is_recursive"), F.sum(estimated_instructions(F.col("op"))).alias("_asm"),
    )
    ends = p.function_blocks.join(p.terminators, "block_id", "left").groupBy("func_id").agg(
        F.count("*").alias("block_length"), F.count_if(is_branching(F.col("kind"))).alias("branches"), F.sum(estimated_instructions(F.coalesce("kind", F.lit("Unreachable")))).alias("_ends")
    )
    called = p.instructions.where(call).groupBy(F.col("callee").alias("func_id")).agg(F.count("*").alias("invocations"))
    out = p.functions.select("func_id").join(insts, "func_id", "left").join(ends, "func_id", "left").join(called, "func_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    out = out.select(
        "func_id", *(n(c).alias(c) for c in ("branches", "invocations", "block_length", "ssa_inst_length", "function_calls")),
        F.coalesce("is_pure", F.lit(True)).alias("is_pure"), F.coalesce("is_recursive", F.lit(False)).alias("is_recursive"), (n("_asm") + n("_ends")).alias("estimated_asm"),
    )
    return out.withColumn("inline_cost", function_inline_cost(*(F.col(c) for c in ("estimated_asm", "branches", "function_calls", "is_pure", "is_recursive"))))


def trivially_inlinable(heuristics: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return heuristics.where(F.col("inline_cost") <= threshold)


def call_sites(p: Program, chosen: DataFrame) -> DataFrame:
    """(inst_id, block_id, func_id, callee): calls of chosen functions (func_id) and where they are."""
    wanted = chosen.select(F.col("func_id").alias("callee")).distinct()
    return p.located().where("op = 'Call'").join(wanted, "callee", "left_semi").select("inst_id", "block_id", "func_id", "callee")


def early_inline(p: Program, threshold: float = THRESHOLD) -> DataFrame:
    """The calls that early inlining would take: of functions that are cheap and don't call themselves."""
    return call_sites(p, trivially_inlinable(harvest_heuristics(p), threshold).where("not is_recursive"))
