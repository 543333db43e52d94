"""Nested functions to flat relations, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dagmar.sources.program import Program

INSTRUCTION_FIELDS = ["op", "dest", "dest_ty", "lhs_var", "lhs_const", "lhs_ty", "rhs_var", "rhs_const", "rhs_ty", "callee", "args", "name"]
TERMINATOR_FIELDS = ["kind", "cond_var", "cond_const", "t1", "t2", "ret_var", "ret_const", "ret_ty"]


def translate(nested: DataFrame) -> Program:
    """Explode functions (func_id, name, ret_ty, entry, params, basic_blocks of (block_id, name, instructions, terminator)).

    Instructions that have no id of their own get one from their block and
    place, unique over the whole program.
    """
    blocks = nested.select("func_id", F.explode("basic_blocks").alias("b")).select("func_id", "b.*")
    insts = blocks.select("block_id", F.posexplode("instructions").alias("pos", "i"))
    made = F.col("block_id") * F.lit(1 << 20) + F.col("pos") + 1
    own = F.col("i.inst_id") if "inst_id" in _fields(nested) else F.lit(None).cast("long")
    insts = insts.withColumn("inst_id", F.coalesce(own, made))
    return Program(
        instructions=insts.select("inst_id", *(F.col(f"i.{c}").alias(c) for c in INSTRUCTION_FIELDS)),
        block_instructions=insts.select("inst_id", "block_id", F.col("pos").cast("long").alias("pos")),
        terminators=blocks.select("block_id", *(F.col(f"terminator.{c}").alias(c) for c in TERMINATOR_FIELDS)),
        blocks=blocks.select("block_id", "name"),
        function_blocks=blocks.select("block_id", "func_id"),
        functions=nested.select("func_id", "name", "ret_ty", "entry", "params"),
    )


def _fields(nested: DataFrame) -> set[str]:
    return set(nested.schema["basic_blocks"].dataType.elementType["instructions"].dataType.elementType.names)


def reconstruct(program: Program) -> DataFrame:
    """Flat relations to nested functions; instructions in order, blocks without instructions and functions without blocks kept."""
    held = program.block_instructions.join(program.instructions, "inst_id")
    by_block = held.groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("pos", "inst_id", *INSTRUCTION_FIELDS))).alias("_i"))
    inner = [c for c in ["inst_id", *INSTRUCTION_FIELDS]]
    insts = F.coalesce(F.transform("_i", lambda x: F.struct(*(x[c].alias(c) for c in inner))), F.array())
    blocks = (
        program.blocks.join(program.function_blocks, "block_id").join(by_block, "block_id", "left").join(program.terminators, "block_id", "left")
        .select("func_id", F.struct("block_id", "name", insts.alias("instructions"), F.struct(*TERMINATOR_FIELDS).alias("terminator")).alias("b"))
    )
    # structs with arrays of arrays sort by their first fields, block id before all
    by_function = blocks.groupBy("func_id").agg(F.sort_array(F.collect_list(F.struct(F.col("b.block_id").alias("k"), F.col("b").alias("v")))).alias("_b"))
    return program.functions.join(by_function, "func_id", "left").select("func_id", "name", "ret_ty", "entry", "params", F.coalesce(F.transform("_b", lambda x: x["v"]), F.array()).alias("basic_blocks"))
