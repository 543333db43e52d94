"""Text of the block IR, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dagmar.sources.program import Program


def var_text(var: Column) -> Column:
    return F.concat(F.lit("_"), var.cast("string"))


def const_text(const: Column, ty: Column) -> Column:
    return F.when(ty == "bool", F.when(const != 0, "true").otherwise("false")).otherwise(const.cast("string"))


def value_text(var: Column, const: Column, ty: Column) -> Column:
    return F.concat(ty, F.lit(" "), F.coalesce(var_text(var), const_text(const, ty)))


def block_text(block: Column) -> Column:
    return F.concat(F.lit(".bb_"), block.cast("string"))


def function_text(func: Column) -> Column:
    return F.concat(F.lit("@fn_"), func.cast("string"))


def instruction_text() -> Column:
    """Of a row of instructions: dest := op operands."""
    lhs, rhs = (value_text(F.col(f"{s}_var"), F.col(f"{s}_const"), F.col(f"{s}_ty")) for s in ("lhs", "rhs"))
    args = F.array_join(F.transform("args", lambda a: value_text(a["var"], a["const"], a["ty"])), ", ")
    call = F.concat(F.lit("call "), function_text(F.col("callee")), F.lit("("), F.coalesce(args, F.lit("")), F.lit(")"))
    body = (
        F.when(F.col("op") == "Assign", lhs)
        .when(F.col("op") == "Call", call)
        .when(F.col("op") == "Neg", F.concat(F.lit("neg "), lhs))
        .when(F.col("op") == "Bitcast", F.concat(F.lit("bitcast "), lhs, F.lit(" to "), F.col("dest_ty")))
        .otherwise(F.concat_ws(" ", F.lower("op"), F.concat_ws(", ", lhs, rhs)))
    )
    return F.concat(var_text(F.col("dest")), F.lit(" := "), body)


def terminator_text() -> Column:
    cond = F.coalesce(var_text(F.col("cond_var")), F.col("cond_const").cast("string"))
    ret = value_text(F.col("ret_var"), F.col("ret_const"), F.col("ret_ty"))
    return (
        F.when(F.col("kind") == "Jump", F.concat(F.lit("jump "), block_text(F.col("t1"))))
        .when(F.col("kind") == "Branch", F.concat(F.lit("branch "), cond, F.lit(", true: "), block_text(F.col("t1")), F.lit(", false: "), block_text(F.col("t2"))))
        .when(F.col("kind") == "Return", F.concat(F.lit("ret "), F.coalesce(ret, F.lit("unit"))))
        .otherwise(F.lit("unreachable"))
    )


def block_texts(program: Program) -> DataFrame:
    """(func_id, block_id, text) of every block."""
    lines = program.block_instructions.join(program.instructions, "inst_id").select("block_id", "pos", "inst_id", instruction_text().alias("line"))
    body = lines.groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("pos", "inst_id", "line"))).alias("_l"))
    ends = program.terminators.select("block_id", terminator_text().alias("_end"))
    head = F.concat(F.coalesce(F.concat(F.lit("; "), "name", F.lit("\n")), F.lit("")), block_text(F.col("block_id")), F.lit(":"))
    rest = F.concat(F.coalesce(F.transform("_l", lambda x: x["line"]), F.array()), F.array(F.coalesce("_end", F.lit("unreachable"))))
    return (
        program.blocks.join(program.function_blocks, "block_id").join(body, "block_id", "left").join(ends, "block_id", "left")
        .select("func_id", "block_id", F.concat(head, F.lit("\n    "), F.array_join(rest, "\n    ")).alias("text"))
    )


def function_texts(program: Program) -> DataFrame:
    """(func_id, text) of every function, its entry block first."""
    first = block_texts(program).join(program.functions.select("func_id", "entry"), "func_id")
    bodies = first.groupBy("func_id").agg(F.array_sort(F.collect_list(F.struct((F.col("block_id") != F.col("entry")).alias("late"), "block_id", "text"))).alias("_b"))
    params = F.array_join(F.transform("params", lambda p: F.concat(var_text(p["var"]), F.lit(": "), p["ty"])), ", ")
    head = F.concat(
        F.lit("; entry: "), F.coalesce(block_text(F.col("entry")), F.lit("none")), F.lit("\ndef "), F.coalesce(F.concat(F.lit("@"), "name"), function_text(F.col("func_id"))),
        F.lit("("), F.coalesce(params, F.lit("")), F.lit(") "), F.when(F.col("ret_ty") == "unit", "").otherwise(F.concat(F.lit("-> "), "ret_ty", F.lit(" "))), F.lit("{\n"),
    )
    text = F.concat(head, F.coalesce(F.array_join(F.transform("_b", lambda b: b["text"]), "\n\n"), F.lit("")), F.lit("\n}\n"))
    return program.functions.join(bodies, "func_id", "left").select("func_id", text.alias("text"))
