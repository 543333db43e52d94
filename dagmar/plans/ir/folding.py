"""Constant folding and propagation over the block IR.

Each step is one pass of left joins against the relation of known constants.
constant_folding() first finds all constants, looking in each round at the
narrow relation of what is not decided yet and at the round's new constants
only, and then rewrites the program once.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dagmar.functions.scalars import BINOPS, NUMBER, evaluate
from dagmar.operators.graph import NotConverged
from dagmar.plans.fixpoint import ROUNDS, fixpoint
from dagmar.plans.ir.collect import single_declarations
from dagmar.plans.lineage import by_shuffles, materialise, release
from dagmar.sources.program import Program


def constants(instructions: DataFrame) -> DataFrame:
    """(var, value, ty) of variables that are one known constant."""
    known = instructions.where((F.col("op") == "Assign") & F.col("lhs_const").isNotNull()).select(F.col("dest").alias("var"), F.col("lhs_const").alias("value"), F.col("lhs_ty").alias("ty"))
    return by_shuffles(known.join(by_shuffles(single_declarations(instructions)), "var", "left_semi"))


def _with_known(df: DataFrame, known: DataFrame, *sides: str) -> DataFrame:
    """Columns _<side> and _<side>_ty: the constant of each side, literal or looked up."""
    for s in sides:
        found = known.select(F.col("var").alias(f"{s}_var"), F.col("value").alias(f"_{s}_v"), F.col("ty").alias(f"_{s}_t"))
        df = df.join(found, f"{s}_var", "left")
        df = df.withColumn(f"_{s}", F.coalesce(f"{s}_const", f"_{s}_v")).withColumn(f"_{s}_type", F.when(F.col(f"{s}_const").isNotNull(), F.col(f"{s}_ty")).otherwise(F.col(f"_{s}_t"))).drop(f"_{s}_v", f"_{s}_t")
    return df


def evaluate_binary_ops(instructions: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Binary operations on known constants become assignments of the result; what has no result stays."""
    cols = instructions.columns
    rows = _with_known(instructions, constants(instructions) if known is None else known, "lhs", "rhs")
    value = F.when(F.col("op").isin(*BINOPS), evaluate(F.col("op"), F.col("_lhs"), F.col("_rhs"), F.col("_lhs_type"), F.col("_rhs_type")))
    rows = rows.withColumn("_value", value)
    fold = F.col("_value").isNotNull()
    new = {"op": F.lit("Assign"), "lhs_var": F.lit(None).cast("long"), "lhs_const": F.col("_value"), "lhs_ty": F.col("_lhs_type"), "rhs_var": F.lit(None).cast("long"), "rhs_const": F.lit(None).cast(NUMBER), "rhs_ty": F.lit(None).cast("string")}
    return rows.select(*(F.when(fold, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in cols))


def promote_constants(instructions: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Known variables among operands and arguments become literals."""
    cols, known = instructions.columns, constants(instructions) if known is None else known
    rows = _with_known(instructions, known, "lhs", "rhs")
    for s in ("lhs", "rhs"):
        hit = F.col(f"{s}_var").isNotNull() & F.col(f"_{s}").isNotNull()
        rows = rows.withColumn(f"{s}_ty", F.when(hit, F.col(f"_{s}_type")).otherwise(F.col(f"{s}_ty"))).withColumn(f"{s}_const", F.coalesce(f"{s}_const", f"_{s}")).withColumn(f"{s}_var", F.when(~hit, F.col(f"{s}_var")))
    given = instructions.select("inst_id", F.posexplode("args").alias("i", "a"))
    given = given.join(known.select(F.col("var").alias("_var"), "value", F.col("ty").alias("_ty")), F.col("a.var") == F.col("_var"), "left")
    hit = F.col("value").isNotNull()
    arg = F.struct(F.when(~hit, F.col("a.var")).alias("var"), F.coalesce("value", "a.const").cast(NUMBER).alias("const"), F.coalesce("_ty", "a.ty").alias("ty"))
    args = given.groupBy("inst_id").agg(F.array_sort(F.collect_list(F.struct("i", arg.alias("a")))).alias("_args"))
    rows = rows.join(args, "inst_id", "left").withColumn("args", F.when(F.col("_args").isNotNull(), F.transform("_args", lambda x: x["a"])).otherwise(F.col("args")))
    return rows.select(*cols)


def fold_terminators(terminators: DataFrame, instructions: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Returns of known variables return literals; branches on known conditions, or with one target, become jumps."""
    cols, known = terminators.columns, constants(instructions) if known is None else known
    rows = _with_known(terminators, known, "ret")
    conds = known.where("ty = 'bool'").select(F.col("var").alias("cond_var"), (F.col("value") != 0).alias("_cond"))
    rows = rows.join(conds, "cond_var", "left").withColumn("_cond", F.coalesce("cond_const", "_cond"))
    hit = F.col("ret_var").isNotNull() & F.col("_ret").isNotNull()
    rows = rows.withColumn("ret_ty", F.when(hit, F.col("_ret_type")).otherwise(F.col("ret_ty"))).withColumn("ret_const", F.coalesce("ret_const", "_ret")).withColumn("ret_var", F.when(~hit, F.col("ret_var")))
    target = F.when(F.col("kind") == "Branch", F.when(F.col("t1") == F.col("t2"), F.col("t1")).when(F.col("_cond"), F.col("t1")).when(~F.col("_cond"), F.col("t2")))
    rows = rows.withColumn("_to", target)
    jump = F.col("_to").isNotNull()
    new = {"kind": F.lit("Jump"), "t1": F.col("_to"), "t2": F.lit(None).cast("long"), "cond_var": F.lit(None).cast("long"), "cond_const": F.lit(None).cast("boolean")}
    return rows.select(*(F.when(jump, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in cols))


def copy_roots(spark: SparkSession, instructions: DataFrame) -> DataFrame:
    """(var, root): variables that are copies, with the end of their chain of copies. Chains are halved each round; a chain that closes on itself has no root."""
    once = single_declarations(instructions)
    copies = instructions.where((F.col("op") == "Assign") & F.col("lhs_var").isNotNull()).select(F.col("dest").alias("var"), F.col("lhs_var").alias("root")).where("var <> root").join(by_shuffles(once), "var", "left_semi")

    def halve(df: DataFrame) -> DataFrame:
        beyond = df.select(F.col("var").alias("root"), F.col("root").alias("_next"))
        return df.join(beyond, "root", "left").select("var", F.coalesce("_next", "root").alias("root")).where("var <> root")

    found = fixpoint(spark, copies, halve)
    return materialise(spark, found.join(found.select(F.col("var").alias("root")), "root", "left_anti").select("var", "root"))


def eliminate_copies(spark: SparkSession, program: Program) -> Program:
    """Drop copies of variables and use their roots instead, in instructions and terminators."""
    roots = copy_roots(spark, program.instructions)

    def through(df: DataFrame, column: str) -> DataFrame:
        to = roots.select(F.col("var").alias(column), F.col("root").alias("_root"))
        return df.join(to, column, "left").withColumn(column, F.coalesce("_root", column)).drop("_root")

    kept = program.instructions.join(roots.select(F.col("var").alias("dest")), "dest", "left_anti")
    cols = program.instructions.columns
    rows = through(through(kept, "lhs_var"), "rhs_var")
    given = kept.select("inst_id", F.posexplode("args").alias("i", "a")).select("inst_id", "i", "a.*")
    given = through(given, "var").groupBy("inst_id").agg(F.array_sort(F.collect_list(F.struct("i", F.struct("var", "const", "ty").alias("a")))).alias("_args"))
    rows = rows.join(given, "inst_id", "left").withColumn("args", F.when(F.col("_args").isNotNull(), F.transform("_args", lambda x: x["a"])).otherwise(F.col("args")))
    ends = through(through(program.terminators, "cond_var"), "ret_var")
    return replace(
        program,
        instructions=rows.select(*cols),
        terminators=ends.select(*program.terminators.columns),
        block_instructions=program.block_instructions.join(by_shuffles(rows.select("inst_id")), "inst_id", "left_semi").select(*program.block_instructions.columns),
    )


def constant_folding_round(program: Program) -> Program:
    insts = promote_constants(evaluate_binary_ops(program.instructions))
    return replace(program, instructions=insts, terminators=fold_terminators(program.terminators, insts))


def all_constants(spark: SparkSession, instructions: DataFrame, max_rounds: int = ROUNDS) -> DataFrame:
    """(var, value, ty) of all variables that folding finds to be one known constant.

    What is not decided are the single declarations by a copy or a binary
    operation. A round puts its new constants in for their operands, evaluates
    what is then complete, and goes on with the rest; complete ones without a
    result (overflow, types that differ) are decided, too.
    """
    single = instructions.join(by_shuffles(single_declarations(instructions)), instructions["dest"] == F.col("var"), "left_semi")
    copy = F.col("op") == "Assign"
    derived = single.where(F.col("op").isin(*BINOPS) | (copy & F.col("lhs_var").isNotNull()))
    columns = ["dest", "op", "lhs_var", "lhs_const", "lhs_ty", "rhs_var", "rhs_const", "rhs_ty"]
    new = materialise(spark, constants(instructions))
    found, parts, rest = new, [new], derived.select(*columns)
    for _ in range(max_rounds):
        for side in ("lhs", "rhs"):
            with_it = new.select(F.col("var").alias("_var"), F.col("value").alias("_value"), F.col("ty").alias("_ty"))
            rest = rest.join(with_it, F.col(f"{side}_var") == F.col("_var"), "left").select(
                *(c for c in columns if not c.startswith(f"{side}_")),
                F.when(F.col("_var").isNull(), F.col(f"{side}_var")).alias(f"{side}_var"), F.coalesce("_value", f"{side}_const").alias(f"{side}_const"), F.coalesce("_ty", f"{side}_ty").alias(f"{side}_ty"),
            )
        whole = F.col("lhs_var").isNull() & (copy | F.col("rhs_var").isNull())
        value = F.when(copy, F.col("lhs_const")).otherwise(evaluate(F.col("op"), F.col("lhs_const"), F.col("rhs_const"), F.col("lhs_ty"), F.col("rhs_ty"))).cast(NUMBER)
        done = materialise(spark, rest.select(*columns, whole.alias("_whole"), F.when(whole, value).alias("_value")).where(~F.col("_whole") | F.col("_value").isNotNull()))
        new = done.where("_whole").select(F.col("dest").alias("var"), F.col("_value").alias("value"), F.col("lhs_ty").alias("ty"))
        rest = done.where("not _whole").select(*columns)
        parts.append(done)
        if new.isEmpty():
            out = materialise(spark, found)
            release(*parts)
            return out
        found = found.union(new)
        if len(parts) > 32:
            found = materialise(spark, found)
            release(*parts[:-1])
            parts = [found, parts[-1]]
    raise NotConverged(f"constants still found after {max_rounds} rounds")


def constant_folding(spark: SparkSession, program: Program, max_rounds: int = ROUNDS) -> Program:
    """Find all constants, put them in, evaluate, fold terminators, then drop copies."""
    known = all_constants(spark, program.instructions, max_rounds)
    insts = materialise(spark, evaluate_binary_ops(promote_constants(program.instructions, known), known))
    ends = materialise(spark, fold_terminators(program.terminators, insts, known))
    return eliminate_copies(spark, replace(program, instructions=insts, terminators=ends))
