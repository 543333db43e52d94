"""The verifier: seven kinds of mistakes, as rows of one relation.

(error, inst_id, block_id, var, expected, found); fields that a kind has no use
for are null. Variables that are declared with several types are reported once
and left out of the type checks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dagmar.functions.scalars import BINOPS, valid_bitcast
from dagmar.plans.ir.collect import collect_declarations, collect_usages, collect_values
from dagmar.sources.program import Program

COLUMNS = {"inst_id": "bigint", "block_id": "bigint", "var": "bigint", "expected": "string", "found": "string"}


def _error(df: DataFrame, kind: str, **columns: Column | str) -> DataFrame:
    return df.select(F.lit(kind).alias("error"), *((F.col(columns[c]) if isinstance(columns.get(c), str) else columns.get(c, F.lit(None))).cast(t).alias(c) for c, t in COLUMNS.items()))


def _declared(p: Program) -> DataFrame:
    params = p.functions.select(F.explode("params").alias("x")).select("x.var", "x.ty")
    return collect_declarations(p.instructions).select("var", "ty").unionByName(params)


def _sound(p: Program) -> DataFrame:
    """(var, ty) of variables with one type."""
    return _declared(p).groupBy("var").agg(F.min("ty").alias("ty"), F.max("ty").alias("_other")).where("ty = _other").drop("_other")


def undeclared_variables(p: Program) -> DataFrame:
    return _error(collect_usages(p.instructions).join(_declared(p), ["var", "ty"], "left_anti"), "UndeclaredVariable", inst_id="inst_id", var="var", found="ty")


def redeclarations(p: Program) -> DataFrame:
    declared = collect_declarations(p.instructions)
    twice = declared.groupBy("var").agg(F.count("*").alias("_n")).where("_n > 1")
    return _error(declared.join(twice, "var"), "Redeclaration", inst_id="inst_id", var="var", found="ty")


def undeclared_blocks(p: Program) -> DataFrame:
    edges = p.jump_edges()
    return _error(edges.join(p.blocks.select(F.col("block_id").alias("dst")), "dst", "left_anti"), "UndeclaredBlock", block_id="src", var="dst")


def cross_function_jumps(p: Program) -> DataFrame:
    of = lambda end: p.function_blocks.select(F.col("block_id").alias(end), F.col("func_id").alias(f"{end}_func"))
    edges = p.jump_edges().join(of("src"), "src").join(of("dst"), "dst").where("src_func <> dst_func")
    return _error(edges, "CrossFunctionJump", block_id="src", var="dst", expected=F.col("src_func").cast("string"), found=F.col("dst_func").cast("string"))


def type_mismatches(p: Program) -> DataFrame:
    """Operands that disagree, a result that disagrees with its operands, a use that disagrees with the declaration."""
    binops = p.instructions.where(F.col("op").isin(*BINOPS))
    operands_ = _error(binops.where("lhs_ty <> rhs_ty"), "VariableTypeMismatch", inst_id="inst_id", var="dest", expected="lhs_ty", found="rhs_ty")
    inferred = p.instructions.where(F.col("op").isin(*BINOPS, "Assign", "Neg")).select("inst_id", F.col("dest").alias("var"), F.col("lhs_ty").alias("inferred"))
    inferred = inferred.unionByName(p.instructions.where("op = 'Cmp'").select("inst_id", F.col("dest").alias("var"), F.lit("bool").alias("inferred")))
    results = _error(inferred.join(_sound(p), "var").where("ty <> inferred"), "VariableTypeMismatch", inst_id="inst_id", var="var", expected="ty", found="inferred")
    uses = collect_usages(p.instructions).withColumnRenamed("ty", "used").join(_sound(p), "var").where("ty <> used")
    return reduce(DataFrame.unionByName, [operands_, results, _error(uses, "VariableTypeMismatch", inst_id="inst_id", var="var", expected="ty", found="used")])


def invalid_bitcasts(p: Program) -> DataFrame:
    casts = p.instructions.where("op = 'Bitcast'")
    return _error(casts.where(~valid_bitcast(F.col("dest_ty"), F.col("lhs_ty"))), "InvalidBitcast", inst_id="inst_id", var="dest", expected="dest_ty", found="lhs_ty")


def constant_type_mismatches(p: Program) -> DataFrame:
    """Literals outside the range of the type they are given."""
    from dagmar.functions.scalars import in_range

    fits = F.when(F.col("ty") == "bool", F.col("const").isin(0, 1)).otherwise(in_range(F.col("const"), F.col("ty")).isNotNull())
    odd = collect_values(p.instructions).where(F.col("const").isNotNull() & ~F.coalesce(fits, F.lit(False)))
    return _error(odd, "ConstantTypeMismatch", inst_id="inst_id", expected="ty", found=F.col("const").cast("string"))


CHECKS = {
    "undeclared_variable": undeclared_variables, "redeclaration": redeclarations, "undeclared_block": undeclared_blocks, "cross_function_jump": cross_function_jumps,
    "type_mismatch": type_mismatches, "invalid_bitcast": invalid_bitcasts, "constant_type_mismatch": constant_type_mismatches,
}


def verify(p: Program) -> DataFrame:
    """All mistakes, each once."""
    return reduce(DataFrame.unionByName, [check(p) for check in CHECKS.values()]).distinct()
