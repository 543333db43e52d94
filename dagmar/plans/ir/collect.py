"""Views of what instructions declare and use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dagmar.functions.scalars import operands


def _operands() -> F.Column:
    sides = [F.struct(F.col(f"{s}_var").alias("var"), F.col(f"{s}_const").alias("const"), F.col(f"{s}_ty").alias("ty")) for s in ("lhs", "rhs")]
    return operands(*sides, F.col("args"))


def collect_values(instructions: DataFrame) -> DataFrame:
    """(inst_id, var, const, ty) of every operand."""
    return instructions.select("inst_id", F.explode(_operands()).alias("v")).select("inst_id", "v.*")


def collect_usages(instructions: DataFrame) -> DataFrame:
    """(var, ty, inst_id) of every use of a variable."""
    return collect_values(instructions).where("var is not null").select("var", "ty", "inst_id")


def collect_declarations(instructions: DataFrame) -> DataFrame:
    return instructions.select(F.col("dest").alias("var"), F.col("dest_ty").alias("ty"), "inst_id")


def collect_var_types(instructions: DataFrame) -> DataFrame:
    return instructions.select(F.col("dest").alias("var"), F.col("dest_ty").alias("ty"))


def single_declarations(instructions: DataFrame) -> DataFrame:
    """(var) of variables that one instruction declares: only these stand for one value."""
    return instructions.groupBy(F.col("dest").alias("var")).agg(F.count("*").alias("_n")).where("_n = 1").select("var")
