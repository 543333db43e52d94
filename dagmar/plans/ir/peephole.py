"""Rewrites of single instructions, as one projection."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dagmar.functions.scalars import NUMBER, is_zero

#: A pass: (when it applies, the columns it changes).
Pass = Callable[[], tuple[Column, dict[str, Column]]]



def _nothing() -> dict[str, Column]:
    return {"rhs_var": F.lit(None).cast("long"), "rhs_const": F.lit(None).cast(NUMBER), "rhs_ty": F.lit(None).cast("string")}


def mul_by_zero() -> tuple[Column, dict[str, Column]]:
    """0 * x and x * 0 are 0."""
    hit = (F.col("op") == "Mul") & (is_zero(F.col("lhs_const")) | is_zero(F.col("rhs_const")))
    return hit, _nothing() | {"op": F.lit("Assign"), "lhs_var": F.lit(None).cast("long"), "lhs_const": F.lit(0).cast(NUMBER), "lhs_ty": F.col("dest_ty")}


def subtract_zero() -> tuple[Column, dict[str, Column]]:
    """x - 0 is x."""
    return (F.col("op") == "Sub") & is_zero(F.col("rhs_const")), _nothing() | {"op": F.lit("Assign")}


def zero_minus() -> tuple[Column, dict[str, Column]]:
    """0 - x is -x, for signed x."""
    hit = (F.col("op") == "Sub") & is_zero(F.col("lhs_const")) & (F.col("lhs_ty") == "int")
    return hit, _nothing() | {"op": F.lit("Neg"), "lhs_var": F.col("rhs_var"), "lhs_const": F.col("rhs_const"), "lhs_ty": F.col("rhs_ty")}


PASSES: Sequence[Pass] = (mul_by_zero, subtract_zero, zero_minus)


def peephole(instructions: DataFrame, passes: Sequence[Pass] = PASSES) -> DataFrame:
    """Apply the passes in order, each to what the one before left."""
    for p in passes:
        hit, new = p()
        instructions = instructions.select(*(F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in instructions.columns))
    return instructions
