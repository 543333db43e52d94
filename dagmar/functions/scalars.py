"""Scalar semantics of the two intermediate representations, as column expressions.

Block IR constants are DECIMAL(20,0), which holds both signed and unsigned
64-bit values; a result out of its type's range, a division by zero or operands
of different types give null, which means "not folded". Graph IR bytes wrap.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = "decimal(20,0)"
BINOPS = ("Add", "Sub", "Mul", "Div")
#: The ranges of the block IR's number types.
RANGES = {"int": (-(2**63), 2**63 - 1), "uint": (0, 2**64 - 1)}
#: Estimated machine instructions of each instruction and terminator.
ESTIMATES = {"Add": 1, "Sub": 1, "Mul": 1, "Div": 1, "Assign": 1, "Neg": 1, "Cmp": 1, "Bitcast": 0, "Call": 5, "Jump": 1, "Return": 1, "Branch": 1, "Unreachable": 0}
#: Inline cost of each graph node kind; all others cost nothing.
INLINE_COSTS = {"Mul": 1, "Add": 1, "Sub": 1, "Cmp": 2, "Load": 2, "Store": 2, "Return": 1, "Branch": 1}
#: The casts (destination, source) that keep a meaning.
BITCASTS = [("int", "int"), ("int", "uint"), ("uint", "int"), ("uint", "uint"), ("int", "bool"), ("uint", "bool"), ("bool", "int"), ("bool", "uint"), ("bool", "bool")]


def in_range(value: Column, ty: Column) -> Column:
    """The value as a constant of its type, null if it is out of range or not of a number type."""
    bounds = lambda t: value.between(*(F.lit(str(b)).cast("decimal(38,0)") for b in RANGES[t]))
    fits = F.when(ty == "int", bounds("int")).when(ty == "uint", bounds("uint"))
    return F.when(fits, value).cast(NUMBER)


def evaluate(op: Column, lhs: Column, rhs: Column, lhs_ty: Column, rhs_ty: Column) -> Column:
    """Add, Sub, Mul and truncating Div of two constants of one type."""
    quotient = F.when(rhs != 0, (lhs - lhs % rhs) / rhs)
    wide = lambda c: c.cast("decimal(38,0)")
    result = F.when(op == "Add", wide(F.try_add(lhs, rhs))).when(op == "Sub", wide(F.try_subtract(lhs, rhs))).when(op == "Mul", wide(F.try_multiply(lhs, rhs))).when(op == "Div", wide(quotient))
    return F.when(lhs_ty == rhs_ty, in_range(result, lhs_ty))


def wrap_u8(op: Column, lhs: Column, rhs: Column) -> Column:
    """Add, Sub and Mul of bytes, modulo 256."""
    lhs, rhs = lhs.cast("int"), rhs.cast("int")
    result = F.when(op == "Add", lhs + rhs).when(op == "Sub", lhs - rhs).when(op == "Mul", lhs * rhs)
    return F.pmod(result, F.lit(256)).cast("int")


def compare(kind: Column, lhs: Column, rhs: Column) -> Column:
    """The six comparisons of the graph IR, operands in order."""
    return F.when(kind == "==", lhs == rhs).when(kind == "!=", lhs != rhs).when(kind == "<", lhs < rhs).when(kind == ">", lhs > rhs).when(kind == "<=", lhs <= rhs).when(kind == ">=", lhs >= rhs)


def _lookup(table: dict[str, int], key: Column, default: int = 0) -> Column:
    return reduce(lambda c, kv: c.when(key == kv[0], kv[1]), list(table.items())[1:], F.when(key == next(iter(table)), next(iter(table.values())))).otherwise(default)


def estimated_instructions(op: Column) -> Column:
    return _lookup(ESTIMATES, op)


def node_inline_cost(kind: Column) -> Column:
    return _lookup(INLINE_COSTS, kind)


def is_pure(op: Column) -> Column:
    """All but calls; what a call does is not known."""
    return op != "Call"


def function_inline_cost(asm: Column, branches: Column, calls: Column, pure: Column, recursive: Column) -> Column:
    """(asm + 1.2 branches + 1.4 calls) times 0.6 if pure, times 1.3 if recursive."""
    cost = asm + branches * F.lit(1.2) + calls * F.lit(1.4)
    return cost * F.when(pure, F.lit(0.6)).otherwise(F.lit(1.0)) * F.when(recursive, F.lit(1.3)).otherwise(F.lit(1.0))


def valid_bitcast(dest_ty: Column, source_ty: Column) -> Column:
    return reduce(lambda a, b: a | b, [(dest_ty == d) & (source_ty == s) for d, s in BITCASTS])


def redundant_bitcast(dest_ty: Column, source_ty: Column) -> Column:
    return dest_ty == source_ty


def is_zero(const: Column) -> Column:
    return F.coalesce(const == 0, F.lit(False))


def is_signed_int(const: Column, ty: Column) -> Column:
    return const.isNotNull() & (ty == "int")


def as_bool(const: Column, ty: Column) -> Column:
    """A constant of type bool as a boolean, null for other types."""
    return F.when(ty == "bool", const != 0)


def jump_targets(t1: Column, t2: Column) -> Column:
    """The blocks a terminator may go to."""
    return F.filter(F.array(t1, t2), lambda x: x.isNotNull())


def is_branching(kind: Column) -> Column:
    return kind == "Branch"


def is_binop(op: Column) -> Column:
    return op.isin(*BINOPS)


def operands(lhs: Column, rhs: Column, args: Column) -> Column:
    """All operands (structs of var, const, ty) that are there."""
    return F.filter(F.concat(F.array(lhs, rhs), F.coalesce(args, F.array().cast("array<struct<var:bigint,const:decimal(20,0),ty:string>>"))), lambda v: v["var"].isNotNull() | v["const"].isNotNull())


def replace_uses(args: Column, var: Column, replacement: Column) -> Column:
    """Call arguments with one variable replaced by a value struct."""
    return F.transform(args, lambda a: F.when(a["var"] == var, replacement).otherwise(a))
