"""Building programs in Python: rows gather on the driver and become relations at the end.

Mistakes raise BuilderError where they are made.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import SparkSession

from dagmar.functions.scalars import RANGES
from dagmar.sources.inputs import InputManager, ProgramInputs
from dagmar.sources.program import Program, ProgramGraph

TYPES = ("int", "uint", "bool", "unit", "infer")


class BuilderError(Exception):
    """One of the kinds below."""


class MissingTerminator(BuilderError):
    pass


class EmptyFunctionBody(BuilderError):
    pass


class MissingEntryBlock(BuilderError):
    pass


class MismatchedReturnTypes(BuilderError):
    pass


class MismatchedOperandTypes(BuilderError):
    pass


class IncorrectConditionType(BuilderError):
    pass


@dataclass(frozen=True)
class Value:
    """A variable or a constant, with its type."""

    ty: str
    var: int | None = None
    const: int | bool | None = None

    def number(self) -> Decimal | None:
        return None if self.const is None else Decimal(int(self.const))


def constant(ty: str, value: int | bool) -> Value:
    if ty in RANGES and not RANGES[ty][0] <= value <= RANGES[ty][1]:
        raise ValueError(f"{value} is no {ty}")
    return Value(ty, const=value)


def integer(value: int) -> Value:
    return constant("int", value)


def unsigned(value: int) -> Value:
    return constant("uint", value)


def boolean(value: bool) -> Value:
    return constant("bool", bool(value))


def unify(a: str, b: str, error: type[BuilderError], what: str) -> str:
    """The type that two types agree on; infer agrees with any."""
    if "infer" in (a, b):
        return b if a == "infer" else a
    if a != b:
        raise error(f"{what}: {a} and {b}")
    return a


class Context:
    """Hands out ids from 1 on, for any number of builders."""

    def __init__(self, ident_generation: int = 0):
        self.ident_generation = ident_generation
        self._ids = {k: itertools.count(1) for k in ("func", "block", "inst", "var", "node")}
        self.names: dict[str, str] = {}

    def id(self, kind: str) -> int:
        return next(self._ids[kind])

    def intern(self, name: str) -> str:
        return self.names.setdefault(name, name)

    def builder(self) -> Builder:
        return Builder(self)


@dataclass
class Deferred:
    """A function or block that is named before it is built."""

    id: int
    name: str | None = None
    ret_ty: str = "infer"
    done: bool = False


class Builder:
    def __init__(self, context: Context):
        self.context = context
        self.functions: list[FunctionBuilder] = []
        self.deferred: list[Deferred] = []

    def function(self, ret_ty: str, build: Callable[[FunctionBuilder], None], name: str | None = None) -> int:
        return self.materialize(self.allocate_function(ret_ty, name), build)

    def named_function(self, name: str, ret_ty: str, build: Callable[[FunctionBuilder], None]) -> int:
        return self.function(ret_ty, build, name)

    def allocate_function(self, ret_ty: str = "infer", name: str | None = None) -> Deferred:
        d = Deferred(self.context.id("func"), name and self.context.intern(name), ret_ty)
        self.deferred.append(d)
        return d

    def allocate_named_function(self, name: str, ret_ty: str = "infer") -> Deferred:
        return self.allocate_function(ret_ty, name)

    def materialize(self, deferred: Deferred, build: Callable[[FunctionBuilder], None]) -> int:
        func = FunctionBuilder(self, deferred)
        build(func)
        func.finish()
        self.functions.append(func)
        deferred.done = True
        return deferred.id

    resume_building = materialize

    def discard(self, deferred: Deferred) -> None:
        deferred.done = True

    def _check(self) -> None:
        missing = [d.name or d.id for d in self.deferred if not d.done]
        if missing:
            raise EmptyFunctionBody(f"never built or discarded: {missing}")

    def _resolve(self) -> None:
        """Types left to infer: a call's result has its function's type, and a variable one type wherever it is used."""
        returns = {f.id: f.ret_ty for f in self.functions}
        types: dict[int, str] = {}
        before = None
        while types != before:  # a chain of calls hands its types on by a call a pass
            before = dict(types)
            for f in self.functions:
                for i in f.insts:
                    if i["dest_ty"] == "infer" and i["op"] == "Call":
                        i["dest_ty"] = returns.get(i["callee"], "infer")
                    elif i["dest_ty"] == "infer" and i["lhs"] is not None:
                        i["dest_ty"] = types.get(i["lhs"].var, i["lhs"].ty)
                    types[i["dest"]] = i["dest_ty"]
        typed = lambda v: Value(types.get(v.var, v.ty), v.var, v.const) if v is not None and v.ty == "infer" else v
        for f in self.functions:
            for i in f.insts:
                i["lhs"], i["rhs"], i["args"] = typed(i["lhs"]), typed(i["rhs"]), [typed(a) for a in i["args"]]
            for b in f.blocks:
                b.end["ret"] = typed(b.end["ret"])

    def rows(self) -> dict[str, list[tuple]]:
        """Block IR rows by relation."""
        self._check()
        self._resolve()
        out: dict[str, list[tuple]] = {k: [] for k in Program.SCHEMAS}
        parts = lambda v: (v.var, v.number(), v.ty) if v is not None else (None, None, None)
        for f in self.functions:
            out["functions"].append((f.id, f.name, f.ret_ty, f.entry_block, [(v.var, v.ty) for v in f.parameters]))
            for i in f.insts:
                out["instructions"].append((i["id"], i["op"], i["dest"], i["dest_ty"], *parts(i["lhs"]), *parts(i["rhs"]), i["callee"], [parts(a) for a in i["args"]], i["name"]))
            for b in f.blocks:
                out["blocks"].append((b.id, b.name))
                out["function_blocks"].append((b.id, f.id))
                out["block_instructions"] += [(i, b.id, pos) for pos, i in enumerate(b.inst_ids)]
                e = b.end
                cond = e["cond"]
                ret = parts(e["ret"])
                out["terminators"].append((b.id, e["kind"], cond and cond.var, bool(cond.const) if cond is not None and cond.const is not None else None, e["t1"], e["t2"], *ret))
        return out

    def program(self, spark: SparkSession) -> Program:
        return Program.of(spark, **self.rows())

    def finish(self, inputs: InputManager, time: int = 0) -> None:
        for name, rows in self.rows().items():
            for r in rows:
                inputs.sessions[name].update_at(r, time, 1)

    def graph_rows(self) -> dict[str, list[tuple]]:
        """Graph IR rows by relation."""
        self._check()
        out: dict[str, list[tuple]] = {k: [] for k in ProgramGraph.SCHEMAS}
        for f in self.functions:
            g = f.graph
            if not g:
                continue
            for name in ("value_edges", "effect_edges", "control_edges", "nodes"):
                out[name] += g[name]
            out["function_nodes"] += [(n[0], f.id) for n in g["nodes"]]
            out["functions"].append((f.id, f.name))
        return out

    def graph(self, spark: SparkSession) -> ProgramGraph:
        return ProgramGraph.of(spark, **self.graph_rows())

    def vsdg_finish(self, inputs: ProgramInputs, time: int = 0) -> None:
        for name, rows in self.graph_rows().items():
            for r in rows:
                inputs.sessions[name].update_at(r, time, 1)


@dataclass
class Block:
    id: int
    name: str | None
    inst_ids: list[int] = field(default_factory=list)
    end: dict | None = None


class FunctionBuilder:
    def __init__(self, builder: Builder, deferred: Deferred):
        self.builder, self.context = builder, builder.context
        self.id, self.name, self.ret_ty = deferred.id, deferred.name, deferred.ret_ty
        self.parameters: list[Value] = []
        self.insts: list[dict] = []
        self.blocks: list[Block] = []
        self.allocated: dict[int, Deferred] = {}
        self.entry_block: int | None = None
        self.graph: dict[str, list[tuple]] = {}
        self._effect: int | None = None

    def func_id(self) -> int:
        return self.id

    def set_name(self, name: str) -> None:
        self.name = self.context.intern(name)

    def has_entry(self) -> bool:
        return self.entry_block is not None

    def entry(self) -> int:
        if self.entry_block is None:
            raise MissingEntryBlock(f"function {self.name or self.id}")
        return self.entry_block

    def set_entry(self, block: int) -> None:
        self.entry_block = block

    def param(self, ty: str) -> Value:
        v = Value(ty, var=self.context.id("var"))
        self.parameters.append(v)
        return v

    def params(self, types: Iterable[str]) -> list[Value]:
        return [self.param(t) for t in types]

    def allocate_basic_block(self, name: str | None = None) -> Deferred:
        d = Deferred(self.context.id("block"), name and self.context.intern(name))
        self.allocated[d.id] = d
        return d

    def allocate_named_basic_block(self, name: str) -> Deferred:
        return self.allocate_basic_block(name)

    def basic_block(self, build: Callable[[BlockBuilder], None], name: str | None = None) -> int:
        return self.resume_building(self.allocate_basic_block(name), build)

    def named_basic_block(self, name: str, build: Callable[[BlockBuilder], None]) -> int:
        return self.basic_block(build, name)

    def resume_building(self, deferred: Deferred, build: Callable[[BlockBuilder], None]) -> int:
        block = BlockBuilder(self, Block(deferred.id, deferred.name))
        build(block)
        if not block.is_terminated():
            raise MissingTerminator(f"block {deferred.name or deferred.id}")
        self.blocks.append(block.block)
        deferred.done = True
        if self.entry_block is None:
            self.entry_block = deferred.id
        return deferred.id

    def finish(self) -> None:
        if not self.blocks and not self.graph:
            raise EmptyFunctionBody(f"function {self.name or self.id}")
        if self.blocks:
            self.entry()
        late = [d.name or d.id for d in self.allocated.values() if not d.done]
        if late:
            raise MissingTerminator(f"blocks never built: {late}")
        for b in self.blocks:
            if b.end["kind"] == "Return":
                ty = b.end["ret"].ty if b.end["ret"] is not None else "unit"
                self.ret_ty = unify(self.ret_ty, ty, MismatchedReturnTypes, f"function {self.name or self.id}")

    # graph IR

    def _start_graph(self) -> None:
        if not self.graph:
            self.graph = {k: [] for k in ("value_edges", "effect_edges", "control_edges", "nodes")}
            self._control = self._node("Start")
            self._end = self._node("End")

    def _node(self, kind: str, values: Iterable[int] = (), **fields) -> int:
        if not self.graph:
            self._start_graph()
        node = self.context.id("node")
        self.graph["nodes"].append((node, kind, *(fields.get(k) for k in ("lhs", "rhs", "cmp_kind", "u8", "b", "arr", "ty"))))
        self.graph["value_edges"] += [(node, v) for v in values]
        return node

    def _after_effect(self, node: int) -> int:
        if self._effect is not None:
            self.graph["effect_edges"].append((node, self._effect))
        self._effect = node
        return node

    def vsdg_param(self, ty: str) -> int:
        return self._node("Parameter", ty=ty)

    def vsdg_params(self, types: Iterable[str]) -> list[int]:
        return [self.vsdg_param(t) for t in types]

    def vsdg_const(self, value: int | bool | list[int]) -> int:
        if isinstance(value, bool):
            return self._node("Constant", b=value, ty="bool")
        if isinstance(value, list):
            return self._node("Constant", arr=value, ty="array")
        if not 0 <= value < 256:
            raise ValueError(f"{value} is no byte")
        return self._node("Constant", u8=value, ty="u8")

    def vsdg_add(self, lhs: int, rhs: int) -> int:
        return self._node("Add", (lhs, rhs), lhs=lhs, rhs=rhs)

    def vsdg_sub(self, lhs: int, rhs: int) -> int:
        return self._node("Sub", (lhs, rhs), lhs=lhs, rhs=rhs)

    def vsdg_mul(self, lhs: int, rhs: int) -> int:
        return self._node("Mul", (lhs, rhs), lhs=lhs, rhs=rhs)

    def vsdg_cmp(self, kind: str, lhs: int, rhs: int) -> int:
        return self._node("Cmp", (lhs, rhs), lhs=lhs, rhs=rhs, cmp_kind=kind)

    def vsdg_ptr_to(self, value: int) -> int:
        return self._node("Pointer", (value,))

    def vsdg_load(self, address: int) -> int:
        return self._after_effect(self._node("Load", (address,)))

    def vsdg_store(self, address: int, value: int) -> int:
        return self._after_effect(self._node("Store", (address, value)))

    def vsdg_return(self, value: int) -> int:
        node = self._node("Return", (value,))
        self.graph["control_edges"] += [(node, self._control), (self._end, node)]
        return node

    def vsdg_loop(self, body: Callable[[FunctionBuilder], int | None]) -> int:
        """A loop region between a head and a tail; the head follows the tail too, which closes the cycle."""
        head = self._node("LoopHead")
        self.graph["control_edges"].append((head, self._control))
        self._control = self._after_effect(head)
        condition = body(self)
        tail = self._node("LoopTail", () if condition is None else (condition,))
        self.graph["control_edges"] += [(tail, self._control), (head, tail)]
        self._control = self._after_effect(tail)
        return tail


class BlockBuilder:
    def __init__(self, func: FunctionBuilder, block: Block):
        self.func, self.block = func, block

    def block_id(self) -> int:
        return self.block.id

    def is_terminated(self) -> bool:
        return self.block.end is not None

    def _add(self, op: str, dest_ty: str, lhs: Value | None = None, rhs: Value | None = None, callee: int | None = None, args: Iterable[Value] = (), name: str | None = None) -> Value:
        if self.is_terminated():
            raise MissingTerminator("instruction after the terminator")
        inst, dest = self.func.context.id("inst"), self.func.context.id("var")
        self.func.insts.append({"id": inst, "op": op, "dest": dest, "dest_ty": dest_ty, "lhs": lhs, "rhs": rhs, "callee": callee, "args": list(args), "name": name})
        self.block.inst_ids.append(inst)
        return Value(dest_ty, var=dest)

    def assign(self, value: Value, name: str | None = None) -> Value:
        return self._add("Assign", value.ty, value, name=name)

    def named_assign(self, name: str, value: Value) -> Value:
        return self.assign(value, name)

    def _binop(self, op: str, lhs: Value, rhs: Value) -> Value:
        return self._add(op, unify(lhs.ty, rhs.ty, MismatchedOperandTypes, op), lhs, rhs)

    def add(self, lhs: Value, rhs: Value) -> Value:
        return self._binop("Add", lhs, rhs)

    def sub(self, lhs: Value, rhs: Value) -> Value:
        return self._binop("Sub", lhs, rhs)

    def mul(self, lhs: Value, rhs: Value) -> Value:
        return self._binop("Mul", lhs, rhs)

    def div(self, lhs: Value, rhs: Value) -> Value:
        return self._binop("Div", lhs, rhs)

    def cmp(self, lhs: Value, rhs: Value) -> Value:
        unify(lhs.ty, rhs.ty, MismatchedOperandTypes, "Cmp")
        return self._add("Cmp", "bool", lhs, rhs)

    def call(self, func: int | Deferred, args: Iterable[Value] = (), ret_ty: str = "infer") -> Value:
        if isinstance(func, Deferred):
            func, ret_ty = func.id, func.ret_ty if ret_ty == "infer" else ret_ty
        return self._add("Call", ret_ty, callee=func, args=args)

    def _end(self, kind: str, cond: Value | None = None, t1: int | None = None, t2: int | None = None, ret: Value | None = None) -> None:
        if self.is_terminated():
            raise MissingTerminator("a second terminator")
        self.block.end = {"kind": kind, "cond": cond, "t1": t1, "t2": t2, "ret": ret}

    @staticmethod
    def _target(block: int | Deferred) -> int:
        return block.id if isinstance(block, Deferred) else block

    def branch(self, cond: Value, if_true: int | Deferred, if_false: int | Deferred) -> None:
        if cond.ty not in ("bool", "infer"):
            raise IncorrectConditionType(f"a condition of type {cond.ty}")
        self._end("Branch", cond, self._target(if_true), self._target(if_false))

    def jump(self, block: int | Deferred) -> None:
        self._end("Jump", t1=self._target(block))

    def ret(self, value: Value) -> None:
        self._end("Return", ret=value)

    def ret_unit(self) -> None:
        self._end("Return")

    def unreachable(self) -> None:
        self._end("Unreachable")
