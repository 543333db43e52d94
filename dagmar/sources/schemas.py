"""Schemas of the program relations; optional fields are nullable columns."""

from __future__ import annotations

from dagmar.functions.scalars import NUMBER

VALUE = f"struct<var:bigint,const:{NUMBER},ty:string>"

#: Block IR. A value is a variable or a constant; bool constants are 0 and 1.
INSTRUCTIONS = f"inst_id bigint, op string, dest bigint, dest_ty string, lhs_var bigint, lhs_const {NUMBER}, lhs_ty string, rhs_var bigint, rhs_const {NUMBER}, rhs_ty string, callee bigint, args array<{VALUE}>, name string"
BLOCK_INSTRUCTIONS = "inst_id bigint, block_id bigint, pos bigint"
TERMINATORS = f"block_id bigint, kind string, cond_var bigint, cond_const boolean, t1 bigint, t2 bigint, ret_var bigint, ret_const {NUMBER}, ret_ty string"
BLOCKS = "block_id bigint, name string"
FUNCTION_BLOCKS = "block_id bigint, func_id bigint"
FUNCTIONS = "func_id bigint, name string, ret_ty string, entry bigint, params array<struct<var:bigint,ty:string>>"

#: Graph IR. Edges go from consumer to producer.
NODES = "node_id bigint, kind string, lhs bigint, rhs bigint, cmp_kind string, u8 int, b boolean, arr array<int>, ty string"
EDGES = "src bigint, dst bigint"
FUNCTION_NODES = "node_id bigint, func_id bigint"
GRAPH_FUNCTIONS = "func_id bigint, name string"

#: E-graph nodes: Add and Sub of two classes, Constant and Param.
ENODES = "id bigint, op string, lhs bigint, rhs bigint"
