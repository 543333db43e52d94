"""Programs built by hand, with results known by hand."""

import pytest
from pyspark.sql import functions as F

from dagmar.functions import scalars
from dagmar.plans.equisat import egraph, sexpr
from dagmar.plans.graph_ir import passes
from dagmar.plans.graph_ir.dce import remove_places
from dagmar.plans.ir import cleanup, folding, inline, loops, optimise, verify
from dagmar.sources import brainfuck, builder, dot, pretty, translate
from dagmar.sources.builder import Context, integer, unsigned
from dagmar.sources.inputs import InputManager, ProgramInputs
from dagmar.sources.program import ProgramGraph


def one_function(build, ret="int"):
    b = Context().builder()
    b.named_function("f", ret, build)
    return b


def returned(p):
    return [(r["ret_const"], r["ret_ty"]) for r in p.terminators.where("kind = 'Return'").collect()]


def test_additions_fold_to_45(spark):
    def build(f):
        def body(b):
            v2 = b.add(b.assign(integer(32)), b.assign(integer(5)))
            b.ret(b.add(v2, b.assign(integer(8))))

        f.named_basic_block("entry", body)

    p = optimise.optimise(spark, one_function(build).program(spark))
    assert returned(p) == [(45, "int")]
    assert p.instructions.count() == 0 and p.blocks.count() == 1


def test_subtraction_folds_to_41(spark):
    def build(f):
        f.basic_block(lambda b: b.ret(b.sub(b.named_assign("v1", integer(42)), b.assign(integer(1)))))

    p = one_function(build).program(spark)
    assert verify.verify(p).collect() == []
    assert returned(folding.constant_folding(spark, p)) == [(41, "int")]


def test_loop_edges(spark):
    def build(f):
        x = f.param("uint")
        head, tail, ret = f.allocate_named_basic_block("head"), f.allocate_basic_block("tail"), f.allocate_basic_block("ret")
        f.resume_building(head, lambda b: b.branch(b.cmp(x, unsigned(10)), tail, ret))
        f.resume_building(tail, lambda b: b.jump(head))
        f.resume_building(ret, lambda b: b.ret_unit())

    p = one_function(build, "unit").program(spark)
    names = {r["block_id"]: r["name"] for r in p.blocks.collect()}
    assert {(names[r["src"]], names[r["dst"]]) for r in loops.loops(spark, p).collect()} == {("head", "tail"), ("tail", "head"), ("head", "ret")}


def test_branch_and_call_program(spark):
    context = Context()
    b = context.builder()
    add_uint = b.allocate_named_function("add_uint", "uint")

    def adder(f):
        x, y = f.params(["uint", "uint"])
        f.basic_block(lambda bb: bb.ret(bb.add(x, y)))

    b.materialize(add_uint, adder)

    def caller(f):
        x = f.param("uint")
        entry, folded, instant = f.allocate_basic_block("entry"), f.allocate_basic_block("folded"), f.allocate_basic_block("instant_return")
        f.set_entry(entry.id)

        def first(bb):
            bb.call(add_uint, [x, unsigned(100)])
            bb.branch(builder.boolean(True), folded, instant)

        def second(bb):
            a = bb.assign(unsigned(100))
            twice, half = bb.mul(a, unsigned(2)), bb.div(a, unsigned(2))
            bb.ret(bb.call(add_uint, [twice, half]))

        f.resume_building(entry, first)
        f.resume_building(folded, second)
        f.resume_building(instant, lambda bb: bb.ret(unsigned(0)))

    b.named_function("cross_branch_propagation", "uint", caller)
    p = b.program(spark)
    assert verify.verify(p).collect() == []
    done = optimise.optimise(spark, p)
    calls = done.instructions.where("op = 'Call'").collect()
    assert sorted([[int(a["const"]) if a["const"] is not None else None for a in c["args"]] for c in calls], key=str) == [[200, 50], [None, 100]]
    assert "instant_return" not in {r["name"] for r in done.blocks.collect()}
    assert done.terminators.where("kind = 'Branch'").isEmpty() and done.functions.count() == 2
    text = "".join(r["text"] for r in pretty.function_texts(done).collect())
    assert "call @fn_1(uint 200, uint 50)" in text and "def @add_uint(_1: uint, _2: uint) -> uint {" in text
    heur = {r["func_id"]: r for r in inline.harvest_heuristics(p).collect()}
    assert heur[1]["invocations"] == 2 and heur[1]["is_pure"] and not heur[2]["is_pure"] and heur[2]["branches"] == 1
    assert {r["callee"] for r in inline.early_inline(p).collect()} == {1}


def test_compaction_keeps_order_and_leaves_cycles(spark):
    def build(f):
        a, b_, c, d = (f.allocate_basic_block(n) for n in "abcd")
        f.resume_building(a, lambda b: (b.assign(integer(1), "i1"), b.jump(b_)))
        f.resume_building(b_, lambda b: (b.assign(integer(2), "i2"), b.jump(c)))
        f.resume_building(c, lambda b: b.ret(b.assign(integer(3), "i3")))
        f.resume_building(d, lambda b: b.jump(d))

    p = cleanup.compact_basic_blocks(spark, one_function(build).program(spark))
    assert {r["name"] for r in p.blocks.collect()} == {"c", "d"}
    rows = p.block_instructions.join(p.instructions, "inst_id").orderBy("pos").collect()
    assert [(r["pos"], r["name"]) for r in rows] == [(0, "i1"), (1, "i2"), (2, "i3")]
    entry = p.functions.first()["entry"]
    assert p.blocks.where(F.col("block_id") == entry).first()["name"] == "c"


def test_copies_resolve_to_their_root(spark):
    def build(f):
        x = f.param("int")
        f.basic_block(lambda b: b.ret(b.add(b.assign(b.assign(b.assign(x))), x)))

    p = folding.eliminate_copies(spark, one_function(build).program(spark))
    (only,) = p.instructions.collect()
    assert (only["op"], only["lhs_var"], only["rhs_var"]) == ("Add", 1, 1)


def test_scalars_at_the_edges(spark):
    rows = [("Add", 2**63 - 1, 1, "int"), ("Add", 2**64 - 2, 1, "uint"), ("Sub", 0, 1, "uint"), ("Div", -7, 2, "int"), ("Div", 7, 0, "int"), ("Mul", 2**40, 2**40, "uint"), ("Div", -(2**63), -1, "int"), ("Mul", -3, 5, "int"), ("Div", 2**64 - 1, 2, "uint"), ("Mul", 2**64 - 1, 2**64 - 1, "uint")]
    from decimal import Decimal

    df = spark.createDataFrame([(i, o, Decimal(a), Decimal(b), t) for i, (o, a, b, t) in enumerate(rows)], f"i int, op string, a {scalars.NUMBER}, b {scalars.NUMBER}, ty string")
    got = [r["v"] for r in df.select("i", scalars.evaluate(F.col("op"), F.col("a"), F.col("b"), F.col("ty"), F.col("ty")).alias("v")).orderBy("i").collect()]
    assert got == [None, 2**64 - 1, None, -3, None, None, None, -15, 2**63 - 1, None]


def test_builder_errors(spark):
    b = Context().builder()
    with pytest.raises(builder.EmptyFunctionBody):
        b.function("unit", lambda f: None)
    with pytest.raises(builder.MissingTerminator):
        b.function("unit", lambda f: f.basic_block(lambda bb: None))
    with pytest.raises(builder.MismatchedReturnTypes):
        b.function("int", lambda f: f.basic_block(lambda bb: bb.ret(unsigned(1))))
    with pytest.raises(builder.MismatchedOperandTypes):
        b.function("int", lambda f: f.basic_block(lambda bb: bb.add(integer(1), unsigned(1))))
    with pytest.raises(builder.IncorrectConditionType):
        b.function("int", lambda f: f.basic_block(lambda bb: bb.branch(integer(1), 1, 2)))
    with pytest.raises(builder.MissingEntryBlock):
        builder.FunctionBuilder(b, builder.Deferred(9)).entry()
    with pytest.raises(builder.EmptyFunctionBody):
        b.allocate_function("unit")
        b.rows()


def test_inputs_move_through_epochs(spark):
    inputs = InputManager(spark)
    b = Context().builder()
    b.function("int", lambda f: f.basic_block(lambda bb: bb.ret(bb.assign(integer(1)))))
    b.finish(inputs, 0)
    assert inputs.program().instructions.count() == 0
    inputs.advance_to(1)
    assert inputs.time() == 1 and inputs.program().instructions.count() == 1
    inputs.instructions.remove(*b.rows()["instructions"][0])
    inputs.advance_to(2)
    assert inputs.program().instructions.count() == 0 and inputs.instructions.changes().count() == 2
    with pytest.raises(ValueError):
        inputs.instructions.update_at((), 0, 1)
    with pytest.raises(AssertionError):
        inputs.blocks.advance_to(5)
        inputs.time()


def graph_program(build):
    b = Context().builder()
    b.named_function("main", "unit", build)
    return b


def test_graph_reduces_to_a_returned_zero(spark):
    def build(f):
        x, y = f.vsdg_params(["u8", "u8"])
        t = f.vsdg_add(x, y)
        u = f.vsdg_add(t, f.vsdg_const(0))
        w = f.vsdg_add(f.vsdg_const(0), u)
        f.vsdg_return(f.vsdg_sub(w, w))

    inputs = ProgramInputs(spark)
    graph_program(build).vsdg_finish(inputs)
    inputs.advance_to(1)
    g = passes.optimise(spark, inputs.graph())
    assert sorted((r["kind"], r["u8"]) for r in g.nodes.select("kind", "u8").collect()) == [("Constant", 0), ("End", None), ("Return", None), ("Start", None)]
    assert g.value_edges.count() == 1
    text = dot.render(g)
    assert text.startswith("digraph {") and 'label = "0: u8", shape = circle' in text and "color = forestgreen" in text


def test_loops_of_the_graph(spark):
    def build(f):
        p = f.vsdg_ptr_to(f.vsdg_const([0, 0]))
        f.vsdg_loop(lambda g: g.vsdg_cmp("==", g.vsdg_load(p), g.vsdg_const(0)))
        f.vsdg_return(f.vsdg_load(p))

    g = graph_program(build).graph(spark)
    kinds = {r["node_id"]: r["kind"] for r in g.nodes.collect()}
    assert {(kinds[r["src"]], kinds[r["dst"]]) for r in passes.detect_loops(spark, g).collect()} == {("LoopHead", "LoopTail"), ("LoopTail", "LoopHead")}
    assert g.nodes.count() == len(kinds)


def test_places_next_to_places_stay(spark):
    nodes = [(i, "Place" if i in (2, 4, 5) else "Constant", None, None, None, 1, None, None, "u8") for i in range(1, 8)]
    g = ProgramGraph.of(spark, nodes=nodes, value_edges=[(1, 2), (2, 3), (3, 4), (4, 5), (5, 6)])
    assert {tuple(r) for r in remove_places(g).value_edges.collect()} == {(1, 3), (3, 4), (4, 5), (5, 6)}


def test_missing_ends_are_drawn_as_errors(spark):
    assert 'label = "Error"' in dot.render(ProgramGraph.of(spark, value_edges=[(1, 2)]))
    with pytest.raises(ValueError):
        dot.render(ProgramGraph.of(spark, value_edges=[(1, 2)]), most=1)


def test_brainfuck(spark):
    assert brainfuck.parse("+[>-<x]") == ["+", [">", "-", "<"]]
    for bad in ("[", "]"):
        with pytest.raises(SyntaxError):
            brainfuck.parse(bad)
    g = brainfuck.compile_source("+[>-<]", tape=4).graph(spark)
    kinds = sorted(r["kind"] for r in g.nodes.collect())
    assert kinds.count("LoopHead") == kinds.count("LoopTail") == 1 and kinds.count("Store") == 2
    assert passes.optimise(spark, g).nodes.count() > 5


def test_epochs_of_an_e_graph(spark):
    schema = "id bigint, op string, lhs bigint, rhs bigint"
    g = egraph.EGraph(spark).add_rewrite("(add ?x (sub ?y ?x)) => ?y")
    g.add_enodes(spark.createDataFrame([(0, "Add", 2, 1), (1, "Sub", 3, 2), (2, "Constant", None, None), (3, "Constant", None, None)], schema))
    assert {r["id"]: r["class"] for r in g.saturate()[0].collect()} == {0: 0, 1: 1, 2: 2, 3: 0}
    g.add_enodes(spark.createDataFrame([(6, "Sub", 4, 2), (4, "Constant", None, None), (7, "Add", 8, 1), (8, "Constant", None, None), (10, "Add", 2, 11), (11, "Constant", None, None)], schema))
    lookup, canonical = g.saturate()
    classes = {r["id"]: r["class"] for r in lookup.collect()}
    assert classes[0] == classes[3] == 0 and len(set(classes.values())) == 9
    costs = {r["id"]: r["cost"] for r in egraph.extract(spark, canonical).collect()}
    assert costs[3] == 0 and costs[1] == 1


def test_rules_in_text():
    rule = sexpr.parse("(add ?x (sub ?x ?y)) => ?y")
    assert rule.left == (sexpr.Ident("add"), sexpr.Var("x"), (sexpr.Ident("sub"), sexpr.Var("x"), sexpr.Var("y"))) and rule.right == sexpr.Var("y")
    assert sexpr.parse("(f 1 true) => false").left == (sexpr.Ident("f"), 1, True)
    with pytest.raises(ValueError):
        sexpr.parse("(add ?x 1) => ?y")
    for bad in ("(add ?x", "add)", "a b => c", "=> a", "a => #"):
        with pytest.raises(SyntaxError):
            sexpr.parse(bad)


def test_nested_functions_come_back(spark):
    def build(f):
        a, b_ = f.allocate_basic_block("a"), f.allocate_basic_block("b")
        f.resume_building(a, lambda b: (b.assign(integer(1)), b.jump(b_)))
        f.resume_building(b_, lambda b: b.ret(integer(2)))

    p = one_function(build).program(spark)
    back = translate.translate(translate.reconstruct(p))
    p.assert_eq(back)
    with pytest.raises(AssertionError):
        p.assert_eq(cleanup._restrict(p, blocks=p.blocks.limit(1).select("block_id")))


def test_a_chain_deeper_than_a_hundred_folds(spark):
    from dagmar.plans.ir import folding

    n = 104
    rows = [(0, "Assign", 0, "int", None, 1, "int", None, None, None)] + [(i, "Add", i, "int", i - 1, None, "int", None, 1, "int") for i in range(1, n)]
    insts = spark.createDataFrame(rows, "inst_id long, op string, dest long, dest_ty string, lhs_var long, lhs_const long, lhs_ty string, rhs_var long, rhs_const long, rhs_ty string")
    insts = insts.selectExpr("inst_id", "op", "dest", "dest_ty", "lhs_var", "cast(lhs_const as decimal(20,0)) lhs_const", "lhs_ty", "rhs_var", "cast(rhs_const as decimal(20,0)) rhs_const", "rhs_ty")
    found = {r["var"]: int(r["value"]) for r in folding.all_constants(spark, insts).collect()}
    assert found == {i: i + 1 for i in range(n)}
