"""Tables that grow with the input are joined by shuffles, however small their files: the driver would hold a broadcast whole."""

import pytest

from dagmar.plans import lineage
from dagmar.plans.catalogue import QUERIES
from dagmar.plans.graph_ir import passes
from dagmar.sources.fixtures import Tables

SF = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcast(spark, monkeypatch):
    """Any table counts as large; called, it makes any broadcast an error. What AQE measures is left out: those sizes are of rows, not of files."""
    monkeypatch.setattr(lineage, "BROADCAST_ROWS", -1, raising=False)
    confs = {"spark.sql.maxBroadcastTableSize": "1b", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    yield lambda: [spark.conf.set(k, v) for k, v in confs.items()]
    for k in confs:
        spark.conf.unset(k)


def test_written_tables_are_broadcast_by_their_rows(spark, monkeypatch):
    monkeypatch.setattr(lineage, "BROADCAST_ROWS", 1000)
    few, many = (lineage.materialise(spark, spark.range(n)) for n in (1000, 1001))
    plan = lambda df: spark.range(10**7).join(df, "id")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan(few) and "SortMergeJoin" in plan(many)
    assert lineage.materialise(spark, spark.range(0)).count() == 0  # a count of no rows comes, too
    lineage.release(few, many)


@pytest.mark.parametrize("name", ["cleanup_program", "compact_blocks", "constant_folding", "cull_unreachable", "live_instructions", "eliminate_copies", "ir_optimise"])
def test_no_table_is_broadcast(spark, no_broadcast, name):
    no_broadcast()
    QUERIES[name](spark, SF).collect()


def test_no_edges_are_broadcast_for_inline_costs(spark, no_broadcast):
    """The tables are written before, as the fixture's own query broadcasts the eight numbers of a part's nodes."""
    graph = Tables(spark, SF).graph_tables()
    no_broadcast()
    assert passes.trivial_inline(spark, graph).count() == Tables(spark, SF).part.count()


@pytest.mark.parametrize("name", ["compact_blocks", "cull_unreachable", "live_instructions", "eliminate_copies"])
def test_no_broadcast_is_planned(spark, no_broadcast, name):
    """Without AQE, which may drop what the planner chose by the size of files."""
    no_broadcast()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        QUERIES[name](spark, SF).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
