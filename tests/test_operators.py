"""Corner cases that the catalogue's tables don't have."""

import pytest
from pyspark.sql import functions as F

from dagmar.operators import aggregates, exchange, fanout, graph, idents, inspect, joins, rowwise, zset
from dagmar.plans import fixpoint
from dagmar.sources import events
from dagmar.streaming.traces import TraceManager


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def pairs(spark, *items, names="src long, dst long"):
    return spark.createDataFrame(list(items), names)


def test_multiplicities_of_z_sets(spark):
    z = spark.createDataFrame([("a", 2), ("a", -2), ("b", 3), ("c", -1)], "k string, _diff long")
    assert rows(zset.consolidate(z)) == [("b", 3), ("c", -1)]
    assert rows(aggregates.distinct(z)) == [("b", 1), ("c", 1)]
    assert rows(aggregates.count_core(z, "k")) == [("b", 3), ("c", -1)]
    assert rows(rowwise.filter_diff(z, lambda d: d >= 0)) == [("a", 2), ("b", 3)]
    assert rows(aggregates.threshold(z, lambda d: (d > 0).cast("int"))) == [("b", 1)]
    assert rows(joins.join(z, z.withColumnRenamed("_diff", "_diff"), "k").groupBy("k").agg(F.sum("_diff"))) == [("a", 0), ("b", 9), ("c", 1)]
    assert rows(zset.to_bag(z.where("k <> 'c'"))) == [("b",)] * 3
    with pytest.raises(Exception, match="negative multiplicity"):
        zset.to_bag(z).collect()
    with pytest.raises(AssertionError):
        zset.assert_eq(z, zset.negate(z))


def test_a_route_out_of_range_fails(spark):
    with pytest.raises(Exception, match="route out of range"):
        [p.count() for p in fanout.partition(spark.range(5), 3, F.col("id").cast("int"))]
    with pytest.raises(ValueError):
        fanout.split_by(spark.range(1))


def test_append_buffer(spark):
    b = rowwise.AppendBuffer()
    b.push(1)
    b.extend([2])
    with pytest.raises(TypeError):
        b.pop()
    assert b == [1, 2]
    out = rowwise.buffered_flat_map(spark.range(3), lambda r, o: [o.push((r["id"], i)) for i in range(r["id"])], "a long, b long", batch=1)
    assert rows(out) == [(1, 0), (2, 0), (2, 1)]


def test_incremental_edge_culling(spark):
    edges = zset.lift(pairs(spark, (1, 2), (2, 3), (3, 1)))
    nodes = spark.createDataFrame([(1, 1), (2, 1)], "node long, _diff long")
    d_edges = spark.createDataFrame([(1, 3, 1), (1, 2, -1)], "src long, dst long, _diff long")
    d_nodes = spark.createDataFrame([(3, 1), (2, -1)], "node long, _diff long")
    got = rows(joins.delta_cull_edges(edges, d_edges, nodes, d_nodes))
    assert got == [(1, 2, -1), (1, 3, 1), (3, 1, 1)]


def test_graphs_with_cycles_and_loops(spark):
    e = pairs(spark, (1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 5), (7, 8))
    assert rows(graph.reachable(spark, e, pairs(spark, (4,), names="node long"))) == [(4,), (5,)]
    assert rows(graph.strongly_connected(spark, e)) == [(1, 2), (2, 3), (3, 1), (5, 5)]
    assert rows(graph.sources_on_targets(spark, e)) == [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 5)]
    assert rows(graph.connected_components(spark, e)) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (7, 7), (8, 7)]
    assert rows(graph.union_find(spark, e)) == [(1, 2), (1, 3), (1, 4), (1, 5), (7, 8)]
    assert rows(graph.connected_components(spark, pairs(spark, (9, 9)))) == [(9, 9)]
    labels = pairs(spark, (3, 3), (4, 1), names="node long, label long")
    assert rows(graph.propagate(spark, e, labels)) == [(1, 3), (2, 3), (3, 3), (4, 1), (5, 1)]
    long = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r["component"] for r in graph.connected_components(spark, long).collect()} == {0}


def test_loops_that_do_not_settle(spark):
    with pytest.raises(graph.NotConverged):
        fixpoint.fixpoint(spark, spark.range(1), lambda df: df.select((F.col("id") + 1).alias("id")), max_rounds=3)
    with pytest.raises(graph.NotConverged):
        fixpoint.seminaive(spark, spark.range(1), lambda df: df.select((F.col("id") + 1).alias("id")), max_rounds=3)
    assert rows(fixpoint.apply_sequenced(spark, spark.range(2), [])) == [(0,), (1,)]
    v = fixpoint.Variable(spark.range(1)).set_concat(lambda df: df.select((F.col("id") + 1).alias("id")).where("id < 4"))
    assert rows(v.run(spark)) == [(0,), (1,), (2,), (3,)]


def test_idents_survive_collisions(spark):
    clash = lambda cols, r: F.lit(r) if r < 3 else F.xxhash64(*cols)
    made = idents.discriminated_idents(spark, spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("a",)], "k string"), 1, clash)
    got = {r["k"]: r["ident"]["hash"] for r in made.collect()}
    assert len(got) == 4 and len(set(got.values())) == 4 and got["a"] == 0


def test_sinks_and_traces(spark, tmp_path):
    sink = events.EventSink(str(tmp_path / "out"))
    sink.write(spark.createDataFrame([("b",), ("a",)], "v string"), 2)
    sink.write(spark.createDataFrame([("c",)], "v string"), 1)
    sink.write(spark.createDataFrame([], "v string"), 3)
    assert [tuple(r) for r in events.extract_by_time(sink.read(spark)).orderBy("_time").collect()] == [(1, ["c"]), (2, ["a", "b"])]
    assert [r["v"] for r in events.sorted_by_time(sink.read(spark)).collect()] == ["c", "a", "b"]
    traces = TraceManager(spark)
    traces.insert_trace("t", spark.createDataFrame([(1, 1, 0), (1, -1, 1), (2, 1, 5)], "k long, _diff long, _time long"))
    with pytest.raises(KeyError):
        traces.insert_trace("t", spark.range(1))
    assert rows(traces.advance_by("t", 3)) == [(2, 1, 5)]
    assert rows(traces.distinguish_since("t")) == rows(traces.get_trace("t"))
    traces.remove_trace("t")


def test_inspection(spark, capsys):
    df, seen = inspect.inspect(spark.range(5), total=F.sum("id"))
    assert df.count() == 5 and seen.get["total"] == 10
    got = []
    inspect.inspect_aggregate(spark.range(4).withColumn("t", F.col("id") % 2), "t", lambda t, r: got.append((t, [x["id"] for x in r])), on=True)
    assert got == [(0, [0, 2]), (1, [1, 3])]
    inspect.debug(spark.range(1), "name", on=True)
    assert "name" in capsys.readouterr().out
    gone, came = inspect.diff_report(spark.range(3), spark.range(1, 5), "id")
    assert rows(gone) == [(0,)] and rows(came) == [(3,), (4,)]


def test_arrangements(spark):
    kept = exchange.arrange_by_self(spark.range(9).select((F.col("id") % 3).alias("k")))
    assert kept.is_cached and kept.count() == 9
    kept.unpersist()
    assert exchange.exchange(spark.range(9), F.col("id"), 3).rdd.getNumPartitions() == 3


def test_mutual_recursion(spark):
    numbers = spark.range(1, 6)
    start = {"even": spark.range(1), "odd": spark.range(0)}

    def step(now):
        after = {k: df.select((F.col("id") + 1).alias("id")).join(numbers, "id", "left_semi") for k, df in now.items()}
        return {"even": now["even"].union(after["odd"]).distinct(), "odd": now["odd"].union(after["even"]).distinct()}

    done = fixpoint.fixpoint_all(spark, start, step)
    assert {k: sorted(r["id"] for r in df.collect()) for k, df in done.items()} == {"even": [0, 2, 4], "odd": [1, 3, 5]}
    with pytest.raises(fixpoint.NotConverged):
        fixpoint.fixpoint_all(spark, start, step, max_rounds=2)
