"""Every operator and program query over the driver's tables, with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dagmar.functions import scalars
from dagmar.operators import aggregates, exchange, fanout, graph, idents, inspect, joins, rowwise, zset
from dagmar.plans import fixpoint
from dagmar.plans.equisat import egraph
from dagmar.plans.graph_ir import cse as graph_cse
from dagmar.plans.graph_ir import dce as graph_dce
from dagmar.plans.graph_ir import folding as graph_folding
from dagmar.plans.graph_ir import passes as graph_passes
from dagmar.plans.ir import cleanup, collect, folding, inline, loops, optimise, peephole, verify
from dagmar.plans.lineage import by_shuffles, materialise, shared_dir
from dagmar.sources import dot, events, pretty, translate
from dagmar.sources.fixtures import E_CTE, G_CTE, IR_CTE, V_CTE, Tables
from dagmar.streaming import epochs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
c, lit = F.col, F.lit


def query(sql: str | None = None):
    """Register a function of the tables, by its name, with its SQL."""

    def keep(fn: Callable[[Tables], DataFrame]):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return keep


# rows


@query("SELECT l_orderkey AS k, l_partkey * 2 AS v FROM lineitem")
def map_named(t):
    return rowwise.map_named("doubled", t.lineitem, k=c("l_orderkey"), v=c("l_partkey") * 2)


@query("SELECT l_orderkey FROM lineitem")
def keys(t):
    return rowwise.keys(t.lineitem, "l_orderkey")


@query("SELECT l_partkey AS l_orderkey, l_orderkey AS l_partkey FROM lineitem")
def reverse(t):
    return rowwise.reverse(t.lineitem.select("l_orderkey", "l_partkey"), "l_orderkey", "l_partkey")


@query(f"WITH {E_CTE} SELECT dst AS src, src AS dst FROM e")
def map_in_place(t):
    return rowwise.map_in_place(t.edges(), src=c("dst"), dst=c("src"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000")
def filter_rows(t):
    return rowwise.filter_rows(t.orders.select("o_orderkey", "o_totalprice"), c("o_totalprice") > 100000)


@query("SELECT event_id, value * 2 AS twice FROM events WHERE value > 50")
def filter_map(t):
    return rowwise.filter_map(t.events, c("value") > 50, event_id=c("event_id"), twice=c("value") * 2)


@query("SELECT user_id, event_type FROM (SELECT user_id, event_type, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events) WHERE n >= 3")
def filter_diff(t):
    return rowwise.filter_diff(t.events.select("user_id", "event_type"), lambda n: n >= 3)


@query("SELECT s_suppkey, unnest([s_nationkey, s_nationkey + 100]) AS item FROM supplier")
def flat_map(t):
    return rowwise.flat_map(t.supplier, "item", [c("s_nationkey"), c("s_nationkey") + 100], ["s_suppkey"])


@query("SELECT vec_id, unnest(embedding) AS embedding FROM embeddings")
def flatten(t):
    return rowwise.flatten(t.embeddings.select("vec_id", "embedding"), "embedding")


@query("SELECT item_id, CAST(unnest(range(len(text) % 7)) AS BIGINT) AS step FROM benchmark")
def buffered_flat_map(t):
    def steps(row, out):
        for i in range(len(row["text"]) % 7):
            out.push((row["item_id"], i))

    return rowwise.buffered_flat_map(t.benchmark, steps, "item_id bigint, step bigint")


@query(f"WITH {IR_CTE} SELECT inst_id, callee FROM ir_inst WHERE op = 'Call'")
def collect_castable(t):
    return rowwise.collect_castable(t.program().instructions, "Call", "inst_id", "callee")


@query("SELECT l_partkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS n FROM lineitem GROUP BY l_partkey HAVING sum(CAST(l_quantity AS BIGINT)) <> 0")
def explode_weighted(t):
    return aggregates.count_core(rowwise.explode_weighted(t.lineitem, c("l_quantity").cast("bigint"), "l_partkey"), "l_partkey")


# fan-out


@query("SELECT 'l' AS side, o_orderkey AS k FROM orders UNION ALL SELECT 'r', o_custkey FROM orders")
def split(t):
    left, right = fanout.split(t.orders, {"side": lit("l"), "k": c("o_orderkey")}, {"side": lit("r"), "k": c("o_custkey")})
    return zset.concat(left, right)


@query("SELECT 'l' AS side, o_orderkey AS k FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'r', o_orderkey FROM orders WHERE o_orderkey % 3 = 0")
def filter_split(t):
    left, right = fanout.filter_split(t.orders, (c("o_orderkey") % 2 == 0, {"side": lit("l"), "k": c("o_orderkey")}), (c("o_orderkey") % 3 == 0, {"side": lit("r"), "k": c("o_orderkey")}))
    return zset.concat(left, right)


@query("SELECT 'l' AS side, s_suppkey, unnest([s_nationkey, 1]) AS item FROM supplier UNION ALL SELECT 'r', s_suppkey, unnest(CASE WHEN s_nationkey > 10 THEN [s_nationkey] ELSE CAST([] AS INTEGER[]) END) FROM supplier")
def flat_split(t):
    left, right = fanout.flat_split(t.supplier, F.array(c("s_nationkey"), lit(1)), F.when(c("s_nationkey") > 10, F.array("s_nationkey")).otherwise(F.array().cast("array<int>")), keep=["s_suppkey"])
    return zset.concat(left.withColumn("side", lit("l")), right.withColumn("side", lit("r")))


@query("SELECT 0 AS part, p_partkey AS k FROM part UNION ALL SELECT 1, CAST(p_size AS BIGINT) FROM part UNION ALL SELECT 2, p_partkey + p_size FROM part")
def split_by(t):
    parts = fanout.split_by(t.part, {"k": c("p_partkey")}, {"k": c("p_size").cast("bigint")}, {"k": c("p_partkey") + c("p_size")})
    return zset.concat(*(p.withColumn("part", lit(i)) for i, p in enumerate(parts)))


@query("SELECT CAST(o_orderkey % 4 AS INTEGER) AS part, count(*) AS n FROM orders GROUP BY 1")
def partition(t):
    parts = fanout.partition(t.orders, 4, (c("o_orderkey") % 4).cast("int"))
    return zset.concat(*(p.groupBy().agg(F.count("*").alias("n")).select(lit(i).alias("part"), "n") for i, p in enumerate(parts)))


@query("SELECT o_orderkey, CAST(o_custkey % 3 AS INTEGER) AS part FROM orders")
def partition_array(t):
    parts = fanout.partition_array(t.orders, 3, (c("o_custkey") % 3).cast("int"))
    return zset.concat(*(p.select("o_orderkey", lit(i).alias("part")) for i, p in enumerate(parts)))


@query(f"WITH {IR_CTE} SELECT inst_id, CASE WHEN lhs_const IS NULL THEN 0 ELSE 1 END + CASE WHEN rhs_const IS NULL THEN 0 ELSE 2 END AS class FROM ir_inst")
def constness(t):
    return t.program().instructions.select("inst_id", fanout.constness(c("lhs_const"), c("rhs_const")).alias("class"))


@query("SELECT CASE WHEN l_linenumber < 4 THEN 'before' ELSE 'after' END AS side, count(*) AS n FROM lineitem GROUP BY 1")
def branch_when(t):
    before, after = fanout.branch_when(t.lineitem, c("l_linenumber"), 4)
    return zset.concat(before.select(lit("before").alias("side")), after.select(lit("after").alias("side"))).groupBy("side").agg(F.count("*").alias("n"))


# joins


@query("SELECT o_orderkey AS k, o_custkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def join(t):
    return joins.join(t.orders.select(c("o_orderkey").alias("k"), "o_custkey"), t.lineitem.select(c("l_orderkey").alias("k"), "l_partkey"), "k")


@query("SELECT c_custkey, o_totalprice + c_acctbal AS total FROM customer JOIN orders ON c_custkey = o_custkey")
def join_map(t):
    return joins.join_map(t.customer, t.orders.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", c_custkey=c("c_custkey"), total=c("o_totalprice") + c("c_acctbal"))


@query("SELECT l_orderkey, l_partkey, p_size FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > p_size")
def join_core(t):
    return joins.join_core(t.lineitem, t.part.withColumnRenamed("p_partkey", "l_partkey"), "l_partkey", c("l_quantity") > c("p_size"), {"l_orderkey": c("l_orderkey"), "l_partkey": c("l_partkey"), "p_size": c("p_size")})


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def semijoin(t):
    return joins.semijoin(t.customer.select("c_custkey", "c_name"), t.orders.select(c("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT c_custkey, c_name FROM customer JOIN orders ON o_custkey = c_custkey")
def semijoin_product(t):
    return joins.semijoin(t.customer.select("c_custkey", "c_name"), t.orders.select(c("o_custkey").alias("c_custkey")), "c_custkey", product=True)


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def antijoin(t):
    return joins.antijoin(t.customer.select("c_custkey", "c_name"), t.orders.select(c("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN p_retailprice * 2 ELSE p_retailprice END AS p_retailprice FROM part")
def upsert(t):
    base = t.part.select("p_partkey", "p_retailprice")
    return joins.upsert(base, t.part.where("p_size > 25").select("p_partkey", (c("p_retailprice") * 2).alias("p_retailprice")), "p_partkey")


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def default_fill(t):
    return joins.default_fill(t.customer, aggregates.count_core(t.orders.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey"), "c_custkey", n=0)


@query("SELECT a.s_nationkey, a.s_suppkey, b.s_suppkey AS other FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey")
def selfjoin_pairs(t):
    return joins.selfjoin_pairs(t.supplier, "s_nationkey", "s_suppkey")


@query("SELECT * FROM (SELECT s_suppkey, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS keep FROM supplier) WHERE s_suppkey <> keep")
def duplicates(t):
    return joins.duplicates(t.supplier, "s_nationkey", "s_suppkey")


@query(f"WITH {E_CTE} SELECT src, dst FROM e WHERE src % 3 <> 0 AND dst % 3 <> 0")
def cull_edges(t):
    e = t.edges()
    nodes = e.select(c("src").alias("node")).union(e.select("dst")).where("node % 3 <> 0")
    return joins.cull_edges(e, nodes)


@query(f"WITH {E_CTE} SELECT src, dst, CAST(CASE WHEN src % 3 <> 0 AND dst % 3 <> 0 THEN 1 ELSE -1 END AS BIGINT) AS _diff FROM e WHERE (src % 3 <> 0 AND dst % 3 <> 0) <> (src % 5 <> 0 AND dst % 5 <> 0)")
def delta_cull_edges(t):
    e = zset.lift(t.edges())
    nodes = t.edges().select(c("src").alias("node")).union(t.edges().select("dst")).distinct()
    old, new = nodes.where("node % 5 <> 0"), nodes.where("node % 3 <> 0")
    return joins.delta_cull_edges(e, e.limit(0), zset.lift(old), joins.differentiate(new, old))


@query("SELECT p_size, CAST(sum(CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END) - sum(CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS _diff FROM part GROUP BY p_size HAVING sum(CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END) <> sum(CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END)")
def differentiate(t):
    return joins.differentiate(t.part.where("p_partkey % 2 = 0").select("p_size"), t.part.where("p_partkey % 3 = 0").select("p_size")).select("p_size", c("_diff").cast("bigint").alias("_diff"))


@query("SELECT o_orderstatus, count(*) AS _diff FROM orders GROUP BY 1")
def integrate(t):
    return joins.integrate(t.spark, [zset.lift(t.orders.where(f"o_orderkey % 3 = {i}").select("o_orderstatus")) for i in range(3)])


# aggregates


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey")
def count_core(t):
    return aggregates.count_core(t.lineitem, "l_partkey")


@query("SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey")
def sum_by(t):
    return aggregates.sum_by(t.orders, "o_custkey", c("o_totalprice"), "total")


@query("SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def distinct(t):
    return aggregates.distinct(t.lineitem.select("l_orderkey", "l_linenumber"))


@query("SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def distinct_exchange(t):
    return aggregates.distinct_exchange(t.lineitem.select("l_suppkey", "l_returnflag"), c("l_suppkey") % 16)


@query("SELECT user_id, CAST(least(count(*), 2) AS BIGINT) AS _diff FROM events GROUP BY user_id")
def threshold(t):
    return aggregates.threshold(t.events.select("user_id"), lambda n: F.least(n, lit(2)))


@query("SELECT o_custkey, list(DISTINCT o_orderpriority ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY o_custkey")
def reduce_list(t):
    return aggregates.reduce_list(t.orders, "o_custkey", c("o_orderpriority"), "priorities")


@query("SELECT l_orderkey, bool_and(l_quantity > 5) AS ok FROM lineitem GROUP BY l_orderkey")
def reduce_all(t):
    return aggregates.reduce_all(t.lineitem, "l_orderkey", c("l_quantity") > 5, "ok")


@query("SELECT l_suppkey, min(l_partkey) AS least FROM lineitem GROUP BY l_suppkey")
def reduce_min(t):
    return aggregates.reduce_min(t.lineitem, "l_suppkey", "l_partkey", "least")


@query("SELECT DISTINCT least, other FROM (SELECT min(p_partkey) OVER (PARTITION BY p_brand, p_size) AS least, p_partkey AS other FROM part) WHERE least <> other")
def star_edges(t):
    return aggregates.star_edges(t.part, ["p_brand", "p_size"], "p_partkey")


@query("SELECT o_custkey, m.c AS o_totalprice, m.i AS o_orderkey FROM (SELECT o_custkey, min({'c': o_totalprice, 'i': o_orderkey}) AS m FROM orders GROUP BY o_custkey)")
def reduce_argmin(t):
    return aggregates.argmin(t.orders, "o_custkey", "o_totalprice", "o_orderkey")


@query("SELECT l_orderkey, min(CASE WHEN l_linenumber = 1 THEN l_partkey END) AS lhs, min(CASE WHEN l_linenumber = 2 THEN l_partkey END) AS rhs FROM lineitem WHERE l_linenumber <= 2 GROUP BY l_orderkey")
def pivot_lr(t):
    rows = t.lineitem.where("l_linenumber <= 2").withColumn("side", F.when(c("l_linenumber") == 1, "Left").otherwise("Right"))
    return aggregates.pivot_sides(rows, "l_orderkey", "side", "l_partkey")


@query(f"WITH {V_CTE} SELECT src, min(dst) AS dst FROM v_value GROUP BY src HAVING count(DISTINCT dst) = 1 AND count(*) = 2")
def all_equal(t):
    return aggregates.all_equal(t.graph().value_edges, "src", "dst")


@query("SELECT l_partkey, max(l_quantity) AS l_quantity FROM lineitem GROUP BY l_partkey")
def max_diff(t):
    return aggregates.max_diff(t.lineitem, "l_partkey", "l_quantity")


@query("SELECT l_partkey, min(l_quantity) AS l_quantity FROM lineitem GROUP BY l_partkey")
def min_diff(t):
    return aggregates.min_diff(t.lineitem, "l_partkey", "l_quantity")


_HOPS = f"WITH {E_CTE}, w AS (SELECT src, dst, src % 17 AS w FROM e)"


def _hops(t):
    left = t.edges().select("src", c("dst").alias("mid"), (c("src") % 17).alias("w"))
    right = t.edges().select(c("src").alias("mid"), "dst", (c("src") % 17).alias("w"))
    return left, right


@query(f"{_HOPS} SELECT a.src, b.dst, min(a.w + b.w) AS w FROM w a JOIN w b ON a.dst = b.src GROUP BY a.src, b.dst")
def minplus_join(t):
    return aggregates.minplus_join(*_hops(t), "mid", ["src", "dst"], "w")


@query(f"{_HOPS} SELECT a.src, b.dst, max(a.w + b.w) AS w FROM w a JOIN w b ON a.dst = b.src GROUP BY a.src, b.dst")
def maxplus_join(t):
    return aggregates.maxplus_join(*_hops(t), "mid", ["src", "dst"], "w")


@query("SELECT p_partkey, p_size FROM part WHERE p_partkey % 3 - 1 >= 1")
def scale_extremum(t):
    return aggregates.scale_extremum(t.part.select("p_partkey", "p_size"), "p_size", c("p_partkey") % 3 - 1)


# Z-sets and sets


@query("SELECT user_id, CAST(sum(CASE WHEN value < 20 THEN -1 ELSE 1 END) AS BIGINT) AS _diff FROM events GROUP BY user_id HAVING sum(CASE WHEN value < 20 THEN -1 ELSE 1 END) <> 0")
def consolidate(t):
    return zset.consolidate(t.events.select("user_id", F.when(c("value") < 20, lit(-1)).otherwise(1).cast("bigint").alias("_diff")))


@query("SELECT n AS k, CAST(sum(d) AS BIGINT) AS _diff FROM (SELECT c_nationkey AS n, 1 AS d FROM customer UNION ALL SELECT s_nationkey, -1 FROM supplier) GROUP BY n HAVING sum(d) <> 0")
def zset_negate(t):
    a, b = t.customer.select(c("c_nationkey").alias("k")), t.supplier.select(c("s_nationkey").alias("k"))
    return zset.subtract(zset.lift(a), zset.lift(b))


@query("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def except_all(t):
    return zset.subtract(t.customer.select(c("c_nationkey").alias("k")), t.supplier.select(c("s_nationkey").alias("k")))


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier UNION ALL SELECT n_nationkey FROM nation")
def concat(t):
    return zset.concatenate([t.customer.select(c("c_nationkey").alias("k")), t.supplier.select(c("s_nationkey").alias("k")), t.nation.select(c("n_nationkey").alias("k"))])


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(t):
    return zset.union_distinct(t.customer.select(c("c_nationkey").alias("k")), t.supplier.select(c("s_nationkey").alias("k")))


@query("SELECT r_regionkey, unnest(range(r_regionkey)) IS NOT NULL AS there FROM region")
def to_bag(t):
    return zset.to_bag(t.region.where("r_regionkey > 0").select("r_regionkey", c("r_regionkey").cast("bigint").alias("_diff"))).select("r_regionkey", lit(True).alias("there"))


@query("SELECT 0 AS differing_rows")
def assert_eq(t):
    a = t.orders.select("o_orderkey", "o_custkey")
    return zset.differences(a, a.repartition(7)).groupBy().agg(F.count("*").cast("int").alias("differing_rows"))


# layout, ids, inspection


@query("SELECT o_orderkey, o_custkey FROM orders")
def exchange_rows(t):
    return exchange.exchange(t.orders.select("o_orderkey", "o_custkey"), c("o_custkey") % 16)


@query("SELECT l_orderkey, l_partkey FROM lineitem")
def arrange_by_key(t):
    return exchange.as_collection(exchange.arrange_by_key_pipelined(t.lineitem.select("l_orderkey", "l_partkey"), "l_orderkey"))


@query("SELECT count(*) AS records, count(*) AS idents FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)")
def discriminated_idents(t):
    made = idents.discriminated_idents(t.spark, t.lineitem.select("l_partkey", "l_suppkey"), 7)
    return made.groupBy().agg(F.count("*").alias("records"), F.count_distinct("ident").alias("idents"))


@query("SELECT n_nationkey, '0x07' || CASE WHEN length(hex(n_nationkey)) < 8 THEN lpad(hex(n_nationkey), 8, '0') ELSE hex(n_nationkey) END AS ident FROM nation")
def show_ident(t):
    return t.nation.select("n_nationkey", idents.show_ident(F.struct(lit(7).cast("short").alias("discriminant"), c("n_nationkey").cast("bigint").alias("hash"))).alias("ident"))


@query("SELECT n_nationkey, n_name FROM nation")
def inspect_rows(t):
    return inspect.inspect(t.nation.select("n_nationkey", "n_name"), rows=F.count(lit(1)))[0]


@query("SELECT CAST(ts AS DATE) AS day, list(event_id ORDER BY event_id) AS data FROM events GROUP BY 1")
def extract_by_time(t):
    return events.extract_by_time(t.events.select(c("ts").cast("date").alias("day"), "event_id"), "day")


# recursion and graphs


@query(f"WITH RECURSIVE {E_CTE}, r AS (SELECT CAST(1 AS BIGINT) AS node UNION SELECT e.dst FROM r JOIN e ON r.node = e.src) SELECT node FROM r")
def reachable(t):
    return graph.reachable(t.spark, t.edges(), t.spark.range(1, 2).select(c("id").alias("node")))


_LABELS = f"WITH RECURSIVE {E_CTE}, l AS (SELECT DISTINCT src AS node, src AS label FROM e UNION SELECT e.dst, l.label FROM l JOIN e ON l.node = e.src)"


@query(f"{_LABELS} SELECT node, min(label) AS label FROM l GROUP BY node")
def propagate_min(t):
    e = t.edges()
    return graph.propagate(t.spark, e, e.select(c("src").alias("node"), c("src").alias("label")))


_CC = f"WITH RECURSIVE {E_CTE}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), l AS (SELECT src AS node, src AS label FROM u UNION SELECT u.dst, l.label FROM l JOIN u ON l.node = u.src), cc AS (SELECT node, min(label) AS component FROM l GROUP BY node)"


@query(f"{_CC} SELECT node, component FROM cc")
def connected_components(t):
    return graph.connected_components(t.spark, t.edges())


@query(f"{_CC} SELECT component AS root, node AS joined FROM cc WHERE node <> component")
def union_find(t):
    return graph.union_find(t.spark, t.edges())


_CLOSURE = f"WITH RECURSIVE {E_CTE}, p AS (SELECT src, dst FROM e UNION SELECT p.src, e.dst FROM p JOIN e ON p.dst = e.src)"


@query(f"{_CLOSURE} SELECT e.src, e.dst FROM e JOIN p ON p.src = e.dst AND p.dst = e.src")
def scc_edges(t):
    return graph.strongly_connected(t.spark, t.edges())


@query(f"{_CLOSURE}, cyc AS (SELECT src AS node FROM p WHERE src = dst), fed AS (SELECT node FROM cyc UNION SELECT p.dst FROM p JOIN cyc ON p.src = cyc.node) SELECT e.src, e.dst FROM e JOIN fed ON e.src = fed.node")
def loop_edges(t):
    return graph.sources_on_targets(t.spark, t.edges())


@query("WITH RECURSIVE b AS (SELECT n_nationkey + 1 AS x, 0 AS d FROM nation UNION ALL SELECT x + 1, d + 1 FROM b WHERE d < 3) SELECT x FROM b")
def bounded_loop(t):
    return fixpoint.bounded_loop(t.spark, t.nation.select(c("n_nationkey").alias("x")), lambda df: df.select((c("x") + 1).alias("x")), 3)


@query("SELECT CASE WHEN s_suppkey < 40 THEN 40 ELSE s_suppkey - s_suppkey % 2 END AS x FROM supplier")
def apply_sequenced(t):
    steps = [lambda df: df.select(F.when(c("x") < 40, F.least(c("x") + 16, lit(40))).otherwise(c("x")).alias("x")), lambda df: df.select((c("x") - F.when(c("x") >= 40, c("x") % 2).otherwise(0)).alias("x"))]
    return fixpoint.apply_sequenced(t.spark, t.supplier.select(c("s_suppkey").alias("x")), steps)


@query(f"WITH RECURSIVE {E_CTE}, r AS (SELECT src AS node FROM e WHERE src < 5 UNION SELECT e.dst FROM r JOIN e ON r.node = e.src) SELECT node FROM r")
def iterate(t):
    e = t.edges()
    start = e.where("src < 5").select(c("src").alias("node"))
    steps = e.select(c("src").alias("node"), "dst")
    return fixpoint.Variable(start).set(lambda now: now.union(now.join(steps, "node").select("dst")).distinct()).run(t.spark)


# block IR


_USES = f"WITH {IR_CTE}, uses AS (SELECT lhs_var AS var, lhs_ty AS ty, inst_id FROM ir_inst WHERE lhs_var IS NOT NULL UNION ALL SELECT rhs_var, rhs_ty, inst_id FROM ir_inst WHERE rhs_var IS NOT NULL)"
_NO = "CAST(NULL AS BIGINT)"


@query(f"{_USES} SELECT var, ty, inst_id FROM uses")
def collect_usages(t):
    return collect.collect_usages(t.program().instructions)


@query(f"WITH {IR_CTE} SELECT dest AS var, dest_ty AS ty, inst_id FROM ir_inst")
def collect_declarations(t):
    return collect.collect_declarations(t.program().instructions)


@query(f"WITH {IR_CTE} SELECT dest AS var, dest_ty AS ty FROM ir_inst")
def collect_var_types(t):
    return collect.collect_var_types(t.program().instructions)


@query(f"{_USES} SELECT inst_id, var, {_NO} AS const, ty FROM uses UNION ALL SELECT inst_id, NULL, lhs_const, lhs_ty FROM ir_inst WHERE lhs_const IS NOT NULL UNION ALL SELECT inst_id, NULL, rhs_const, rhs_ty FROM ir_inst WHERE rhs_const IS NOT NULL")
def collect_values(t):
    return collect.collect_values(t.program().instructions).withColumn("const", c("const").cast("bigint"))


_UNDECLARED_VAR = f"SELECT 'UndeclaredVariable' AS error, inst_id, {_NO} AS block_id, var, CAST(NULL AS VARCHAR) AS expected, ty AS found FROM uses WHERE NOT EXISTS (SELECT 1 FROM ir_inst d WHERE d.dest = var AND d.dest_ty = ty)"
_UNDECLARED_BLOCK = f"SELECT DISTINCT 'UndeclaredBlock' AS error, {_NO} AS inst_id, block_id, target AS var, CAST(NULL AS VARCHAR) AS expected, CAST(NULL AS VARCHAR) AS found FROM (SELECT block_id, unnest([t1, t2]) AS target FROM ir_term) WHERE target IS NOT NULL AND target NOT IN (SELECT block_id FROM ir_blocks)"
_MISMATCH = f"""SELECT 'VariableTypeMismatch' AS error, inst_id, {_NO} AS block_id, dest AS var, lhs_ty AS expected, rhs_ty AS found FROM ir_inst WHERE op IN ('Add', 'Sub', 'Mul', 'Div') AND lhs_ty <> rhs_ty
UNION ALL SELECT 'VariableTypeMismatch', inst_id, NULL, dest, dest_ty, lhs_ty FROM ir_inst WHERE op IN ('Add', 'Sub', 'Mul', 'Div', 'Assign', 'Neg') AND dest_ty <> lhs_ty
UNION ALL SELECT 'VariableTypeMismatch', u.inst_id, NULL, u.var, d.dest_ty, u.ty FROM uses u JOIN ir_inst d ON d.dest = u.var WHERE d.dest_ty <> u.ty"""


@query(f"{_USES} {_UNDECLARED_VAR}")
def verify_undeclared_variable(t):
    return verify.undeclared_variables(t.program())


def _with_copies(p):
    """Every 50th instruction a second time under another id, so that there is something to find."""
    from dataclasses import replace

    extra = p.instructions.where("inst_id % 50 = 0").withColumn("inst_id", c("inst_id") + 10_000_000)
    return replace(p, instructions=p.instructions.unionByName(extra))


@query(f"WITH {IR_CTE} SELECT 'Redeclaration' AS error, inst_id + i.x AS inst_id, {_NO} AS block_id, dest AS var, CAST(NULL AS VARCHAR) AS expected, dest_ty AS found FROM ir_inst CROSS JOIN (VALUES (0), (10000000)) AS i(x) WHERE inst_id % 50 = 0")
def verify_redeclaration(t):
    return verify.redeclarations(_with_copies(t.program()))


@query(f"WITH {IR_CTE} {_UNDECLARED_BLOCK}")
def verify_undeclared_block(t):
    return verify.undeclared_blocks(t.program())


@query(f"WITH {IR_CTE}, o AS (SELECT block_id, CASE WHEN block_id % 10 = 0 THEN 0 ELSE func_id END AS f FROM ir_blocks), j AS (SELECT DISTINCT block_id, unnest([t1, t2]) AS target FROM ir_term) SELECT 'CrossFunctionJump' AS error, {_NO} AS inst_id, j.block_id, j.target AS var, CAST(a.f AS VARCHAR) AS expected, CAST(b.f AS VARCHAR) AS found FROM j JOIN o a ON a.block_id = j.block_id JOIN o b ON b.block_id = j.target WHERE a.f <> b.f")
def verify_cross_function_jump(t):
    from dataclasses import replace

    p = t.program()
    return verify.cross_function_jumps(replace(p, function_blocks=p.function_blocks.withColumn("func_id", F.when(c("block_id") % 10 == 0, lit(0).cast("bigint")).otherwise(c("func_id")))))


@query(f"{_USES} {_MISMATCH}")
def verify_type_mismatch(t):
    return verify.type_mismatches(t.program())


@query(f"WITH {IR_CTE} SELECT 'InvalidBitcast' AS error, inst_id, {_NO} AS block_id, dest AS var, 'unit' AS expected, lhs_ty AS found FROM ir_inst WHERE op = 'Assign' AND inst_id % 20 = 1")
def verify_invalid_bitcast(t):
    from dataclasses import replace

    p = t.program()
    hit = c("inst_id") % 20 == 1
    casts = p.instructions.where("op = 'Assign'").withColumn("op", lit("Bitcast")).withColumn("dest_ty", F.when(hit, "unit").otherwise(c("dest_ty")))
    return verify.invalid_bitcasts(replace(p, instructions=casts))


@query(f"WITH {IR_CTE} SELECT 'ConstantTypeMismatch' AS error, inst_id, {_NO} AS block_id, {_NO} AS var, 'uint' AS expected, CAST(lhs_const - 5 AS VARCHAR) AS found FROM ir_inst WHERE lhs_const < 5")
def verify_constant_type_mismatch(t):
    from dataclasses import replace

    p = t.program()
    odd = p.instructions.withColumn("lhs_const", (c("lhs_const") - 5).cast(scalars.NUMBER)).withColumn("lhs_ty", F.when(c("lhs_const").isNotNull(), "uint").otherwise(c("lhs_ty")))
    return verify.constant_type_mismatches(replace(p, instructions=odd))


@query(f"{_USES} SELECT DISTINCT * FROM ({_UNDECLARED_VAR} UNION ALL {_UNDECLARED_BLOCK} UNION ALL {_MISMATCH})")
def verify_all(t):
    return verify.verify(t.program())


_SLIM = ["inst_id", "op", "lhs_var", "lhs_const", "rhs_var", "rhs_const"]


def _slim(df):
    return df.select(*(c(x).cast("bigint").alias(x) if x.endswith("const") else c(x) for x in _SLIM))


_EVAL = f"""WITH {IR_CTE}, k AS (SELECT dest, lhs_const AS v FROM ir_inst WHERE op = 'Assign' AND lhs_const IS NOT NULL),
x AS (SELECT i.*, coalesce(i.lhs_const, a.v) AS l, coalesce(i.rhs_const, b.v) AS r FROM ir_inst i LEFT JOIN k a ON a.dest = i.lhs_var LEFT JOIN k b ON b.dest = i.rhs_var),
y AS (SELECT *, CASE WHEN CASE WHEN lhs_var IS NULL THEN lhs_ty ELSE 'int' END = CASE WHEN rhs_var IS NULL THEN rhs_ty ELSE 'int' END THEN CASE op WHEN 'Add' THEN l + r WHEN 'Sub' THEN l - r WHEN 'Mul' THEN l * r END END AS value FROM x),
ev AS (SELECT inst_id, dest, CASE WHEN value IS NULL THEN op ELSE 'Assign' END AS op, CASE WHEN value IS NULL THEN lhs_var END AS lhs_var, CASE WHEN value IS NULL THEN lhs_const ELSE value END AS lhs_const,
       CASE WHEN value IS NULL THEN rhs_var END AS rhs_var, CASE WHEN value IS NULL THEN rhs_const END AS rhs_const FROM y)"""


@query(f"{_EVAL} SELECT inst_id, op, lhs_var, lhs_const, rhs_var, rhs_const FROM ev")
def evaluate_binary_ops(t):
    return _slim(folding.evaluate_binary_ops(t.program().instructions))


_PROMOTE = """k2 AS (SELECT dest, lhs_const AS v FROM ev WHERE op = 'Assign' AND lhs_const IS NOT NULL),
pr AS (SELECT inst_id, dest, op, CASE WHEN a.v IS NULL THEN lhs_var END AS lhs_var, coalesce(lhs_const, a.v) AS lhs_const, CASE WHEN b.v IS NULL THEN rhs_var END AS rhs_var, coalesce(rhs_const, b.v) AS rhs_const
       FROM ev LEFT JOIN (SELECT dest AS d1, v FROM k2) a ON a.d1 = lhs_var LEFT JOIN (SELECT dest AS d2, v FROM k2) b ON b.d2 = rhs_var)"""


@query(f"{_EVAL}, {_PROMOTE} SELECT inst_id, op, lhs_var, lhs_const, rhs_var, rhs_const FROM pr")
def constant_folding_round(t):
    return _slim(folding.constant_folding_round(t.program()).instructions)


@query(f"WITH {IR_CTE}, k AS (SELECT dest, lhs_const AS v FROM ir_inst WHERE op = 'Assign' AND lhs_const IS NOT NULL) SELECT inst_id, op, CASE WHEN a.v IS NULL THEN lhs_var END AS lhs_var, coalesce(lhs_const, a.v) AS lhs_const, CASE WHEN b.v IS NULL THEN rhs_var END AS rhs_var, coalesce(rhs_const, b.v) AS rhs_const FROM ir_inst LEFT JOIN (SELECT dest AS d1, v FROM k) a ON a.d1 = lhs_var LEFT JOIN (SELECT dest AS d2, v FROM k) b ON b.d2 = rhs_var")
def promote_constants(t):
    return _slim(folding.promote_constants(t.program().instructions))


_FOLDED_TERM = "ft AS (SELECT block_id, CASE WHEN kind = 'Branch' THEN 'Jump' ELSE kind END AS kind, CASE WHEN kind = 'Branch' AND NOT cond_const THEN t2 ELSE t1 END AS t1, ret_var FROM ir_term)"


@query(f"WITH {IR_CTE}, {_FOLDED_TERM} SELECT block_id, kind, t1, CAST(NULL AS BIGINT) AS t2, ret_var FROM ft")
def fold_terminators(t):
    p = t.program()
    return folding.fold_terminators(p.terminators, p.instructions).select("block_id", "kind", "t1", "t2", "ret_var")


_VALUES = f"""WITH {IR_CTE}, v AS (SELECT block_id, max(CASE WHEN pos = 0 THEN lhs_const END) + max(CASE WHEN pos = 1 THEN lhs_const END) AS s FROM ir_inst GROUP BY block_id)"""


@query(f"{_VALUES} SELECT inst_id, CASE WHEN op = 'Call' THEN 'Call' ELSE 'Assign' END AS op, CASE pos WHEN 0 THEN lhs_const WHEN 1 THEN lhs_const WHEN 2 THEN s WHEN 3 THEN 0 WHEN 4 THEN s WHEN 5 THEN s ELSE 2 * s END AS value FROM ir_inst JOIN v USING (block_id)")
def constant_folding(t):
    """To the fixpoint; types are as the literals' in this fixture."""
    from dataclasses import replace

    p = t.program_tables()
    ints = p.instructions.withColumns({x: F.when(c(x).isNotNull(), "int") for x in ("dest_ty", "lhs_ty", "rhs_ty")})
    done = folding.constant_folding(t.spark, replace(p, instructions=ints))
    return done.instructions.select("inst_id", "op", c("lhs_const").cast("bigint").alias("value"))


@query(f"WITH {IR_CTE}, cp AS (SELECT dest, lhs_var FROM ir_inst WHERE op = 'Assign' AND lhs_var IS NOT NULL) SELECT inst_id, op, coalesce(a.lhs_var, i.lhs_var) AS lhs_var, lhs_const, coalesce(b.lhs_var, i.rhs_var) AS rhs_var, rhs_const FROM ir_inst i LEFT JOIN cp a ON a.dest = i.lhs_var LEFT JOIN cp b ON b.dest = i.rhs_var WHERE i.dest NOT IN (SELECT dest FROM cp)")
def eliminate_copies(t):
    return _slim(folding.eliminate_copies(t.spark, t.program_tables()).instructions)


@query(f"WITH {IR_CTE} SELECT inst_id, CASE WHEN op IN ('Mul', 'Sub') THEN 'Assign' ELSE op END AS op, CASE WHEN op <> 'Mul' THEN lhs_var END AS lhs_var, CASE WHEN op = 'Mul' THEN 0 ELSE lhs_const END AS lhs_const, rhs_var, {_NO} AS rhs_const FROM ir_inst")
def peephole_pass(t):
    return _slim(peephole.peephole(t.program().instructions))


def _folded(t):
    from dataclasses import replace

    p = t.program_tables()
    return replace(p, terminators=folding.fold_terminators(p.terminators, p.instructions))


_REACH = f"WITH RECURSIVE {IR_CTE}, {_FOLDED_TERM}, r AS (SELECT (func_id - 1) * 4 + 1 AS block_id FROM ir_blocks UNION SELECT ft.t1 FROM r JOIN ft ON ft.block_id = r.block_id WHERE ft.t1 IS NOT NULL), rb AS (SELECT block_id FROM r WHERE block_id IN (SELECT block_id FROM ir_blocks))"


@query(f"{_REACH} SELECT block_id, count(inst_id) AS n FROM rb JOIN ir_inst USING (block_id) GROUP BY block_id")
def cull_unreachable(t):
    p = cleanup.cull_unreachable_blocks(t.spark, _folded(t))
    return p.blocks.select("block_id").join(by_shuffles(p.block_instructions), "block_id").groupBy("block_id").agg(F.count("*").alias("n"))


@query(f"{_REACH}, m AS (SELECT b.func_id, b.block_id, max(b.block_id) OVER (PARTITION BY b.func_id) AS last FROM rb JOIN ir_blocks b USING (block_id)) SELECT i.inst_id, m.last AS block_id, CAST(row_number() OVER (PARTITION BY m.last ORDER BY m.block_id, i.pos) - 1 AS BIGINT) AS pos FROM m JOIN ir_inst i ON i.block_id = m.block_id")
def compact_blocks(t):
    p = cleanup.cull_unreachable_blocks(t.spark, _folded(t)).written(t.spark)
    return cleanup.compact_basic_blocks(t.spark, p).block_instructions


@query(f"WITH RECURSIVE {IR_CTE}, uses AS (SELECT inst_id, lhs_var AS var FROM ir_inst WHERE lhs_var IS NOT NULL UNION SELECT inst_id, rhs_var FROM ir_inst WHERE rhs_var IS NOT NULL), live AS (SELECT inst_id FROM ir_inst WHERE op = 'Call' OR dest IN (SELECT ret_var FROM ir_term) UNION SELECT d.inst_id FROM live JOIN uses ON uses.inst_id = live.inst_id JOIN ir_inst d ON d.dest = uses.var) SELECT inst_id FROM live")
def live_instructions(t):
    return cleanup.live_instructions(t.spark, t.program_tables())


@query(f"{_REACH.replace('rb AS', 'uses AS (SELECT inst_id, lhs_var AS var FROM ir_inst WHERE lhs_var IS NOT NULL UNION SELECT inst_id, rhs_var FROM ir_inst WHERE rhs_var IS NOT NULL), live AS (SELECT inst_id FROM ir_inst UNION ALL SELECT inst_id FROM ir_inst WHERE false), rb AS', 1)} SELECT i.inst_id, i.block_id FROM ir_inst i JOIN rb USING (block_id) WHERE i.pos <> 3")
def cleanup_program(t):
    """In this fixture all but the multiplications is live, block by block."""
    return cleanup.cleanup(t.spark, _folded(t)).block_instructions.select("inst_id", "block_id")


@query(f"WITH {IR_CTE}, ends AS (SELECT block_id, CASE WHEN block_id % 8 = 3 THEN block_id - 2 ELSE t1 END AS t1, t2 FROM ir_term), jumps AS (SELECT block_id AS src, unnest([t1, t2]) AS dst FROM ends) SELECT src, dst FROM jumps WHERE dst IS NOT NULL AND (src - 1) % 8 < 4 AND src - (src - 1) % 8 + 2 IN (SELECT block_id FROM ir_blocks)")
def program_loops(t):
    """The fixture's programs, with a jump from every second function's third block back to its first: block 1 to 2 or 3, 2 to 4, 3 to 1."""
    from dataclasses import replace

    p = t.program()
    back = p.terminators.withColumn("t1", F.when(c("block_id") % 8 == 3, c("block_id") - 2).otherwise(c("t1")))
    return loops.loops(t.spark, replace(p, terminators=back))


@query()
def ir_optimise(t):
    """The block IR's optimisation loop over the whole fixture: what is left of it, in place. Beyond SQL."""
    p = optimise.optimise(t.spark, t.program())
    return p.block_instructions.join(p.instructions.select("inst_id", "op", "dest", "callee"), "inst_id")


_HEUR = f"""WITH {IR_CTE}, loc AS (SELECT i.*, b.func_id FROM ir_inst i JOIN ir_blocks b USING (block_id)),
a AS (SELECT func_id, count(*) AS ssa_inst_length, count(*) FILTER (op = 'Call') AS function_calls, bool_and(op <> 'Call') AS is_pure, coalesce(bool_or(callee = func_id), false) AS is_recursive, sum(CASE op WHEN 'Call' THEN 5 ELSE 1 END) AS asm FROM loc GROUP BY func_id),
b AS (SELECT func_id, count(*) AS block_length, count(*) FILTER (kind = 'Branch') AS branches, count(*) AS ends FROM ir_blocks JOIN ir_term USING (block_id) GROUP BY func_id),
v AS (SELECT callee AS func_id, count(*) AS invocations FROM ir_inst WHERE op = 'Call' GROUP BY callee),
h0 AS (SELECT func_id, branches, coalesce(invocations, 0) AS invocations, block_length, ssa_inst_length, function_calls, is_pure, is_recursive, CAST(asm + ends AS BIGINT) AS estimated_asm FROM a JOIN b USING (func_id) LEFT JOIN v USING (func_id)),
h AS (SELECT *, (estimated_asm + branches * 1.2::DOUBLE + function_calls * 1.4::DOUBLE) * CASE WHEN is_pure THEN 0.6::DOUBLE ELSE 1 END * CASE WHEN is_recursive THEN 1.3::DOUBLE ELSE 1 END AS inline_cost FROM h0)"""


@query(f"{_HEUR} SELECT * FROM h")
def inline_heuristics(t):
    return inline.harvest_heuristics(t.program())


@query(f"{_HEUR} SELECT func_id, inline_cost FROM h WHERE inline_cost <= 60")
def trivially_inlinable(t):
    return inline.trivially_inlinable(inline.harvest_heuristics(t.program()), 60.0).select("func_id", "inline_cost")


@query(f"{_HEUR} SELECT inst_id, block_id, func_id, callee FROM loc WHERE op = 'Call' AND callee IN (SELECT func_id FROM h WHERE inline_cost <= 100 AND NOT is_recursive)")
def inline_call_sites(t):
    return inline.early_inline(t.program())


@query(f"WITH {IR_CTE} SELECT b.func_id, string_agg(i.op, ',' ORDER BY i.block_id, i.pos) AS ops FROM ir_inst i JOIN ir_blocks b USING (block_id) GROUP BY b.func_id")
def reconstruct(t):
    nested = translate.reconstruct(t.program())
    ops = F.flatten(F.transform("basic_blocks", lambda b: F.transform(b["instructions"], lambda i: i["op"])))
    return nested.select("func_id", F.array_join(ops, ",").alias("ops"))


@query(f"WITH {IR_CTE} SELECT inst_id, block_id, pos FROM ir_inst")
def translate_nested(t):
    return translate.translate(translate.reconstruct(t.program())).block_instructions


@query(f"""WITH {IR_CTE}, x AS (SELECT *, CASE WHEN lhs_var IS NOT NULL THEN lhs_ty || ' _' || lhs_var ELSE lhs_ty || ' ' || lhs_const END AS l, CASE WHEN rhs_var IS NOT NULL THEN rhs_ty || ' _' || rhs_var ELSE rhs_ty || ' ' || rhs_const END AS r FROM ir_inst)
SELECT inst_id, '_' || dest || ' := ' || CASE op WHEN 'Assign' THEN l WHEN 'Call' THEN 'call @fn_' || callee || '()' ELSE lower(op) || ' ' || l || ', ' || r END AS text FROM x""")
def pretty_instructions(t):
    return t.program().instructions.select("inst_id", pretty.instruction_text().alias("text"))


@query()
def pretty_functions(t):
    return pretty.function_texts(t.program())


# graph IR


@query(f"WITH RECURSIVE {V_CTE}, r AS (SELECT node_id FROM v_nodes WHERE kind = 'End' UNION SELECT v_edges.dst FROM r JOIN v_edges ON v_edges.src = r.node_id) SELECT node_id, kind FROM v_nodes JOIN r USING (node_id)")
def vsdg_dce(t):
    return graph_dce.dce(t.spark, t.graph_tables()).nodes.select("node_id", "kind")


@query(f"WITH {V_CTE} SELECT src, CASE WHEN dst % 8 = 2 AND src % 8 = 3 THEN dst ELSE dst END AS dst FROM v_value WHERE src % 8 <> 3 OR dst % 8 = 2 UNION ALL SELECT src, dst - 7 FROM v_value WHERE src % 8 = 3 AND dst % 8 = 7")
def vsdg_remove_places(t):
    """Node 7 stands in as a place in front of node 0."""
    from dataclasses import replace

    g = t.graph_tables()
    place = (c("node_id") % 8 == 7) & ((c("node_id") - 7) / 8 % 2 == 1)
    extra = g.nodes.where(place).select(c("node_id").alias("src"), (c("node_id") - 7).alias("dst"))
    g = replace(g, nodes=g.nodes.withColumn("kind", F.when(place, "Place").otherwise(c("kind"))), value_edges=g.value_edges.unionByName(extra))
    return graph_dce.remove_places(g.written(t.spark)).value_edges


@query(f"WITH {V_CTE} SELECT p_partkey * 8 + 2 AS node, p_partkey * 8 + 1 AS other FROM part WHERE p_size % 4 = 0 UNION ALL SELECT p_partkey * 8 + 3, p_partkey * 8 + CASE WHEN p_size % 4 = 0 THEN 1 ELSE 2 END FROM part WHERE p_partkey % 2 = 1 AND p_size % 4 = 0")
def vsdg_zero_add(t):
    return graph_folding.zero_additions(t.spark, t.graph_tables())


@query(f"WITH {V_CTE} SELECT node_id FROM v_nodes WHERE kind = 'Sub' AND lhs = rhs")
def vsdg_self_sub(t):
    return graph_folding.self_subtractions(t.graph())


@query(f"WITH {V_CTE} SELECT node_id, CASE WHEN kind = 'Sub' THEN 'Constant' ELSE kind END AS kind, CASE WHEN kind = 'Sub' THEN 0 ELSE u8 END AS u8 FROM v_nodes")
def vsdg_fold(t):
    return graph_folding.constant_folding(t.spark, t.graph_tables()).nodes.select("node_id", "kind", "u8")


@query("SELECT p_partkey AS node_id, CASE p_partkey % 4 WHEN 0 THEN (p_size + 200) % 256 WHEN 1 THEN (p_size + 56) % 256 WHEN 2 THEN p_size * 200 % 256 END AS u8, CASE WHEN p_partkey % 4 = 3 THEN p_size < 200 END AS b FROM part")
def vsdg_evaluate(t):
    """Byte arithmetic wraps: x + 200, x - 200, x * 200 and x < 200."""
    kind = F.element_at(F.array(*map(lit, ("Add", "Sub", "Mul", "Cmp"))), (c("p_partkey") % 4 + 1).cast("int"))
    x, y = c("p_size"), lit(200)
    return t.part.select(c("p_partkey").alias("node_id"), scalars.wrap_u8(kind, x, y).alias("u8"), F.when(kind == "Cmp", scalars.compare(lit("<"), x, y)).alias("b"))


@query("SELECT p_partkey * 8 + 7 AS node, p_partkey * 8 AS other FROM part WHERE p_partkey % 2 = 1")
def vsdg_cse(t):
    return graph_cse.equal_constants(t.spark, t.graph_tables())


@query(f"WITH RECURSIVE {V_CTE}, r AS (SELECT node_id AS end_id, node_id FROM v_nodes WHERE kind = 'End' UNION SELECT r.end_id, v_edges.dst FROM r JOIN v_edges ON v_edges.src = r.node_id) SELECT end_id, CAST(sum(CASE WHEN kind IN ('Add', 'Sub', 'Mul', 'Return') THEN 1 ELSE 0 END) AS BIGINT) AS cost FROM r JOIN v_nodes USING (node_id) GROUP BY end_id")
def vsdg_inline_cost(t):
    return graph_passes.trivial_inline(t.spark, t.graph_tables())


@query(f"WITH {V_CTE} SELECT node_id // 8 AS func_id, node_id AS end_id FROM v_nodes WHERE kind = 'End'")
def vsdg_function_ends(t):
    return t.graph().function_ends()


@query(f"WITH {V_CTE} SELECT src, dst FROM v_edges")
def vsdg_all_edges(t):
    return t.graph().all_edges()


@query(f"{_CLOSURE} SELECT e.src, e.dst FROM e JOIN p ON p.src = e.dst AND p.dst = e.src")
def vsdg_loops(t):
    from dataclasses import replace

    return graph_passes.detect_loops(t.spark, replace(t.graph(), control_edges=t.edges()))


@query(f"WITH RECURSIVE {V_CTE}, z AS (SELECT p_partkey AS k, p_partkey % 2 = 0 AS even, p_size % 4 = 0 AS zero FROM part), alive AS (SELECT k * 8 + unnest(CASE WHEN even THEN [3, 4, 5] WHEN zero THEN [1, 4, 5] ELSE [0, 1, 2, 3, 4, 5, 7] END) AS node_id FROM z) SELECT node_id, CASE WHEN kind = 'Sub' THEN 'Constant' ELSE kind END AS kind FROM v_nodes JOIN alive USING (node_id)")
def vsdg_optimise(t):
    return graph_passes.optimise(t.spark, t.graph_tables()).nodes.select("node_id", "kind")


@query(f"WITH {V_CTE} SELECT 'nodes' AS relation, count(*) AS n FROM v_nodes UNION ALL SELECT 'value_edges', count(*) FROM v_value UNION ALL SELECT 'control_edges', count(*) FROM v_control UNION ALL SELECT 'function_nodes', count(*) FROM v_nodes UNION ALL SELECT 'functions', count(*) FROM part")
def vsdg_tagged(t):
    return t.graph().tagged().groupBy("relation").agg(F.sum("_diff").alias("n"))


@query(f"WITH {V_CTE} SELECT 1 AS part, '    ' || src || ' -> ' || dst || ' [ color = forestgreen ]' AS line FROM v_value UNION ALL SELECT 1, '    ' || src || ' -> ' || dst || ' [ color = black ]' FROM v_control")
def vsdg_dot_edges(t):
    return dot.edge_lines(t.graph())


# e-graph


@query(f"WITH {G_CTE} SELECT id, id AS class FROM g")
def egraph_congruence(t):
    """Without rules no two e-nodes of this fixture are congruent."""
    lookup, _ = egraph.union(t.spark, t.enodes(), t.spark.createDataFrame([], "a bigint, b bigint"))
    return lookup


@query(f"WITH {G_CTE}, cp AS (SELECT * FROM g UNION ALL SELECT id + 100000000, op, lhs, rhs FROM g WHERE op IN ('Add', 'Sub')) SELECT id, id % 100000000 AS class FROM cp")
def egraph_congruence_copies(t):
    """A copy of each operation is congruent to it."""
    g = t.enodes()
    both = g.unionByName(g.where(c("op").isin("Add", "Sub")).withColumn("id", c("id") + 100_000_000))
    return egraph.union(t.spark, both, t.spark.createDataFrame([], "a bigint, b bigint"))[0]


@query(f"WITH {G_CTE} SELECT a.id AS a, s.lhs AS b FROM g a JOIN g s ON a.op = 'Add' AND s.op = 'Sub' AND a.rhs = s.id AND s.rhs = a.lhs")
def egraph_rewrite(t):
    return egraph.redundant_add_sub_chain(t.enodes().withColumn("class", c("id")))


@query(f"WITH {G_CTE} SELECT a.id AS a, s.lhs AS b FROM g a JOIN g s ON a.op = 'Add' AND s.op = 'Sub' AND a.rhs = s.id AND s.rhs = a.lhs")
def egraph_rule_text(t):
    return egraph.compile_rule(egraph.sexpr.parse("(add ?x (sub ?y ?x)) => ?y"))(t.enodes().withColumn("class", c("id")))


@query(f"WITH {G_CTE} SELECT id, CASE WHEN op = 'Add' THEN id - 2 ELSE id END AS class FROM g")
def egraph_saturate(t):
    return egraph.EGraph(t.spark, t.enodes()).add_rewrite("(add ?x (sub ?y ?x)) => ?y").saturate()[0]


@query(f"WITH {G_CTE} SELECT id, op, lhs, rhs, CAST(CASE op WHEN 'Sub' THEN 1 ELSE 0 END AS BIGINT) AS cost FROM g WHERE op <> 'Add'")
def egraph_extract(t):
    _, canonical = egraph.EGraph(t.spark, t.enodes()).add_rewrite(egraph.redundant_add_sub_chain).saturate()
    return egraph.extract(t.spark, canonical)


# streaming


@query("SELECT user_id, event_type, CAST(sum(d) AS BIGINT) AS n FROM (SELECT user_id, event_type, 1 AS d FROM events UNION ALL SELECT user_id, event_type, -1 FROM events WHERE value < 20) GROUP BY user_id, event_type HAVING sum(d) <> 0")
def epoch_incremental(t):
    """Insertions and retractions in several epochs, against the final state."""
    key = ["user_id", "event_type"]
    changes = zset.concat(zset.lift(t.events.select(*key)), zset.negate(zset.lift(t.events.where("value < 20").select(*key))))
    folder = shared_dir(t.spark)
    changes.repartition(4).write.parquet(f"{folder}/in")
    schema = "user_id bigint, event_type string, _diff bigint"
    stream = t.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    state = epochs.VersionedState(t.spark, f"{folder}/state", "user_id bigint, event_type string")
    epochs.maintain(stream, state, f"{folder}/log").awaitTermination()
    return state.read().withColumnRenamed("_diff", "n")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def epoch_monotone(t):
    folder = shared_dir(t.spark)
    changes = zset.concat(zset.lift(t.events.select("event_type")), zset.lift(t.events.select("event_type"), -1))
    changes.repartition(2).write.parquet(f"{folder}/in")
    stream = t.spark.readStream.schema("event_type string, _diff bigint").parquet(f"{folder}/in")
    state = epochs.VersionedState(t.spark, f"{folder}/state", "event_type string")
    epochs.maintain(stream, state, f"{folder}/log", monotone=True).awaitTermination()
    return state.read().withColumnRenamed("_diff", "n")


# arrangements, inspection, constants, and what else shows as a table


def _arranged(df: DataFrame) -> DataFrame:
    """The arrangement's rows as any reader sees them."""
    return exchange.as_collection(df)


@query("SELECT p_brand, p_partkey FROM part")
def arrange_by_key_exchange(t):
    return _arranged(exchange.arrange_by_key_exchange(t.part.select("p_brand", "p_partkey"), c("p_partkey") % 7, "p_brand"))


@query("SELECT n_nationkey, n_name FROM nation")
def arrange_by_self(t):
    return _arranged(exchange.arrange_by_self(t.nation.select("n_nationkey", "n_name")))


@query("SELECT n_nationkey, n_name FROM nation")
def arrange_by_self_exchange(t):
    return _arranged(exchange.arrange_by_self_exchange(t.nation.select("n_nationkey", "n_name"), c("n_nationkey") % 3))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'went' ELSE 'came' END AS change FROM orders WHERE (o_orderkey % 7 = 0) <> (o_orderkey % 5 = 0)")
def diff_report(t):
    rows = t.orders.select("o_orderkey")
    went, came = inspect.diff_report(rows.where("o_orderkey % 5 <> 0"), rows.where("o_orderkey % 7 <> 0"), "o_orderkey")
    return zset.concat(went.withColumn("change", lit("went")), came.withColumn("change", lit("came")))


@query("SELECT s_nationkey, count(*) AS n, max(s_suppkey) AS largest FROM supplier GROUP BY s_nationkey")
def debug_taps(t):
    """Taps in the middle of a plan change nothing."""
    seen = []
    tapped = inspect.inspect_aggregate(inspect.debug_inspect(t.supplier, lambda df: seen.append(df.count()), on=True), "s_nationkey", lambda time, rows: seen.append(time), on=True)
    assert seen
    return tapped.groupBy("s_nationkey").agg(F.count("*").alias("n"), F.max("s_suppkey").alias("largest"))


@query("SELECT s_suppkey, s_nationkey = 0 AS zero, true AS signed, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey <> 0 END AS truth FROM supplier")
def constant_predicates(t):
    ty = F.when(c("s_suppkey") % 2 == 0, "bool").otherwise("int")
    return t.supplier.select("s_suppkey", scalars.is_zero(c("s_nationkey")).alias("zero"), scalars.is_signed_int(c("s_nationkey"), lit("int")).alias("signed"), scalars.as_bool(c("s_nationkey"), ty).alias("truth"))


_KINDS = ["==", "!=", "<", ">", "<=", ">="]


@query("SELECT s_suppkey, k.kind, CASE k.kind " + " ".join(f"WHEN '{k}' THEN s_nationkey {'=' if k == '==' else '<>' if k == '!=' else k} s_suppkey % 25" for k in _KINDS) + " END AS holds FROM supplier CROSS JOIN (VALUES " + ", ".join(f"('{k}')" for k in _KINDS) + ") AS k(kind)")
def compare_all_kinds(t):
    rows = t.supplier.select("s_suppkey", "s_nationkey", F.explode(F.array(*map(lit, _KINDS))).alias("kind"))
    return rows.select("s_suppkey", "kind", scalars.compare(c("kind"), c("s_nationkey"), c("s_suppkey") % 25).alias("holds"))


@query("SELECT n_nationkey, CAST(-1 AS BIGINT) AS _diff FROM nation WHERE n_nationkey % 5 = 0 UNION ALL SELECT n_nationkey + 100, CAST(1 AS BIGINT) FROM nation WHERE n_nationkey % 5 = 0")
def differing_rows(t):
    """What assert_eq tells of relations that differ: rows that went (-1) and came (+1)."""
    before = t.nation.select("n_nationkey")
    after = before.select(F.when(c("n_nationkey") % 5 == 0, c("n_nationkey") + 100).otherwise(c("n_nationkey")).alias("n_nationkey"))
    try:
        zset.assert_eq(after, before)
    except AssertionError:
        return zset.differences(after, before).select("n_nationkey", c("_diff").cast("bigint").alias("_diff"))
    raise AssertionError("the relations differ")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can be reached from node 1 of the derived graph."""
    return materialise(spark, QUERIES["reachable"](spark, sf_dir))
