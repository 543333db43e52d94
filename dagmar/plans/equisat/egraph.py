"""Equality saturation: e-nodes, congruence closure, rewrite rules, extraction.

E-nodes are (id, op, lhs, rhs), operands being ids; classes are named by their
smallest id. A rule is a function of canonical e-nodes that gives the pairs of
ids it makes equal; rules in text compile to joins.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dagmar.operators import inspect
from dagmar.operators.aggregates import star_edges
from dagmar.operators.graph import NotConverged, connected_components
from dagmar.plans.equisat import sexpr
from dagmar.plans.lineage import materialise, release

#: (spark, canonical e-nodes with their class) -> (a, b): ids that are equal.
Rewrite = Callable[[DataFrame], DataFrame]
#: Operators with operands; the others are leaves and equal only to themselves.
BINARY = ("Add", "Sub")


def canonical_ids(spark: SparkSession, mergers: DataFrame, enodes: DataFrame) -> DataFrame:
    """(id, class): each e-node's class, from the pairs that are equal."""
    found = connected_components(spark, mergers.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("node").alias("id"), F.col("component").alias("class"))
    return enodes.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("class", "id").alias("class"))


def canonicalise(enodes: DataFrame, lookup: DataFrame) -> DataFrame:
    """E-nodes with their class and their operands' classes."""
    to = lambda c: lookup.select(F.col("id").alias(c), F.col("class").alias(f"_{c}"))
    rows = enodes.join(to("lhs"), "lhs", "left").join(to("rhs"), "rhs", "left").join(lookup, "id")
    return rows.select("id", "op", F.coalesce("_lhs", "lhs").alias("lhs"), F.coalesce("_rhs", "rhs").alias("rhs"), "class")


def congruent(canonical: DataFrame) -> DataFrame:
    """(a, b): e-nodes of one operator with equal operands."""
    return star_edges(canonical.where(F.col("op").isin(*BINARY)), ["op", "lhs", "rhs"], "id").select(F.col("least").alias("a"), F.col("other").alias("b"))


def union(spark: SparkSession, enodes: DataFrame, mergers: DataFrame, max_rounds: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """Congruence closure: (lookup of classes, canonical e-nodes).

    The given mergers are looked at once. A round then merges the classes of
    congruent e-nodes that differ, by components of those pairs only.
    """
    lookup = materialise(spark, canonical_ids(spark, mergers.select("a", "b").distinct(), enodes))
    for _ in range(max_rounds):
        canonical = materialise(spark, canonicalise(enodes, lookup))
        binary = canonical.where(F.col("op").isin(*BINARY)).select("op", "lhs", "rhs", "class").distinct()
        pairs = materialise(spark, star_edges(binary, ["op", "lhs", "rhs"], "class").select(F.col("least").alias("src"), F.col("other").alias("dst")).distinct())
        if pairs.isEmpty():
            release(pairs)
            return lookup, canonical
        to = connected_components(spark, pairs).select(F.col("node").alias("class"), F.col("component").alias("_class"))
        older, lookup = lookup, materialise(spark, lookup.join(to, "class", "left").select("id", F.coalesce("_class", "class").alias("class")))
        release(older, canonical, pairs)
    raise NotConverged(f"classes still merge after {max_rounds} rounds")


def redundant_add_sub_chain(canonical: DataFrame) -> DataFrame:
    """(add ?x (sub ?y ?x)) => ?y"""
    adds = canonical.where("op = 'Add'").select(F.col("class").alias("a"), F.col("lhs").alias("x"), F.col("rhs").alias("inner"))
    subs = canonical.where("op = 'Sub'").select(F.col("class").alias("inner"), F.col("lhs").alias("b"), F.col("rhs").alias("x"))
    return adds.join(subs, ["inner", "x"]).select("a", "b").where("a <> b").distinct()


def redundant_sub(canonical: DataFrame) -> DataFrame:
    """(sub (add ?x ?y) ?x) => ?y, the counterpart of the rule above."""
    return compile_rule(sexpr.parse("(sub (add ?x ?y) ?x) => ?y"))(canonical)


def compile_rule(rule: sexpr.Rule) -> Rewrite:
    """A rule over Add and Sub whose right side is a variable, as joins: one relation for each list on the left."""
    if not isinstance(rule.right, sexpr.Var):
        raise NotImplementedError("the right side must be a variable")
    if not isinstance(rule.left, tuple):
        raise NotImplementedError("the left side must be a list")
    names = {op.lower(): op for op in BINARY}

    def matches(canonical: DataFrame, term: tuple, path: str) -> DataFrame:
        """Columns path (the class) and one per variable, named v_<name>."""
        if len(term) != 3 or not isinstance(term[0], sexpr.Ident) or term[0].name not in names:
            raise NotImplementedError(f"no pattern for {term}")
        out = canonical.where(F.col("op") == names[term[0].name]).select(F.col("class").alias(path), F.col("lhs").alias(f"{path}l"), F.col("rhs").alias(f"{path}r"))
        for side, sub in (("l", term[1]), ("r", term[2])):
            at = f"{path}{side}"
            if isinstance(sub, sexpr.Var):
                name = f"v_{sub.name}"
                out = out.where(F.col(at) == F.col(name)) if name in out.columns else out.withColumn(name, F.col(at))
            elif isinstance(sub, tuple):
                inner = matches(canonical, sub, at)
                out = out.join(inner, [c for c in inner.columns if c in out.columns])
            else:
                raise NotImplementedError(f"no pattern for {sub}")
        return out

    return lambda canonical: matches(canonical, rule.left, "_").select(F.col("_").alias("a"), F.col(f"v_{rule.right.name}").alias("b")).where("a <> b").distinct()


class EGraph:
    def __init__(self, spark: SparkSession, enodes: DataFrame | None = None):
        self.spark = spark
        self.enodes = enodes if enodes is not None else spark.createDataFrame([], "id bigint, op string, lhs bigint, rhs bigint")
        self.mergers = spark.createDataFrame([], "a bigint, b bigint")
        self.rules: list[Rewrite] = []

    def add_enodes(self, enodes: DataFrame) -> EGraph:
        """More e-nodes, as of a new epoch; what was found equal stays so."""
        self.enodes = materialise(self.spark, self.enodes.unionByName(enodes).distinct())
        return self

    def add_rewrite(self, rule: Rewrite | str) -> EGraph:
        self.rules.append(compile_rule(sexpr.parse(rule)) if isinstance(rule, str) else rule)
        return self

    def add_mergers(self, pairs: DataFrame) -> EGraph:
        self.mergers = materialise(self.spark, self.mergers.union(pairs.select("a", "b")).distinct())
        return self

    def debug(self, on: bool | None = None) -> EGraph:
        inspect.debug(self.enodes, "enodes", on)
        inspect.debug(self.mergers, "mergers", on)
        return self

    def saturate(self, max_rounds: int = 100_000) -> tuple[DataFrame, DataFrame]:
        """Close under congruence and rules by turns until no rule finds a new pair; (lookup, canonical e-nodes)."""
        for _ in range(max_rounds):
            lookup, canonical = union(self.spark, self.enodes, self.mergers)
            found = None
            for rule in self.rules:
                found = rule(canonical) if found is None else found.union(rule(canonical))
            if found is None:
                return lookup, canonical
            found = materialise(self.spark, found.distinct())
            if found.isEmpty():  # canonical ids: a pair that is already equal is no pair
                return lookup, canonical
            self.add_mergers(found)
        raise NotConverged(f"rules still apply after {max_rounds} rounds")

    feedback = saturate


def extraction_costs(spark: SparkSession, canonical: DataFrame, max_rounds: int = 100_000) -> DataFrame:
    """(class, cost, id): the cheapest member of each class. Constants cost 0, parameters 1, an operation 1 more than its operands."""
    leaves = canonical.where(~F.col("op").isin(*BINARY)).select("class", F.when(F.col("op") == "Constant", 0).otherwise(1).cast("long").alias("cost"), "id")
    inner = canonical.where(F.col("op").isin(*BINARY)).select("class", "lhs", "rhs", "id")
    best = lambda df: df.groupBy("class").agg(F.min(F.struct("cost", "id")).alias("m")).select("class", "m.cost", "m.id")
    now = materialise(spark, best(leaves))
    for _ in range(max_rounds):
        of = lambda c: now.select(F.col("class").alias(c), F.col("cost").alias(f"_{c}"))  # noqa: E731, B023
        new = materialise(spark, best(leaves.union(inner.join(of("lhs"), "lhs").join(of("rhs"), "rhs").select("class", (F.col("_lhs") + F.col("_rhs") + 1).alias("cost"), "id"))))
        if new.exceptAll(now).isEmpty() and now.exceptAll(new).isEmpty():
            return new
        now = new
    raise NotConverged(f"costs still fall after {max_rounds} rounds")


def extract(spark: SparkSession, canonical: DataFrame) -> DataFrame:
    """(id, op, lhs, rhs, cost): the cheapest e-node of each class, with operands replaced by the cheapest of theirs."""
    costs = extraction_costs(spark, canonical)
    chosen = canonical.join(costs.select("id", "class", "cost"), ["id", "class"])
    to = lambda c: costs.select(F.col("class").alias(c), F.col("id").alias(f"_{c}"))
    return chosen.join(to("lhs"), "lhs", "left").join(to("rhs"), "rhs", "left").select("id", "op", F.col("_lhs").alias("lhs"), F.col("_rhs").alias("rhs"), "cost")


def apply_all(rules: Sequence[Rewrite], canonical: DataFrame) -> DataFrame:
    out = rules[0](canonical)
    for r in rules[1:]:
        out = out.union(r(canonical))
    return out.distinct()
