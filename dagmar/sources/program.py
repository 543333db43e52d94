"""The two program forms as bundles of six relations."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields, replace
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from dagmar.operators import exchange, inspect, zset
from dagmar.operators.graph import propagate
from dagmar.plans.lineage import by_shuffles, materialise
from dagmar.sources import schemas


class Relations:
    """What both bundles can do with each of their relations."""

    def items(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def apply(self, fn: Callable[[DataFrame], DataFrame]):
        return replace(self, **{k: fn(v) for k, v in self.items().items()})

    def consolidate(self):
        return self.apply(zset.consolidate)

    def concat(self, other):
        return replace(self, **{k: v.unionByName(other.items()[k]) for k, v in self.items().items()})

    def written(self, spark: SparkSession):
        return self.apply(lambda df: materialise(spark, df))

    def assert_eq(self, other) -> None:
        for name, df in self.items().items():
            try:
                zset.assert_eq(df, other.items()[name])
            except AssertionError as e:
                raise AssertionError(f"{name}: {e}") from None

    def debug_assert_eq(self, other) -> None:
        if inspect.DEBUG:
            self.assert_eq(other)

    def debug(self, on: bool | None = None):
        for name, df in self.items().items():
            inspect.debug(df, name, on)
        return self

    def probe(self) -> tuple[object, dict[str, Observation]]:
        """The same relations, with row counts that fill as they are computed."""
        seen = {k: inspect.inspect(v) for k, v in self.items().items()}
        return replace(self, **{k: v[0] for k, v in seen.items()}), {k: v[1] for k, v in seen.items()}

    def arrange_by_key(self):
        """All relations kept by their first column, for several readers."""
        return self.apply(lambda df: exchange.arrange_by_key(df, df.columns[0]))

    def unpersist(self) -> None:
        self.apply(lambda df: df.unpersist())

    def differences(self, other) -> DataFrame:
        """What changed from self to other, by relation: rows that went and came, as text."""
        parts = [zset.differences(other.items()[k], v).select(F.lit(k).alias("relation"), F.to_json(F.struct(*v.columns)).alias("row"), zset.DIFF) for k, v in self.items().items()]
        return reduce(DataFrame.unionByName, parts)


@dataclass(frozen=True)
class Program(Relations):
    """Block IR."""

    instructions: DataFrame
    block_instructions: DataFrame
    terminators: DataFrame
    blocks: DataFrame
    function_blocks: DataFrame
    functions: DataFrame

    SCHEMAS = {"instructions": schemas.INSTRUCTIONS, "block_instructions": schemas.BLOCK_INSTRUCTIONS, "terminators": schemas.TERMINATORS, "blocks": schemas.BLOCKS, "function_blocks": schemas.FUNCTION_BLOCKS, "functions": schemas.FUNCTIONS}

    @classmethod
    def of(cls, spark: SparkSession, **rows) -> Program:
        return cls(**{k: spark.createDataFrame(rows.get(k, []), s) for k, s in cls.SCHEMAS.items()})

    def located(self) -> DataFrame:
        """Instructions with their block and function."""
        return self.instructions.join(by_shuffles(self.block_instructions), "inst_id").join(by_shuffles(self.function_blocks), "block_id")

    def jump_edges(self) -> DataFrame:
        return self.terminators.select(F.col("block_id").alias("src"), F.explode(F.array("t1", "t2")).alias("dst")).where("dst is not null").distinct()


@dataclass(frozen=True)
class ProgramGraph(Relations):
    """Graph IR."""

    value_edges: DataFrame
    effect_edges: DataFrame
    control_edges: DataFrame
    nodes: DataFrame
    function_nodes: DataFrame
    functions: DataFrame

    SCHEMAS = {"value_edges": schemas.EDGES, "effect_edges": schemas.EDGES, "control_edges": schemas.EDGES, "nodes": schemas.NODES, "function_nodes": schemas.FUNCTION_NODES, "functions": schemas.GRAPH_FUNCTIONS}

    @classmethod
    def of(cls, spark: SparkSession, **rows) -> ProgramGraph:
        return cls(**{k: spark.createDataFrame(rows.get(k, []), s) for k, s in cls.SCHEMAS.items()})

    def all_edges(self) -> DataFrame:
        return zset.concat(self.value_edges, self.effect_edges, self.control_edges)

    def end_node_ids(self) -> DataFrame:
        return self.nodes.where(F.col("kind") == "End").select("node_id")

    def node_memberships(self, spark: SparkSession) -> DataFrame:
        """(node_id, end_id): each node with the smallest End that reaches it."""
        roots = self.end_node_ids().select(F.col("node_id").alias("node"), F.col("node_id").alias("label"))
        return propagate(spark, self.all_edges(), roots).select(F.col("node").alias("node_id"), F.col("label").alias("end_id"))

    def function_ends(self) -> DataFrame:
        return self.function_nodes.join(self.end_node_ids(), "node_id").select("func_id", F.col("node_id").alias("end_id"))

    def tagged(self, name: str = "graph") -> DataFrame:
        """All six relations as one tagged relation, with equal rows consolidated into a count."""
        return zset.consolidate(zset.lift(self.captured(name)))

    def captured(self, name: str = "graph") -> DataFrame:
        """All six relations as one tagged relation, row for row."""
        parts = [df.select(F.lit(name).alias("graph"), F.lit(k).alias("relation"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("row")) for k, df in self.items().items()]
        return reduce(DataFrame.unionByName, parts)


def variable(cls, start: Mapping[str, DataFrame]):
    """A bundle to start a recursion from."""
    return cls(**start)
