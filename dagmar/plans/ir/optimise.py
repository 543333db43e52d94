"""The block IR's optimisation loop."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import SparkSession

from dagmar.operators.graph import NotConverged
from dagmar.plans.fixpoint import same
from dagmar.plans.ir.cleanup import cleanup, compact_basic_blocks, cull_unreachable_blocks
from dagmar.plans.ir.folding import constant_folding
from dagmar.plans.ir.peephole import peephole
from dagmar.sources.program import Program


def optimise(spark: SparkSession, p: Program, max_rounds: int = 1000) -> Program:
    """Fold, peephole, cull, compact and clean up until nothing changes."""
    now = p.written(spark)
    for _ in range(max_rounds):
        new = constant_folding(spark, now)
        new = replace(new, instructions=peephole(new.instructions)).written(spark)
        new = cull_unreachable_blocks(spark, new).written(spark)
        new = compact_basic_blocks(spark, new).written(spark)
        new = cleanup(spark, new).written(spark)
        if all(same(df.drop("args"), new.items()[k].drop("args")) if k == "instructions" else same(df, new.items()[k]) for k, df in now.items().items()):
            return new
        now = new
    raise NotConverged(f"the program still changes after {max_rounds} rounds")
