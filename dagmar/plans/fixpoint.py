"""Recursion: loops on the driver over written relations.

Each round is written to the shared folder, so lineage stays one round deep and
a lost executor costs at most that round; a round's folder goes once the next is
written. Loops raise if they don't settle within a cap, which is there against
steps that never would: rounds grow with a program's depth, so it is high.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from dagmar.operators.graph import NotConverged
from dagmar.operators.zset import differences
from dagmar.plans.lineage import by_shuffles, materialise, release

#: Far above the depth of real inputs.
ROUNDS = 100_000


def same(a: DataFrame, b: DataFrame) -> bool:
    return differences(a, b).isEmpty()


def fixpoint(spark: SparkSession, start: DataFrame, step: Callable[[DataFrame], DataFrame], max_rounds: int = ROUNDS, unroll: int = 1) -> DataFrame:
    """Apply step until nothing changes; unroll steps make one round."""
    now = materialise(spark, start)
    for _ in range(max_rounds):
        new = now
        for _ in range(unroll):
            new = step(new)
        new = materialise(spark, new)
        settled = same(now, new)
        release(now)
        if settled:
            return new
        now = new
    raise NotConverged(f"no fixpoint after {max_rounds} rounds")


def fixpoint_all(spark: SparkSession, start: Mapping[str, DataFrame], step: Callable[[dict[str, DataFrame]], Mapping[str, DataFrame]], max_rounds: int = ROUNDS) -> dict[str, DataFrame]:
    """Mutually recursive relations: step computes all of them from all of them."""
    now = {k: materialise(spark, v) for k, v in start.items()}
    for _ in range(max_rounds):
        new = {k: materialise(spark, v) for k, v in step(now).items()}
        settled = all(same(now[k], new[k]) for k in new)
        release(*(now[k] for k in new))
        if settled:
            return now | new
        now = now | new
    raise NotConverged(f"no fixpoint after {max_rounds} rounds")


class Variable:
    """A relation that is defined before it is computed: set() or set_concat() gives its next value, run() its fixpoint."""

    def __init__(self, start: DataFrame):
        self.start, self.step = start, None

    def set(self, step: Callable[[DataFrame], DataFrame]) -> Variable:
        self.step = step
        return self

    def set_concat(self, step: Callable[[DataFrame], DataFrame]) -> Variable:
        self.step = lambda now: self.start.unionByName(step(now)).distinct()
        return self

    def run(self, spark: SparkSession, max_rounds: int = ROUNDS) -> DataFrame:
        return fixpoint(spark, self.start, self.step, max_rounds)


def seminaive(spark: SparkSession, start: DataFrame, step: Callable[[DataFrame], DataFrame], max_rounds: int = ROUNDS, compact: int = 16, unroll: int = 4) -> DataFrame:
    """Least fixpoint of a monotone step: each round looks at the rows that the one before found.

    A round takes up to `unroll` steps in one job and then drops what was known,
    so that long chains take few jobs; the first rounds are single steps, as
    most relations are done soon. What is known is a union of written rounds,
    rewritten every `compact` rounds.
    """
    delta = known = materialise(spark, start.distinct())
    parts = [known]
    for round_ in range(1, max_rounds + 1):
        now, found = delta, None
        for _ in range(1 if round_ < 3 else unroll):
            now = step(now).select(*start.columns).distinct()
            found = now if found is None else found.union(now)
        delta = materialise(spark, found.distinct().join(by_shuffles(known), start.columns, "left_anti"))
        if delta.isEmpty():
            release(delta)
            return known if len(parts) == 1 else by_shuffles(known)
        known = known.union(delta)
        parts.append(delta)
        if round_ % compact == 0:
            known = materialise(spark, known)
            release(*parts[:-1])
            parts = [parts[-1], known]
    raise NotConverged(f"still growing after {max_rounds} rounds")


def bounded_loop(spark: SparkSession, start: DataFrame, body: Callable[[DataFrame], DataFrame], max_iterations: int) -> DataFrame:
    """All outputs of the body, with repetitions, from round 0 to round max_iterations."""
    now, out = start, None
    for _ in range(max_iterations + 1):
        now = materialise(spark, body(now))
        out = now if out is None else out.unionByName(now)
    return out


def apply_sequenced(spark: SparkSession, start: DataFrame, functions: Sequence[Callable[[DataFrame], DataFrame]], max_rounds: int = ROUNDS) -> DataFrame:
    """Apply all functions in turn to the whole relation, again and again, until a turn changes nothing."""

    def turn(df: DataFrame) -> DataFrame:
        for f in functions:
            df = f(df)
        return df

    return fixpoint(spark, start, turn, max_rounds) if functions else start
