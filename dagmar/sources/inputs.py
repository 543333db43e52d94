"""Interactive inputs: rows inserted and retracted at epochs, closed by advance_to.

Updates wait on the driver until their epoch closes and are then one DataFrame
of changes. This is the path for programs that a front end builds; tables come
in by spark.read, streams by dagmar.streaming.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dagmar.operators.rowwise import DIFF
from dagmar.operators.zset import to_bag
from dagmar.plans.lineage import materialise
from dagmar.sources.program import Program, ProgramGraph


class InputSession:
    """One input relation with signed updates."""

    def __init__(self, spark: SparkSession, schema: str):
        self.spark, self.schema, self.time = spark, schema, 0
        self._pending: list[tuple] = []
        self._closed: list[tuple[int, DataFrame]] = []

    def insert(self, *row) -> None:
        self.update(row, 1)

    def remove(self, *row) -> None:
        self.update(row, -1)

    def update(self, row: tuple, diff: int) -> None:
        self.update_at(row, self.time, diff)

    def update_at(self, row: tuple, time: int, diff: int) -> None:
        if time < self.time:
            raise ValueError(f"epoch {time} is closed")
        self._pending.append((*row, diff, time))

    def advance_to(self, time: int) -> None:
        if time < self.time:
            raise ValueError(f"can't go back from {self.time} to {time}")
        self.time = time
        self.flush()

    def flush(self) -> None:
        """Updates of closed epochs become visible."""
        done = [r for r in self._pending if r[-1] < self.time]
        if done:
            rows = self.spark.createDataFrame(done, f"{self.schema}, {DIFF} bigint, _time bigint")
            self._closed.append((self.time, materialise(self.spark, rows)))
            self._pending = [r for r in self._pending if r[-1] >= self.time]

    def changes(self) -> DataFrame:
        """All updates of closed epochs, with _diff and _time."""
        out = self.spark.createDataFrame([], f"{self.schema}, {DIFF} bigint, _time bigint")
        for _, df in self._closed:
            out = out.unionByName(df)
        return out

    def collection(self) -> DataFrame:
        """The relation as closed epochs leave it, with repetitions."""
        return to_bag(self.changes().drop("_time"))


class Inputs:
    """Several inputs that move through time together."""

    schemas: dict[str, str] = {}

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.sessions = {k: InputSession(spark, s) for k, s in self.schemas.items()}

    def __getattr__(self, name: str) -> InputSession:
        try:
            return self.__dict__["sessions"][name]
        except KeyError:
            raise AttributeError(name) from None

    def advance_to(self, time: int) -> None:
        for s in self.sessions.values():
            s.advance_to(time)

    def flush(self) -> None:
        for s in self.sessions.values():
            s.flush()

    def time(self) -> int:
        times = {s.time for s in self.sessions.values()}
        if len(times) != 1:
            raise AssertionError(f"inputs are at different times: {sorted(times)}")
        return times.pop()


class InputManager(Inputs):
    """Block IR: its relations as sets."""

    schemas = Program.SCHEMAS

    def program(self) -> Program:
        return Program(**{k: s.collection().distinct() for k, s in self.sessions.items()})


class ProgramInputs(Inputs):
    """Graph IR: its relations as bags."""

    schemas = ProgramGraph.SCHEMAS

    def graph(self) -> ProgramGraph:
        return ProgramGraph(**{k: s.collection() for k, s in self.sessions.items()})
