"""Packing documents into sequences by bulk-synchronous best-fit.

Documents of one length are interchangeable, and so are gaps of one size. So the
range-sorted lists of documents and of gaps are held as runs of equal entries,
and a round matches all runs at once:

1. the pieces are cut, measured and written; each knows its rank among those
   of its length in its own partition, and the histogram of lengths by partition
   (a prefix sum over partitions) gives its rank among all pieces of its length;
2. a round range-partitions runs of documents and of gaps by size. In a sweep
   from the largest size down every document looks for its successor, the
   smallest gap that holds it and that no larger document of the sweep has
   taken: gaps are stacked as the sweep meets them, and a run of documents takes
   from the top. Where documents of a length outnumber the bins of a gap size,
   ranks decide: the first ones get the bins, a bin as many as it holds, the
   others go on to the next size. Each range sweeps by itself; documents without
   a gap there and gaps without a document go on to the sweep of what all ranges
   have left, which is the same as one sweep over all sizes;
3. documents for which no bin has room open new bins. Then the gaps are updated,
   and the next round begins, until no document is left. Lengths above half a
   sequence come first, then those above a quarter, above an eighth and the
   rest, so that short documents find the gaps that long ones leave;
4. the placements, as runs of ranks, are joined with the pieces.

The number of runs depends on the capacity, not on the number of documents; a
few rounds make one job, whose result is written.

Defined cases: a null or empty text has no ids but the closing one; a text
longer than a sequence is cut into full pieces with the shorter one first;
repeated rows are packed each for itself; an empty table gives an empty result;
of docs only doc_id and text are looked at.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dagmar.llm.common import materialise, release, slices, table
from dagmar.llm.tokens import TOKENIZER, encoder

#: Ranges of sizes that sweep by themselves; rounds to a job; ranks of a length that are joined by one key.
RANGES, ROUNDS, BLOCK = 16, 4, 1 << 16
#: Runs: gaps (size, first bin, number), documents (size, first rank, number), placements (length, first rank, number, first bin, documents to a bin, offset), the number of bins.
GAP, DOCUMENT, FRESH, PLACED, OPENED = range(5)
RUNS = "kind int, size long, at long, n long, bin long, per long, offset long"
NAMES = [c.split()[0] for c in RUNS.split(", ")]
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, k long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, capacity: int, tokenizer: str = TOKENIZER) -> DataFrame:
    def run(batches):
        encode, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            for some in slices([batch], 1, 4 << 20):
                out = [[] for _ in range(7)]
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    ids = encode.ids(text or "") + b"\0\0\0\0"
                    for i, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                        row = (doc_id, i, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), part, seen[n])
                        seen[n] += 1
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "k"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def sweep(gaps: list[tuple[int, int, int]], documents: list[tuple[int, int, int]], capacity: int) -> tuple[list, list, list, list]:
    """One sweep over runs of gaps and documents, from the largest size down: placements, documents and gaps that are left, and the gaps of the bins that were used."""
    stack: list[list[int]] = []
    placed, left, fresh = [], [], []
    events = sorted([(-size, GAP, at, n) for size, at, n in gaps] + [(-size, DOCUMENT, at, n) for size, at, n in documents])
    for minus, kind, at, n in events:
        size = -minus
        if kind == GAP:
            stack.append([size, at, n])
            continue
        while n and stack:
            gap, bin_, bins = stack[-1]
            per = gap // size
            used, docs = (min(bins, n // per), per) if n >= per else (1, n)
            placed.append((size, at, used * docs, bin_, per, capacity - gap))
            if gap > docs * size:
                fresh.append((gap - docs * size, bin_, used))
            at, n = at + used * docs, n - used * docs
            if used == bins:
                stack.pop()
            else:
                stack[-1] = [gap, bin_ + used, bins - used]
        if n:
            left.append((size, at, n))
    return placed, left, [tuple(g) for g in stack], fresh


def sweep_and_open(gaps: list, documents: list, fresh: list, bins: int, capacity: int) -> tuple[list, list, list, int]:
    """A sweep after which documents that fit nowhere open bins: placements, documents left, all gaps, and the number of bins."""
    placed, left, rest, more = sweep(gaps, documents, capacity)
    fresh = fresh + more
    widest = max((g[0] for g in fresh), default=0)
    stuck = [d for d in left if d[0] > widest]
    if stuck:
        opened = -(-sum(size * n for size, _, n in stuck) // capacity)
        again, still, empty, more = sweep([(capacity, bins, opened)], stuck, capacity)
        placed, left, rest, fresh, bins = placed + again, [d for d in left if d[0] <= widest] + still, rest + empty, fresh + more, bins + opened
    return placed, left, rest + fresh, bins


def _rounds(spark: SparkSession, runs: DataFrame, capacity: int) -> DataFrame:
    """A few rounds over runs: in each, ranges of sizes sweep, then what they have left."""

    def rows(batches) -> tuple[dict[int, list], int, list]:
        by, bins, others = {GAP: [], DOCUMENT: [], FRESH: []}, 0, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] in by:
                    by[row[0]].append(row[1:4])
                elif row[0] == OPENED:
                    bins += row[3]
                else:
                    others.append(row)
        return by, bins, others

    def batch_of(found: dict[int, list], bins: int, placed: list, others: list):
        out = [(kind, *r, 0, 0, 0) for kind, each in found.items() for r in each] + [(PLACED, *p) for p in placed] + others
        if bins:
            out.append((OPENED, 0, 0, bins, 0, 0, 0))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 0 else pa.int64()) for i, c in enumerate(zip(*out, strict=True))] if out else [pa.array([], pa.int32()), *[pa.array([], pa.int64())] * 6], NAMES)

    def in_range(batches):
        by, bins, others = rows(batches)
        placed, left, rest, fresh = sweep(by[GAP], by[DOCUMENT], capacity)
        yield from batch_of({GAP: rest, DOCUMENT: left, FRESH: by[FRESH] + fresh}, bins, placed, others)

    def over_all(batches):
        by, bins, others = rows(batches)
        placed, left, gaps, bins = sweep_and_open(by[GAP], by[DOCUMENT], by[FRESH], bins, capacity)
        yield from batch_of({GAP: gaps, DOCUMENT: left}, bins, placed, others)

    to = F.when(F.col("kind").isin(GAP, DOCUMENT), F.least(F.lit(RANGES - 1), F.floor((F.col("size") - 1) * RANGES / capacity))).otherwise(F.lit(0)).cast("int")
    for _ in range(ROUNDS):
        runs = runs.repartitionById(RANGES, to).mapInArrow(in_range, RUNS).repartitionById(1, F.lit(0)).mapInArrow(over_all, RUNS)
    return materialise(spark, runs)


def places(spark: SparkSession, lengths: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """Placements of all documents, of which lengths (length, n) says how many there are, as runs (length, lo, n, bin, per, offset); and the number of bins."""
    whole = lengths.select(F.lit(DOCUMENT).alias("kind"), F.col("length").cast("long").alias("size"), F.lit(0).cast("long").alias("at"), F.col("n").cast("long").alias("n"), *(F.lit(0).cast("long").alias(c) for c in NAMES[4:]))
    state = spark.createDataFrame([], RUNS)
    found, below, jobs = None, capacity + 1, []
    for part in (2, 4, 8, None):
        above = capacity // part if part else 0
        state = state.union(whole.where((F.col("size") > above) & (F.col("size") < below)))
        below = above + 1
        while not state.where(F.col("kind") == DOCUMENT).isEmpty():
            done = _rounds(spark, state, capacity)
            jobs.append(done)
            placed = done.where(F.col("kind") == PLACED)
            found = placed if found is None else found.union(placed)
            state = done.where(F.col("kind") != PLACED)
    bins = state.where(F.col("kind") == OPENED).agg(F.sum("n")).first()[0] or 0
    found = state if found is None else found
    placed = materialise(spark, found.select(F.col("size").alias("length"), F.col("at").alias("lo"), "n", "bin", "per", "offset"))
    release(*jobs)
    return placed, bins


def pack(spark: SparkSession, docs: DataFrame, capacity: int = 2048, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    cuts = materialise(spark, pieces(docs, capacity, tokenizer))
    by_part = materialise(spark, cuts.groupBy("length", "part").agg(F.count("*").alias("n")))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed, _ = places(spark, by_part.groupBy("length").agg(F.sum("n").alias("n")), capacity)
    blocks = F.sequence(F.floor(F.col("lo") / BLOCK), F.floor((F.col("lo") + F.col("n") - 1) / BLOCK))
    runs = placed.select(F.col("length").alias("_length"), "lo", (F.col("lo") + F.col("n")).alias("hi"), "bin", "per", "offset", F.explode(blocks).alias("_block"))
    ranked = cuts.join(base, ["length", "part"]).withColumn("rank", F.col("k") + F.col("base")).withColumn("block", F.floor(F.col("rank") / BLOCK))
    at = ranked.join(runs, (F.col("length") == F.col("_length")) & (F.col("block") == F.col("_block")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    nth = F.col("rank") - F.col("lo")
    return at.select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
        (F.col("bin") + F.floor(nth / F.col("per"))).alias("sequence_id"), (F.col("offset") + F.pmod(nth, F.col("per")) * F.col("length")).alias("offset"),
    )


def op5(spark, sf_dir: str) -> DataFrame:
    return pack(spark, table(spark, sf_dir, "documents"))
