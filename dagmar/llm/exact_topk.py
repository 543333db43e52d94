"""Exact top-k search by distributed histogram selection.

Vectors are turned into integers and packed in blocks once. Queries are taken
in waves of bounded size. For a wave, every task scores its blocks against all
queries and counts scores in a histogram per query; the counts are added up and
show the bin in which the k-th score lies; the next round divides that bin,
until it is one value wide. A task sends only its highest bins that hold k
scores: lower ones cannot hold the k-th. A last round picks what is above the
k-th value and, of what equals it, the smallest ids that fill up k.

Defined cases: a vector that is null or holds a null or non-finite component
takes no part; shorter vectors count as ending in zeros; a null id is never a
query and its vector is no candidate; rows that repeat an id count as
candidates each, and as one query, with the lowest of their vectors; a query's
own id is never its candidate; vectors so long that a score could pass 64 bits
are an error; an empty table gives an empty result; of the
table only vec_id and embedding are looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dagmar.llm.common import materialise, release, shared_dir, table

SCALE, BINS, WAVE, BLOCK = 1024.0, 2048, 512, 4096


def blocks(vectors: DataFrame, scale: float = SCALE) -> DataFrame:
    """Rows of up to BLOCK vectors: their ids and their integer components as float64, which holds integers up to 2**53 exactly."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    used = vectors.select(F.col("vec_id").cast("long"), "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                lists = some.column(1)
                sizes = np.diff(np.asarray(lists.offsets))
                wide = int(sizes.max(initial=0))
                whole = np.zeros((some.num_rows, wide))
                whole[np.arange(wide) < sizes[:, None]] = np.floor(scale * np.asarray(lists.flatten(), np.float64))
                most = float(np.sqrt((whole**2).sum(axis=1)).max(initial=0))
                yield pa.RecordBatch.from_arrays([pa.array([np.asarray(some.column(0), np.int64).tobytes()]), pa.array([whole.tobytes()]), pa.array([wide], pa.int32()), pa.array([most])], ["ids", "data", "wide", "most"])

    return used.mapInArrow(run, "ids binary, data binary, wide int, most double")


def _opened(batches):
    for batch in batches:
        for ids, data, wide in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            at = np.frombuffer(ids.as_py(), np.int64)
            yield at, np.frombuffer(data.as_py(), np.float64).reshape(len(at), wide.as_py())


def _scores(ids: np.ndarray, rows: np.ndarray, wave) -> np.ndarray:
    """int64 scores, vectors x queries; the smallest int64 for a query's own id."""
    asked, queries = wave
    wide = min(rows.shape[1], queries.shape[1])
    a, b = rows[:, :wide], queries[:, :wide]
    if wide and float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * wide >= 2**53:
        out = a.astype(np.int64) @ b.T.astype(np.int64)
    else:
        out = (a @ b.T).astype(np.int64)
    out[ids[:, None] == asked[None, :]] = np.iinfo(np.int64).min
    return out


def _histogram(packed: DataFrame, wave, low, span, width, k: int) -> DataFrame:
    """(q, bin, n): scores per bin of [low, low + span), only each task's highest bins that hold k scores."""

    def run(batches):
        (asked, queries), low_, span_, width_ = wave.value, low.value, span.value, width.value
        seen = np.zeros((len(asked), BINS), np.int64)
        for ids, rows in _opened(batches):
            scores = _scores(ids, rows, (asked, queries))
            at, q = np.nonzero((scores >= low_) & (scores < low_ + span_))
            bins = (scores[at, q] - low_[q]) // width_[q]
            seen += np.bincount(q * BINS + bins, minlength=seen.size).reshape(seen.shape)
        above = np.cumsum(seen[:, ::-1], axis=1)[:, ::-1] - seen
        q, b = np.nonzero((seen > 0) & (above < k))
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(b, pa.int64()), pa.array(seen[q, b], pa.int64())], ["q", "bin", "n"])

    return packed.select("ids", "data", "wide").mapInArrow(run, "q long, bin long, n long")


def _picked(packed: DataFrame, wave, kth, ties) -> DataFrame:
    def run(batches):
        (asked, queries), kth_, ties_ = wave.value, kth.value, ties.value
        tied: list[np.ndarray] = [np.zeros(0, np.int64) for _ in asked]
        for ids, rows in _opened(batches):
            scores = _scores(ids, rows, (asked, queries))
            at, q = np.nonzero(scores > kth_[None, :])
            yield pa.RecordBatch.from_arrays([pa.array(asked[q]), pa.array(ids[at]), pa.array(scores[at, q])], ["query_id", "vec_id", "score"])
            for i in np.nonzero((scores == kth_[None, :]).any(axis=0))[0]:
                tied[i] = np.sort(np.concatenate([tied[i], ids[scores[:, i] == kth_[i]]]))[: ties_[i]]
        q = np.repeat(np.arange(len(asked)), [len(t) for t in tied])
        yield pa.RecordBatch.from_arrays([pa.array(asked[q]), pa.array(np.concatenate([*tied, np.zeros(0, np.int64)])), pa.array(kth_[q])], ["query_id", "vec_id", "score"])

    return packed.select("ids", "data", "wide").mapInArrow(run, "query_id long, vec_id long, score long")


def _queries(packed: DataFrame, every: int, waves: int) -> DataFrame:
    def run(batches):
        for ids, rows in _opened(batches):
            own = ids % every == 0
            yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array([r.tobytes() for r in rows[own]], pa.binary())], ["query_id", "data"])

    return packed.select("ids", "data", "wide").mapInArrow(run, "query_id long, data binary").groupBy("query_id").agg(F.min("data").alias("data")).withColumn("wave", F.pmod(F.xxhash64("query_id"), F.lit(waves)))


def top_k(spark: SparkSession, vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of every row whose id `every` divides."""
    packed = materialise(spark, blocks(vectors))
    most = packed.agg(F.max("most")).first()[0] or 0.0
    if most * most >= 2.0**62:
        raise OverflowError(f"a vector has length {most:.3g} after scaling: scores don't fit 64 bits")
    total = vectors.where(F.col("vec_id") % every == 0).count()
    waves = max(1, -(-total // (WAVE // 2 if total > WAVE else WAVE)))
    asked = materialise(spark, _queries(packed, every, waves))
    folder, waves_done, shared = shared_dir(spark), 0, []

    def share(value):
        shared.append(spark.sparkContext.broadcast(value))
        return shared[-1]

    for w in range(waves):
        rows = asked.where(F.col("wave") == w).orderBy("query_id").collect()
        if not rows:
            continue
        each = [np.frombuffer(bytes(r["data"]), np.float64) for r in rows]
        queries = np.zeros((len(rows), max(map(len, each))))
        for q, r in zip(queries, each, strict=True):
            q[: len(r)] = r
        wave = share((np.array([r["query_id"] for r in rows], np.int64), queries))
        bound = np.ceil(np.sqrt((queries**2).sum(axis=1)) * most).astype(np.int64) + 1
        low, span, above, done = -bound, 2 * bound + 1, np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)
        while True:
            width = np.maximum(1, -(-span // BINS))
            counts = _histogram(packed, wave, share(low), share(span), share(width), k).groupBy("q", "bin").agg(F.sum("n").alias("n"))
            down = Window.partitionBy("q").orderBy(F.col("bin").desc())
            known = spark.createDataFrame(list(zip(range(len(rows)), above.tolist(), strict=True)), "q long, above long")
            upto = counts.withColumn("upto", F.sum("n").over(down)).join(F.broadcast(known), "q").where(F.col("upto") + F.col("above") >= k)
            hits = {r["q"]: r["at"] for r in upto.groupBy("q").agg(F.max(F.struct("bin", "n", "upto")).alias("at")).collect()}  # one row per query of the wave
            for q in range(len(rows)):
                if q in hits:
                    at = hits[q]
                    low[q] += at["bin"] * width[q]
                    above[q] += at["upto"] - at["n"]
                    span[q] = width[q]
                else:  # fewer than k candidates: all of them are taken
                    done[q], span[q] = True, 1
            if (span == 1).all():
                break
        kth = np.where(done, -bound - 1, low)
        picked = _picked(packed, wave, share(kth), share(np.where(done, 0, k - above)))
        best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        picked.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(folder)
        waves_done += 1
        while shared:
            shared.pop().destroy()
    release(packed, asked)
    result = "query_id long, rank int, vec_id long, score long"
    return spark.read.schema(result).parquet(folder) if waves_done else spark.createDataFrame([], result)


def op9(spark, sf_dir: str) -> DataFrame:
    return top_k(spark, table(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024::DOUBLE * CAST(x AS DOUBLE)) AS DOUBLE)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
"""
