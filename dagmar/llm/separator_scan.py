"""Token counts of documents in flat, unindexed token files, by a separator scan.

A flat file is ids of a fixed width one after the other, with an end-of-document
id behind each document and no index. Files are cut into blocks; each block is
searched for separators at once (numpy), whatever documents it cuts through. A
prefix scan over the blocks' summaries (separators seen, position of the last
one) then gives every block the number of documents before it and the start of
the document it opens in. The scan has two levels, blocks within a group and
groups within a file, so that one huge file is not one task.

Defined cases: an empty document counts 0 tokens; tokens behind a file's last
separator are a last document that is marked as not terminated; an empty file
has no document. For documents as input: a null or empty text has 0 tokens;
strings of special tokens in a text are ordinary text, so no text holds a
separator; a vocabulary whose ids don't fit a file's width is an error; repeated rows are written each; an empty table gives an empty
result; only doc_id and text are looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dagmar.llm.common import materialise, read_range, shared_dir, table, write_bytes
from dagmar.llm.tokens import TOKENIZER, encoder

END, WIDTH, BLOCK_TOKENS, GROUP = 50256, 2, 1 << 20, 64
#: Tokens of one flat file; a task that has more goes on in a next one.
FILE_TOKENS = 1 << 25


def write_flat(spark: SparkSession, docs: DataFrame, end: int = END, tokenizer: str = TOKENIZER, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Write docs as flat token files; (path, file, tokens, ids) of each, ids being the doc_ids in order.

    Files are named by partition and number, so that a task that runs again writes the same ones.
    """
    folder = shared_dir(spark)

    def run(batches):
        encode, part, number = encoder(tokenizer), TaskContext.get().partitionId(), 0
        held, ids, size = [], [], 0
        if max(encode.size, end + 1) > 1 << 8 * WIDTH:
            raise OverflowError(f"ids up to {max(encode.size - 1, end)} don't fit {WIDTH} bytes")
        close = np.array([end], f"<u{WIDTH}").tobytes()

        def flush():
            path = f"{folder}/tokens-{part:06d}-{number:04d}"
            write_bytes(path, *held)
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([(part << 32) + number], pa.int64()), pa.array([size], pa.int64()), pa.array([ids], pa.list_(pa.int64()))], ["path", "file", "tokens", "ids"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    flat = np.frombuffer(encode.ids(text or ""), "<u4").astype(f"<u{WIDTH}").tobytes() + close
                    held.append(flat)
                    ids.append(doc_id)
                    size += len(flat) // WIDTH
                    if size >= file_tokens:
                        yield flush()
                        held, ids, size, number = [], [], 0, number + 1
        if ids:
            yield flush()

    return materialise(spark, docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "path string, file long, tokens long, ids array<long>"))


def scan(spark: SparkSession, files: DataFrame, end: int = END, width: int = WIDTH, block_tokens: int = BLOCK_TOKENS, group: int = GROUP) -> DataFrame:
    """file, ordinal, start, n_tokens and terminated of every document in files (path, file, tokens)."""
    blocks = (
        files.where("tokens > 0")
        .select("path", "file", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("tokens") - 1) / F.lit(block_tokens)))).alias("block"))
        .repartition(F.col("file"), F.col("block"))
    )

    def run(batches):
        for batch in batches:
            for path, file, tokens, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                start = block * block_tokens
                n = min(block_tokens, tokens - start)
                ids = np.frombuffer(read_range(path, start * width, n * width), f"<u{width}")
                ends = np.flatnonzero(ids == end).astype(np.int32)
                last = int(ends[-1]) + start if len(ends) else None
                yield pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([block], pa.int64()), pa.array([start + n == tokens]), pa.array([tokens], pa.int64()), pa.array([last], pa.int64()), pa.array([len(ends)], pa.int64()), pa.array([ends], pa.list_(pa.int32()))], ["file", "block", "final", "tokens", "last", "n", "ends"])

    found = materialise(spark, blocks.select("path", "file", "tokens", "block").mapInArrow(run, "file long, block long, final boolean, tokens long, last long, n long, ends array<int>"))
    summary = found.select("file", "block", "last", "n", F.floor(F.col("block") / F.lit(group)).alias("group"))
    in_group = Window.partitionBy("file", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    in_file = Window.partitionBy("file").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = summary.groupBy("file", "group").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    groups = groups.select("file", "group", F.sum("n").over(in_file).alias("docs_g"), F.max("last").over(in_file).alias("last_g"))
    local = summary.select("file", "block", "group", F.sum("n").over(in_group).alias("docs_b"), F.max("last").over(in_group).alias("last_b"))
    before = local.join(groups, ["file", "group"]).select("file", "block", (F.coalesce("docs_g", F.lit(0)) + F.coalesce("docs_b", F.lit(0))).alias("docs"), (F.coalesce("last_b", "last_g", F.lit(-1)) + 1).alias("open"))
    # both sides grow with the documents, and compressed arrays look small enough to broadcast: a merge is asked for
    stitched = found.join(before.hint("merge"), ["file", "block"])
    ends = F.transform("ends", lambda e: e + F.col("block") * F.lit(block_tokens))
    starts = F.concat(F.array("open"), F.transform(ends, lambda e: e + 1))
    closed = stitched.select("file", "docs", F.posexplode(F.arrays_zip(F.slice(starts, F.lit(1), F.size("ends")).alias("a"), ends.alias("b"))).alias("i", "d"))
    rest = stitched.where("final").select("file", (F.col("docs") + F.col("n")).alias("ordinal"), F.coalesce(F.col("last") + 1, "open").alias("start"), "tokens")
    return (
        closed.select("file", (F.col("docs") + F.col("i")).alias("ordinal"), F.col("d.a").alias("start"), (F.col("d.b") - F.col("d.a")).alias("n_tokens"), F.lit(True).alias("terminated"))
        .union(rest.where("start < tokens").select("file", "ordinal", "start", F.expr("tokens - start"), F.lit(False)))
    )


def op1(spark, sf_dir: str) -> DataFrame:
    """Token counts of all documents, as the scan finds them in files written without an index; doc_ids come from the writer's list."""
    files = write_flat(spark, table(spark, sf_dir, "documents"))
    ids = files.select("file", F.posexplode("ids").alias("ordinal", "doc_id"))
    counts = scan(spark, files.select("path", "file", "tokens"))
    return counts.join(ids.withColumn("ordinal", F.col("ordinal").cast("long")).hint("merge"), ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens", "terminated")
