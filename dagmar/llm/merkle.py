"""Merkle fixity audit of WARC-like record files.

A record is a leaf, hashed over its bytes. Leaves lie in ranges of
``RANGE`` bytes of their file by their offset; a range's node hashes its leaves
in order of offset, and ``FAN`` nodes in a row make a node of the next level,
up to one root per file. Ranges are cut by offset alone, so a tree is built by
group sizes that RANGE and FAN bound, whatever a file holds.

An audit joins the two replicas' roots, keeps those that differ, and goes down
level by level into the children of differing nodes only; at the bottom, the
records of differing ranges are compared one by one.

Defined cases: null url or html count as empty; null page_ids are dealt
by their records' hashes to 2 ** 24 files numbered below zero; records of one
id stay in one file, whose offsets no single task adds up; a range or file that one replica lacks counts as different; records
that share an offset are compared as a set; an empty table gives an empty
result; of pages only page_id, url and html are looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dagmar.llm.common import materialise, table

RANGE, FAN, PAGES_PER_FILE = 1 << 16, 16, 512


def record_bytes(url: Column, html: Column) -> Column:
    """A resource record of WARC/1.0 around a page."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def records(pages: DataFrame) -> DataFrame:
    """file, offset, length and hash of every page's record, PAGES_PER_FILE ids to a file, in order of id and hash.

    Equal records of an id are counted, not sorted. An id's records are dealt by the
    first byte of their hashes into blocks, each summed by itself; a file's offsets
    are then a prefix sum over its PAGES_PER_FILE * 256 blocks at most.
    """
    record = record_bytes(F.col("url"), F.col("html"))
    dealt = F.lit(-1) - F.conv(F.substring(F.sha2(record, 256), 1, 6), 16, 10).cast("long")
    file = F.coalesce(F.floor(F.col("page_id") / F.lit(PAGES_PER_FILE)), dealt)
    block = F.struct("file", "page_id", F.substring("hash", 1, 2)).alias("block")  # a struct, as its fields' nulls are equal
    rows = pages.select(file.cast("long").alias("file"), "page_id", F.octet_length(record).cast("long").alias("length"), F.sha2(record, 256).alias("hash"))
    kinds = rows.groupBy("file", "page_id", "hash", "length").agg(F.count("*").alias("n")).select("*", block)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = kinds.groupBy("block").agg(F.sum(F.col("length") * F.col("n")).alias("bytes"))
    base = sums.select("block", F.coalesce(F.sum("bytes").over(before(Window.partitionBy("block.file").orderBy("block"))), F.lit(0)).alias("base"))
    own = F.coalesce(F.sum(F.col("length") * F.col("n")).over(before(Window.partitionBy("block").orderBy("hash"))), F.lit(0))
    placed = kinds.withColumn("own", own).join(base, "block")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy")
    return placed.select("file", "page_id", "length", "hash", "base", "own", copies).select("file", "page_id", "length", "hash", (F.col("base") + F.col("own") + F.col("copy") * F.col("length")).alias("offset"))


def levels(rows: DataFrame, height: int) -> list[DataFrame]:
    """The trees' nodes (file, node, digest), from ranges up to roots."""
    out = []
    nodes = rows.select("file", F.floor(F.col("offset") / F.lit(RANGE)).alias("node"), F.struct("offset", "length", "hash").alias("part"))
    for _ in range(height):
        joined = F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: F.concat_ws(":", *(p[c].cast("string") for c in (("offset", "length", "hash") if not out else ("node", "digest"))))), "\n")
        out.append(nodes.groupBy("file", "node").agg(F.sha2(joined, 256).alias("digest")))
        nodes = out[-1].select("file", F.floor(F.col("node") / F.lit(FAN)).alias("node"), F.struct("node", "digest").alias("part"))
    return out


def audit(spark: SparkSession, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """file, offset, status (corrupt, missing, extra) of the records in which theirs differs from ours.

    ours and theirs: file, offset, length, hash.
    """
    last = max((df.agg(F.max("offset")).first()[0] or 0) // RANGE for df in (ours, theirs))
    height = 1
    while last:
        last, height = last // FAN, height + 1
    trees = [[materialise(spark, level) for level in levels(df, height)] for df in (ours, theirs)]

    def different(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.withColumnRenamed("digest", "other")
        return a.join(b, ["file", "node"], "full").where(~F.col("digest").eqNullSafe(F.col("other"))).select("file", "node")

    open_ = different(trees[0][-1], trees[1][-1])
    for level in range(height - 2, -1, -1):
        above = open_.select("file", F.col("node").alias("_above"))
        below = [t[level].withColumn("_above", F.floor(F.col("node") / F.lit(FAN))).join(above, ["file", "_above"], "left_semi").select("file", "node", "digest") for t in trees]
        open_ = different(*below)
    ranges = materialise(spark, open_)
    sides = [
        df.withColumn("node", F.floor(F.col("offset") / F.lit(RANGE))).join(ranges, ["file", "node"], "left_semi")
        .groupBy("file", "offset").agg(F.array_sort(F.collect_list(F.struct("length", "hash"))).alias(name))
        for df, name in ((ours, "a"), (theirs, "b"))
    ]
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("corrupt")
    return reduce(lambda a, b: a.join(b, ["file", "offset"], "full"), sides).where(~F.col("a").eqNullSafe(F.col("b"))).select("file", "offset", status.alias("status"))


def damaged(rows: DataFrame) -> DataFrame:
    """A replica for the query: some records' bytes changed, some lost, by rules on the id."""
    changed = F.sha2(F.concat(F.lit("x"), "hash"), 256)
    return rows.where(F.coalesce(F.col("page_id") % 101 != 7, F.lit(True))).withColumn("hash", F.when(F.col("page_id") % 97 == 13, changed).otherwise(F.col("hash")))


def op2(spark, sf_dir: str) -> DataFrame:
    """Every page's record with what the audit of a damaged replica says of it."""
    ours = materialise(spark, records(table(spark, sf_dir, "pages")))
    bad = audit(spark, ours, damaged(ours))
    return ours.join(bad, ["file", "offset"], "left").select("page_id", "file", "offset", "length", F.col("hash").alias("record_sha256"), F.coalesce("status", F.lit("ok")).alias("status"))


OP2_SQL = """
WITH r AS (
  SELECT page_id, CAST(floor(page_id / 512.0) AS BIGINT) AS own_file,
         'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
         || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
         || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM pages
), g AS (SELECT page_id, own_file, CAST(strlen(record) AS BIGINT) AS length, sha256(record) AS record_sha256 FROM r),
h AS (SELECT page_id, coalesce(own_file, -1 - CAST('0x' || substr(record_sha256, 1, 6) AS BIGINT)) AS file, length, record_sha256 FROM g)
SELECT page_id, file, length, record_sha256,
       CAST(coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id, record_sha256 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
       CASE WHEN page_id % 101 = 7 THEN 'missing' WHEN page_id % 97 = 13 THEN 'corrupt' ELSE 'ok' END AS status
FROM h
"""
