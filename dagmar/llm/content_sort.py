"""Exact dedup by content sort, in DataFrame functions only.

Sampled splitters (``repartitionByRange``) deal out the rows by the order of
their normalised texts, an external sort puts equal texts side by side, and the
window over each run of equal neighbours, found by comparing whole texts, tells
which row stays. The order is that of a text's first ``PREFIX`` characters, its
SHA-256 and then the whole text, so that the splitters that are sampled to the
driver are short whatever the texts' length.

A text held by more rows than ``hot_limit`` is dealt out in pieces: its rows
get a salt of their ids that takes part in the range partitioning, so that no
task gets more than about that many copies. Such texts are found beforehand by
a count per SHA-256 with partial sums (one row per text and map task is
shuffled), which also gives the largest id and the count over all pieces. At
most ``hot_texts`` texts can be that frequent, which bounds what is broadcast.

Defined cases: a null text counts as empty; a null id is smaller than any
other; of rows that agree in text and id any one stays; an empty table gives an
empty result; other columns pass through whatever their names, and those that
are named like a result column are replaced by it (``first_of_each`` returns
them as they are).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dagmar.llm.common import lower_az, table

PREFIX = 32


RESULTS = ("keep_id", "group_size", "kept", "text_sha256")


def _judged(docs: DataFrame, hot_texts: int, least_hot: int) -> DataFrame:
    """Every row of docs as a struct `row`, with the results."""
    hash_ = lambda text: F.unhex(F.sha2(lower_az(F.col(text)), 256))
    hot_limit = max(least_hot, docs.count() // hot_texts)
    hot = (
        docs.select(hash_("text").alias("hash"), "doc_id")
        .groupBy("hash")
        .agg(F.count("*").alias("all"), F.max("doc_id").alias("largest"))
        .where(F.col("all") > hot_limit)
    )
    salt = lambda doc_id: F.coalesce(F.pmod(F.xxhash64(doc_id), F.ceil(F.col("all") / hot_limit)), F.lit(0))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    order = ("prefix", "hash", "salt")
    dealt = (
        rows.withColumn("hash", hash_("row.text"))
        .join(F.broadcast(hot), "hash", "left")
        .withColumn("salt", salt("row.doc_id"))
        .withColumn("prefix", F.substring(lower_az(F.col("row.text")), 1, PREFIX))
        .repartitionByRange(*order)
        .withColumn("norm", lower_az(F.col("row.text")))
    )
    run = Window.partitionBy(*order, "norm").orderBy(F.col("row.doc_id").desc_nulls_last())
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = dealt.select(
        "row",
        "all",
        "salt",
        F.lower(F.hex("hash")).alias("text_sha256"),
        F.coalesce("largest", F.first("row.doc_id").over(whole)).alias("keep_id"),
        F.coalesce("all", F.count("*").over(whole)).alias("group_size"),
        (F.row_number().over(run) == 1).alias("head"),
    )
    # a group whose ids are all null has its head in the piece that null ids are dealt to
    no_id = F.col("all").isNull() | (F.col("salt") == salt(F.lit(None).cast("long")))
    kept = F.col("head") & F.when(F.col("keep_id").isNull(), no_id).otherwise(F.col("row.doc_id") == F.col("keep_id"))
    return found.select("row", "keep_id", "group_size", F.coalesce(kept, F.lit(False)).alias("kept"), "text_sha256")


def content_sort(docs: DataFrame, hot_texts: int = 100_000, least_hot: int = 64) -> DataFrame:
    """Every row of docs with keep_id, group_size, kept and text_sha256."""
    others = [c for c in docs.columns if c not in RESULTS]
    return _judged(docs, hot_texts, least_hot).select(*(F.col("row").getField(c).alias(c) for c in others), *RESULTS)


def first_of_each(docs: DataFrame, hot_texts: int = 100_000, least_hot: int = 64) -> DataFrame:
    """The rows of docs that stay, with docs' own columns."""
    return _judged(docs, hot_texts, least_hot).where("kept").select("row.*")


def op4(spark, sf_dir: str) -> DataFrame:
    return content_sort(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


OP4_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       coalesce(doc_id = max(doc_id) OVER g, false) AS kept, sha256(norm) AS text_sha256
FROM d WINDOW g AS (PARTITION BY norm)
"""
