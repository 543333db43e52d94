"""SimHash near-dedup with pivot distance tables.

Every text gets a 64-bit fingerprint; copies of a fingerprint are one node with
its smallest doc_id. Fingerprints within ``LINK`` = 2 bits are linked:

* the pivot distance table holds each fingerprint's Hamming distances to 65
  reference fingerprints: one base and, in each of 4 families, 16 that differ
  from the base in some bits of the family's own 16. Fingerprints within 2 bits
  of each other differ within the bits of 2 families at most, so their distances
  to the references of at least 2 families are, less that to the base, all equal:
  rows that agree in the coordinates of 2 families (6 tables) are candidates.
  (Distances to references without such families are near 32 for almost all
  fingerprints and make no join key.);
* a candidate pair is discarded if any of 17 coordinates differ by more than 2
  (the triangle inequality); the survivors are verified by their own distance;
* a bucket of more than ``BUCKET`` fingerprints makes no pairs. Two
  fingerprints differ in at most 2 bits exactly if some value is within 1 bit of
  both, so each member names its 65 values within 1 bit, and those that name a
  value (65 at most) are linked to the smallest of them. That finds the same
  components, with rows in proportion to the members.

Components are then found by label rounds over the links.

Defined cases: a null text counts as empty; a text without words has
fingerprint zero, linked like any other; one of fewer than three words has its
whole sequence as only shingle; a null doc_id is no component's name unless the
component has no other; repeated rows each get a row; an empty table gives an
empty result; of docs only doc_id and text are looked at, whatever the names of
other columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dagmar.llm.common import LOWER_BYTES, materialise, slices, table
from dagmar.operators.graph import connected_components

SHINGLE, SEED, LINK, BUCKET = 3, 42, 2, 64
FAMILIES, MEMBERS, SALTS = 4, 16, 16
#: Coordinates that discard pairs: the base's and the first few of each family.
SHOWN = 4


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _random(i: int) -> int:
    return xxhash.xxh64_intdigest(i.to_bytes(8, "little"), seed=SEED)


#: The base reference, and those that differ from it in bits of one family each; all by the hash of their number.
BASE = _random(0)
REFERENCES = [[BASE ^ ((_random(1 + f * MEMBERS + m) & 0xFFFF) << 16 * f) for m in range(MEMBERS)] for f in range(FAMILIES)]


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bit i is set if it is set in over half of the shingles' hashes; signed 64 bits."""
    words = text.translate(LOWER_BYTES).split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < shingle:
        return signed(digest(joined, SEED))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        to = min(n, at + (1 << 16))
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at:to].tolist(), ends[at + shingle - 1 : to + shingle - 1].tolist(), strict=True)], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id and fp of every row, with any more columns."""
    frame = docs.select("doc_id", *more, F.coalesce("text", F.lit("")).cast("binary").alias("_text"))
    kept = frame.columns[:-1]

    def run(batches):
        for batch in batches:
            fps = pa.array([fingerprint(t.as_py()) for t in batch.column(len(kept))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], fps], [*kept, "fp"])

    return frame.mapInArrow(run, frame.drop("_text").withColumn("fp", F.lit(0).cast("long")).schema)


def _differ(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def distance_table(fps: DataFrame) -> DataFrame:
    """fps (fp) with the distance to the base, `base`, and those to each family's references, `family` (arrays of bytes)."""
    to = lambda r: _differ(F.col("fp"), F.lit(signed(r))).cast("byte")
    return fps.select("fp", to(BASE).alias("base"), *(F.array(*map(to, family)).alias(f"family{f}") for f, family in enumerate(REFERENCES)))


def _meeting(table: DataFrame, *more: str) -> DataFrame:
    """A row for each choice of two families, with the key of their coordinates less the base's."""
    less = lambda f: F.transform(f"family{f}", lambda d: d - F.col("base"))
    keyed = table.select("*", *(F.xxhash64(less(f)).alias(f"key{f}") for f in range(FAMILIES)))
    choices = [F.struct(F.lit(i * FAMILIES + j).alias("tab"), F.xxhash64(f"key{i}", f"key{j}").alias("key")) for i in range(FAMILIES) for j in range(i + 1, FAMILIES)]
    return keyed.select("fp", *more, F.explode(F.array(*choices)).alias("m")).select("fp", *more, "m.tab", "m.key")


def links(spark: SparkSession, fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (src, dst) between distinct fingerprints fp that have the same components as all pairs within 2 bits."""
    table = distance_table(fps)
    coordinates = ["base", *(f"c{f}_{m}" for f in range(FAMILIES) for m in range(SHOWN))]
    shown = table.select("*", *(F.element_at(f"family{f}", m + 1).alias(f"c{f}_{m}") for f in range(FAMILIES) for m in range(SHOWN)))
    full = _meeting(table).groupBy("tab", "key").agg(F.count("*").alias("n")).where("n > 1")
    # a key of many fingerprints is spread over salts
    full = full.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    dealt = _meeting(shown, *coordinates).withColumn("salt", F.pmod("fp", F.lit(SALTS)))
    met = materialise(spark, dealt.join(full, ["tab", "key", "salt"]).drop("salt"))
    few = met.where(F.col("n") <= bucket).drop("n")
    left = few.select("tab", "key", F.col("fp").alias("src"), *(F.col(c).alias(f"_{c}") for c in coordinates))
    furthest = F.greatest(*(F.abs(F.col(c) - F.col(f"_{c}")) for c in coordinates))
    pairs = (
        left.join(few, ["tab", "key"])
        .where((F.col("src") < F.col("fp")) & (furthest <= LINK))
        .where(_differ(F.col("src"), F.col("fp")) <= LINK)
        .select("src", F.col("fp").alias("dst"))
    )
    near = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(signed(1 << i))) for i in range(64)))
    stars = (
        met.where(F.col("n") > bucket).select("fp").distinct()
        .select("fp", F.explode(near).alias("value"))
        .groupBy("value").agg(F.collect_list("fp").alias("all")).where(F.size("all") > 1)
        .select(F.array_min("all").alias("src"), F.explode("all").alias("dst")).where("src <> dst")
    )
    return pairs.union(stars).distinct()


def components(spark: SparkSession, marked: DataFrame) -> DataFrame:
    """(fp, component, component_id) of every fingerprint in marked (doc_id, fp).

    component is the component's smallest fingerprint, which names it whatever the ids; component_id may be null or shared.
    """
    fps = materialise(spark, marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = connected_components(spark, links(spark, fps)).select(F.col("node").alias("fp"), "component")
    named = materialise(spark, fps.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return named.join(names, "component").select("fp", "component", "component_id")


def near_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id of every row."""
    marked = materialise(spark, fingerprints(docs))
    return marked.join(components(spark, marked), "fp").select("doc_id", "fp", "component_id")


def one_of_each(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs with the smallest doc_id of their component: one row of each component, whole, whatever its columns' names."""
    key = lambda doc_id, text: F.xxhash64(doc_id, text)
    marked = materialise(spark, fingerprints(docs, key("doc_id", "text").alias("key")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    by_print = marked.groupBy("fp").agg(first).select("fp", "first.*")
    stay = by_print.join(components(spark, marked).drop("component_id"), "fp").groupBy("component").agg(first).select("component", "first.doc_id", "first.key")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = rows.withColumn("key", key("row.doc_id", "row.text"))
    found = rows.join(stay, "key").where(F.col("row.doc_id").eqNullSafe(F.col("doc_id")))
    # rows that agree in id and text have met by their key, so this is no further exchange
    return found.dropDuplicates(["key", "component"]).select("row.*")


def op7(spark, sf_dir: str) -> DataFrame:
    found = near_dedup(spark, table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


