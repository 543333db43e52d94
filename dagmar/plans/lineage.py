"""Cutting lineage: tables written into the folder that driver and executors share.

The folder is the session's spark.checkpoint.dir, resolved on the file system
that Hadoop's configuration names. Where it is unset, a session in local mode,
which has one machine, gets a temporary folder; on a cluster that raises, as
another executor would not see it. A written table survives the loss of any
executor, which an executor-local copy does not.

Folders go when they are no longer needed: loops release a round once the next
is written, ``clear`` releases all, and what is left goes as the driver ends.

The planner takes a table's size from its files, and columns of ids compress to
a tenth or a hundredth of what they are as rows, so that it would broadcast
millions of them through the driver. Rows are therefore counted as they are
written, and tables of more than BROADCAST_ROWS carry a hint against it.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A written table of more rows is joined by shuffles: three ids a row are then about 6 MB, less than the planner's 10.
BROADCAST_ROWS = 200_000

#: Folders of this process that may still be there, with the session that made each.
_made: dict[str, SparkSession] = {}


@lru_cache(1)
def _own_folder() -> str:
    """A temporary folder for local mode, which goes with this process."""
    folder = tempfile.mkdtemp(prefix="dagmar-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def _base(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    master = spark.conf.get("spark.master", "")
    if master == "local" or master.startswith("local["):
        return "file://" + _own_folder()
    raise RuntimeError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")


def _resolved(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path with its scheme."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return store, store.makeQualified(at)


def shared_dir(spark: SparkSession) -> str:
    """The URI of a new folder below spark.checkpoint.dir."""
    _, at = _resolved(spark, f"{_base(spark).rstrip('/')}/dagmar-{uuid.uuid4().hex}")
    path = at.toString()
    _made[path] = spark
    return path


def written(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Write df and read it again; reruns of what follows start at the written files."""
    path = shared_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._dagmar_folder = path
    return out


def by_shuffles(df: DataFrame) -> DataFrame:
    """df as a side of joins that never broadcast. The hint holds up to the next join or union above df."""
    return df.hint("merge")


def materialise(spark: SparkSession, df: DataFrame) -> DataFrame:
    """written(), joined by shuffles if there are more than BROADCAST_ROWS rows."""
    rows = Observation()
    read = written(spark, df.observe(rows, F.count(F.lit(1)).alias("n")))
    if rows.get.get("n", BROADCAST_ROWS + 1) <= BROADCAST_ROWS:
        return read
    out = by_shuffles(read)
    out._dagmar_folder = read._dagmar_folder
    return out


def remove(path: str) -> None:
    """Delete a folder of shared_dir, which nothing may read any more."""
    spark = _made.pop(path, None)
    if spark is not None:
        store, at = _resolved(spark, path)
        store.delete(at, True)


def release(*tables: DataFrame) -> None:
    """Delete what materialise wrote for these tables. Nothing that is computed later may read them."""
    for df in tables:
        path = df.__dict__.get("_dagmar_folder")
        if path:
            remove(path)


def clear() -> None:
    """Delete all folders of this process: once no result that reads them is still to be computed."""
    for path in list(_made):
        remove(path)


@atexit.register
def _clear_at_exit() -> None:
    try:
        clear()
    except Exception:  # noqa: BLE001 - the session may be gone by now
        _made.clear()
