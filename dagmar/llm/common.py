"""What the operators share: the shared folder, file access from executors, text rules."""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dagmar.plans.lineage import release, shared_dir
from dagmar.plans.lineage import written as materialise

__all__ = ["LOWER_BYTES", "WORD", "id_crc32", "local_path", "lower_az", "map_bytes", "materialise", "read_range", "release", "shared_dir", "slices", "table", "write_bytes"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: bytes.translate table that lower-cases A-Z and nothing else.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
#: A word is a run of anything but these; bytes.split() splits at exactly these.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_az(text: Column) -> Column:
    """A-Z in lower case, all else as it is; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def id_crc32(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def slices(batches, text: int, most: int):
    """The batches cut into parts of about `most` bytes of the column at place `text`, whatever the rows' lengths; a longer value is a part of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        upto = np.cumsum(np.asarray(pc.binary_length(batch.column(text)).fill_null(0)), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            so_far = int(upto[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(upto, so_far + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def local_path(uri: str) -> str | None:
    """The plain path behind a file: URI, None for another store."""
    parts = urlparse(uri)
    return parts.path if parts.scheme in ("", "file") else None


def write_bytes(uri: str, *chunks) -> None:
    """Write a file from an executor; a retried task replaces it whole, so that readers never see a part of it."""
    path = local_path(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            for c in chunks:
                f.write(c)
        os.replace(part, path)
        return
    store, at = _filesystem(uri)
    store.create_dir(os.path.dirname(at), recursive=True)
    with store.open_output_stream(at) as f:
        for c in chunks:
            f.write(c)


def map_bytes(uri: str) -> np.ndarray:
    """The file's bytes: memory-mapped in a file system, read whole from another store."""
    path = local_path(uri)
    if path is not None:
        return np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.zeros(0, np.uint8)
    store, at = _filesystem(uri)
    with store.open_input_file(at) as f:
        return np.frombuffer(f.read(), np.uint8)


def read_range(uri: str, start: int, length: int) -> bytes:
    path = local_path(uri)
    if path is not None:
        with open(path, "rb") as f:
            f.seek(start)
            return f.read(length)
    store, at = _filesystem(uri)
    with store.open_input_file(at) as f:
        f.seek(start)
        return f.read(length)
