"""Helpers shared by the operators: table access, shared tables, worker state."""
from __future__ import annotations

import sys
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glare.session import checkpoint_dir

#: White_Space of Unicode, as the tokenizer files' regular expressions read ``\\s``
SPACE = "\t-\r \x85\xa0  -     　"
#: the word pattern of the contracts: ASCII white space separates words
ASCII_SPACE = "[\\x20\\x09-\\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, what: str) -> str:
    """A fresh folder name below the cluster's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends there, a lost
    executor does not lose the rows, and nothing of the producer's partitioning
    is assumed by later joins (so that skewed ones can be split)."""
    spark = df.sparkSession
    path = shared_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def worker_store(owner: str) -> dict:
    """Per-process dictionary of a Python worker: loaded models and caches
    outlive one task, whatever way the calling function was shipped. Workers are
    shared by all jobs of an application, so it belongs to one owner at a time:
    the next operator does not carry the caches of the one before."""
    store = sys.__dict__.setdefault("_glare_worker_store", {})
    if store.get("owner") != owner:
        store.clear()
        store["owner"] = owner
        pa.default_memory_pool().release_unused()
    return store


def bounded(cache: dict, most: int) -> dict:
    """Empty a cache that has outgrown its bound (entries are recomputed)."""
    if len(cache) > most:
        cache.clear()
    return cache


def slices(batch: pa.RecordBatch, most: int = 256):
    """Small pieces of a batch, so that few of its values are Python objects at once."""
    for at in range(0, batch.num_rows, most):
        yield batch.slice(at, most)


def slices_of_bytes(batch: pa.RecordBatch, column: int, most: int = 8 << 20):
    """Pieces of a batch whose values of a column (no nulls) have at most that many
    bytes together, or are a single row."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        held = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, held + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; a bare path is local."""
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)




#: most rows of ids that are broadcast (8 bytes each); more are joined by shuffle
BROADCAST_IDS = 1_000_000


def semi(rows: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows whose ``on`` is among ``ids`` (a written table): broadcast if they are
    few by count, else a shuffled semi-join; same rows either way."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return rows.join(ids, on, "leftsemi")


def anti(rows: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows whose ``on`` is null or not among ``ids`` (a written table)."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return rows.join(ids, on, "leftanti")
