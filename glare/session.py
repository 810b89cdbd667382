"""Spark session and checkpoint-directory helpers.

On a cluster the session is built by the platform; these helpers only fill in
settings that are unset, so tests and local runs get sane defaults while the
cluster's own values (shuffle partitions, ``spark.checkpoint.dir``) win.
"""
from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_spark(master: str | None = None, app: str = "glare",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session or build a local one with AQE on."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    b = SparkSession.builder.appName(app)
    if master or not os.environ.get("SPARK_MASTER"):
        b = b.master(master or "local[*]")
    for k, v in _DEFAULTS.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.driver.memory", os.environ.get("GLARE_DRIVER_MEMORY", "16g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    Reads ``spark.checkpoint.dir``; only when it is unset (tests, local runs)
    a scratch folder is created and registered.
    """
    d = spark.sparkContext.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master or ""
        if not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        # local runs and tests only: a scratch folder on this machine
        d = tempfile.mkdtemp(prefix="glare-ckpt-")
    spark.sparkContext.setCheckpointDir(d)
    return spark.sparkContext.getCheckpointDir() or d


#: most bytes of rows that a Python worker is sent at once. Larger buffers are not
#: given back by the executor's JVM, and add up over the jobs of an application
ARROW_BATCH_BYTES = "2m"


def bound_arrow_batches(spark: SparkSession) -> None:
    """Bound the batches of ``mapInArrow`` by their bytes, unless the session has a
    bound of its own (Spark's default is 64 MB). It holds for all later jobs of the
    session; rows and their order stay as they are."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, ARROW_BATCH_BYTES)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (never a local checkpoint),
    so an iterative driver loop does not replay a growing plan and a lost
    executor does not force recomputation from the raw scan."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_MEMO: dict = {}


def memo(spark: SparkSession, key, build):
    """Session-scoped reuse of an intermediate result (a persisted feature
    table, a fitted score model): later entry points of the same application
    read it instead of recomputing, as the study's stages read the previous
    stage's files."""
    k = (spark.sparkContext.applicationId, key)
    if k not in _MEMO:
        _MEMO[k] = build()
    return _MEMO[k]
