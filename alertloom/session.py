"""Session settings the jobs rely on.

The jobs read settings, they do not change a running session: a cluster passes
its own.  ``build_session`` is for tests, the bench and notebooks.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# UTC keeps date_trunc / window boundaries the same everywhere.  Duplicate keys
# in a JSON object: the last one wins, as in the reference's JSON reader.
BASE_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Ids of raw logs are kept for ever: on disk, not on the heap.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Mapping an alert takes most of a millisecond, so a task reads little text.
    "spark.sql.files.maxPartitionBytes": "16m",
}


def build_session(app: str = "alertloom", cpus: int | None = None, **settings: str) -> SparkSession:
    """A local session; pass extra Spark settings as keyword arguments with ``__`` for dots."""
    cores = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cores))
    )
    for key, value in BASE_SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, on whatever file system that is.

    Where it is unset a local session, as in tests, gets a folder of its own; on a
    cluster that would be a folder executors do not share, so the call fails.
    """
    configured = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not configured:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="alertloom-ck-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def scratch(spark: SparkSession, prefix: str) -> str:
    """A new folder name inside the shared folder."""
    return f"{shared_dir(spark)}/{prefix}-{uuid.uuid4().hex}"
