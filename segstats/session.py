"""Session helpers for tests, the bench and the driver tables.

Library operators never create a session: they take DataFrames. These helpers
only build a local session for tests / the bench and locate the shared folder
the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def local_session(
    cores: int | str = "*",
    shuffle_partitions: int | None = None,
    event_log_dir: str | None = None,
    checkpoint_dir: str | None = None,
) -> SparkSession:
    """A local session configured the way the tests and the bench expect.

    ``checkpoint_dir`` becomes ``spark.checkpoint.dir``; operators that keep
    intermediate results need one. Checkpoints are removed once nothing refers
    to them.
    ``event_log_dir`` turns on Spark's event log there (stage and task times
    without the web UI, which stays off).
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("segstats")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("SEGSTATS_DRIVER_MEMORY", "8g"))
    )
    if event_log_dir:
        builder = builder.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", event_log_dir)
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder that the session names in ``spark.checkpoint.dir``."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    spark.sparkContext.setCheckpointDir(configured)
    return spark.sparkContext.getCheckpointDir()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location, visible to every executor."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"
