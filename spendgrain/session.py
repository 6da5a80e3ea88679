"""Session settings the queries are written for."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

# Sizes decide joins at run time, hot keys are split, and clocks agree.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}

# What one task reads from files, and from a shuffle, stays this small whatever the size of the tables: shuffles are
# dealt into many parts, which Spark merges up to this size. A side of a join whose parts all stay below the threshold
# is hashed part by part, so that the larger side is neither sorted nor spilled.
TASK_BYTES, SHUFFLE_PARTS, HASHED_BYTES = 32 << 20, 1024, 64 << 20
SIZES = {
    "spark.sql.files.maxPartitionBytes": (TASK_BYTES, 128 << 20),
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": (TASK_BYTES, 64 << 20),
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": (HASHED_BYTES, 0),
}


def bounded_tasks(spark: SparkSession) -> None:
    """Let the tasks of the session stay small, where it leaves these settings as Spark has them."""
    for key, (size, default) in SIZES.items():
        if spark.conf.get(key, None) in (None, str(default), f"{default}b", f"{default >> 20}MB"):
            spark.conf.set(key, f"{size}b")
    parts = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    asked = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if spark.conf.get(parts, None) is None and 16 <= asked < SHUFFLE_PARTS:
        spark.conf.set(parts, str(SHUFFLE_PARTS))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and every executor can reach.

    It lies below ``spark.checkpoint.dir``. Where that is unset it lies in the
    warehouse, which a session always has and which executors share as well.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder
