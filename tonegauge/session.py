"""Session defaults, shared scratch space and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # call sites kept per column expression; building a plan of hundreds of them is dominated by it
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app_name: str = "tonegauge", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the engine's defaults; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    overrides = {key.replace("__", "."): value for key, value in conf.items()}
    for key, value in {**DEFAULTS, **overrides}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a fresh local one in local mode only."""
    context = spark.sparkContext
    configured, current = spark.conf.get("spark.checkpoint.dir", None), context.getCheckpointDir()
    if configured or current:
        if not current:  # named after the context had started
            context.setCheckpointDir(configured)
        return configured or current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="tonegauge-")
    context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, never reused."""
    return f"{shared_dir(spark).rstrip('/')}/tonegauge/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: rows, their order and their partitions survive the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: columnar, so later scans take what they need."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
