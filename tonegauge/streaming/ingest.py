"""Responses that arrive file by file, taken in once each.

The file source's checkpoint is the record of files already parsed; a restarted run goes on where
the last one ended.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from tonegauge.operators.parse import classify_responses, flatten_content, quarantine, usable

BATCH = "batch"


def response_stream(spark: SparkSession, inbox: str, max_files: int = 1000) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(inbox).withColumnRenamed("value", "raw")


def parsed_stream(lines: DataFrame, profile: str = "full") -> DataFrame:
    """Stateless: every line is parsed and flattened on its own; ``collect_responses`` keeps the others too."""
    return flatten_content(usable(classify_responses(lines, profile=profile)), profile)


def batch_name(df: DataFrame, number: int) -> str:
    """Name of a micro-batch: the stream (as its checkpoint knows it) and the number, the same when it is replayed."""
    stream = df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "stream"
    return f"{stream}-{number:09d}"


def write_batch(df: DataFrame, table: str, batch: str) -> None:
    """The rows of one micro-batch as a folder of their own: a replayed batch replaces what it had written."""
    df.write.mode("overwrite").parquet(f"{table.rstrip('/')}/{BATCH}={batch}")


def run_batches(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> int:
    """Everything that is there, micro-batch by micro-batch, then stop: the number of input rows read."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(progress["numInputRows"] for progress in query.recentProgress)


def collect_responses(
    spark: SparkSession, inbox: str, table: str, checkpoint: str, profile: str = "full", max_files: int = 1000,
    set_aside: str | None = None,
) -> int:
    """Append everything new in ``inbox`` to the Parquet table, then stop; the number of lines read.

    Each file is read and each line is parsed once for both outputs: flat records go to ``table``, lines that cannot be
    used to ``set_aside`` (by default beside it). Both tables are folders of micro-batches (column ``batch``), so a batch
    that is replayed after a failure adds no row, and one stream with one checkpoint keeps the two in step.
    """
    aside = set_aside or f"{table.rstrip('/')}_set_aside"

    def both(lines: DataFrame, number: int) -> None:
        parsed = classify_responses(lines, profile=profile).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            name = batch_name(lines, number)
            write_batch(flatten_content(usable(parsed), profile), table, name)
            write_batch(quarantine(parsed), aside, name)
        finally:
            parsed.unpersist()

    return run_batches(response_stream(spark, inbox, max_files), checkpoint, both)
