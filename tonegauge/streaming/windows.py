"""Daily indices kept by a stream: tumbling windows of a day under a watermark, an upserting sink, late rows set aside.

Two streams run one after the other. The first is stateless: it splits each micro-batch at the watermark that the batches
before it have set, so rows that come too late are kept in a table instead of being dropped in silence. The second takes
in what was accepted, whole batches of the first at a time, and keeps one window per group and day as state; its own
watermark can only be behind the first one's, so it drops nothing. Windows that changed replace their rows in the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonegauge import constants as K
from tonegauge.operators.indices import daily_aggregates
from tonegauge.session import settle
from tonegauge.sources.tables import exists, upsert
from tonegauge.streaming.ingest import BATCH, batch_name, run_batches, write_batch


def split_late(records: DataFrame, accepted: str, late: str, marks: str, checkpoint: str, delay_days: int, date: str = "date") -> None:
    """Rows of a stream of records, split into ``accepted`` and ``late`` tables.

    A row is late if its date lies more than ``delay_days`` before the latest date of the micro-batches before its own; a
    row without a date is late always. ``marks`` holds the latest date of every batch, one row each.
    """
    spark = records.sparkSession

    def each(rows: DataFrame, number: int) -> None:
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            before = None
            if exists(spark, marks):
                # a replayed batch must not see its own mark
                seen = spark.read.schema(f"latest date, number bigint, {BATCH} string").parquet(marks)
                before = seen.where(F.col("number") < number).agg(F.max("latest")).first()[0]
            mark = F.date_sub(F.lit(before).cast("date"), delay_days)
            late_row = F.col(date).isNull() | F.coalesce(F.col(date).cast("date") < mark, F.lit(False))
            name = batch_name(rows, number)
            write_batch(rows.where(late_row), late, name)
            write_batch(rows.where(~late_row), accepted, name)
            write_batch(rows.agg(F.max(F.col(date).cast("date")).alias("latest"), F.lit(number).cast("bigint").alias("number")), marks, name)
        finally:
            rows.unpersist()

    run_batches(records, checkpoint, each)


def daily_windows(
    records: DataFrame, keys: Sequence[str] = ("country",), date: str = "date", delay_days: int = 0,
    means: Sequence[str] = K.MEAN_METRICS, impacts: Sequence[str] = K.IMPACT_METRICS,
) -> DataFrame:
    """Streaming ``daily_indices``: windows of one day with their aggregates so far (for the update mode)."""
    timed = records.withColumn("_time", F.col(date).cast("timestamp")).withWatermark("_time", f"{delay_days} days")
    found = timed.groupBy(*keys, F.window("_time", "1 day").alias("_day")).agg(*daily_aggregates(means, impacts))
    return found.withColumn("date", F.col("_day.start").cast("date")).drop("_day")


def collect_daily_index(
    spark: SparkSession, inbox: str, schema: str, folder: str, delay_days: int, keys: Sequence[str] = ("country",),
    max_files: int = 1000, means: Sequence[str] = K.MEAN_METRICS, impacts: Sequence[str] = K.IMPACT_METRICS,
) -> None:
    """Take in every new Parquet file of ``inbox`` and bring the daily index below ``folder`` up to date, then stop.

    Tables below ``folder``: ``index`` (in months), ``late``, ``accepted`` and ``marks``. A run that failed is repeated: files,
    batches and windows count once.
    """
    root = folder.rstrip("/")
    arrivals = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(inbox)
    split_late(arrivals, f"{root}/accepted", f"{root}/late", f"{root}/marks", f"{root}/checkpoint/arrivals", delay_days)
    # no limit of files: a batch of the first stream is never cut in two
    accepted = spark.readStream.schema(f"{schema}, {BATCH} string").parquet(f"{root}/accepted")
    windows = daily_windows(accepted, keys, "date", delay_days, means, impacts)

    def put(rows: DataFrame, number: int) -> None:
        # changed windows are read more than once below, the state must not be updated again for it
        upsert(settle(rows, "windows"), f"{root}/index", [*keys, "date"])

    query = windows.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{root}/checkpoint/windows")
    query.trigger(availableNow=True).start().awaitTermination()
