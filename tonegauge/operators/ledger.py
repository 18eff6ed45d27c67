"""Job state kept as an append-only table of chunk events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonegauge import constants as K
from tonegauge.operators.ingest import latest_per_key


def latest_states(events: DataFrame, key: str = "chunk_name", order_by: Sequence[str] = ("updated_at",)) -> DataFrame:
    """Last write wins per chunk; entries starting with ``_`` are metadata, not chunks."""
    return latest_per_key(events.where(~F.col(key).startswith("_")), [key], order_by)


def with_previous_batch(
    events: DataFrame, key: str = "chunk_name", batch: str = "batch_id", order_by: Sequence[str] = ("updated_at",),
) -> DataFrame:
    """Latest state per chunk with the batch it replaced (``previous_batch_id``, ``resubmitted``)."""
    place = F.struct(*order_by)
    kept = events.where(~F.col(key).startswith("_"))
    others = [c for c in events.columns if c != key]
    # one reduction of the events, to the latest row of each chunk and batch; the rest works on that
    batches = kept.groupBy(key, batch).agg(F.max(place).alias("_place"), F.max_by(F.struct(*[c for c in others if c != batch]), place).alias("_row"))
    # the latest row, and of the named batches the one or two latest, are among a chunk's first three
    recent = batches.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_place"), F.desc(batch)))).where("_r <= 3")
    per_key = recent.groupBy(key).agg(
        F.min_by(F.struct(batch, "_row"), "_r").alias("_last"),
        F.sort_array(F.collect_list(F.when(F.col(batch).isNotNull(), F.struct("_place", batch))), asc=False).alias("_batches"),
    )
    earlier = F.filter("_batches", lambda b: b[batch] != F.col(f"_last.{batch}"))
    return per_key.withColumn("previous_batch_id", F.get(earlier, F.lit(0))[batch]).select(
        key, F.col(f"_last.{batch}").alias(batch), *[F.col(f"_last._row.{c}").alias(c) for c in others if c not in (batch, "previous_batch_id", "resubmitted")],
        "previous_batch_id", F.col("previous_batch_id").isNotNull().alias("resubmitted"),
    )


def status_class(status: Column, profile: str = "full") -> Column:
    classes = [F.when(status.isin(*states), name) for name, states in K.STATUS_CLASSES[profile].items()]
    return F.coalesce(*classes, F.lit("other"))


def status_rollup(latest: DataFrame, profile: str = "full") -> DataFrame:
    """One row: chunks per status class, total and progress in percent."""
    counts = latest.select(status_class(F.col("status"), profile).alias("_class")).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("_class") == c).alias(c) for c in ("completed", "in_progress", "failed", "other")],
    )
    return counts.withColumn("progress", F.when(F.col("total") > 0, F.col("completed") / F.col("total") * 100).otherwise(F.lit(0.0)))


def status_rollups(latest: DataFrame, profiles: Sequence[str] = ("full", "reduced")) -> DataFrame:
    """``status_rollup`` of several profiles, one row each (column ``profile``), from one pass over the states."""
    classes = ("completed", "in_progress", "failed", "other")
    counts = latest.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(status_class(F.col("status"), p) == c).alias(f"{p}_{c}") for p in profiles for c in classes])
    progress = lambda p: F.when(F.col("total") > 0, F.col(f"{p}_completed") / F.col("total") * 100).otherwise(F.lit(0.0))
    rows = [F.struct(F.lit(p).alias("profile"), "total", *[F.col(f"{p}_{c}").alias(c) for c in classes], progress(p).alias("progress")) for p in profiles]
    return counts.select(F.inline(F.array(*rows)))
