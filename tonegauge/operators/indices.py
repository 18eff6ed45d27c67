"""Daily indices per group: means, diffusion indices and counts in one aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonegauge import constants as K


def diffusion_index(values: Column, valid_only: bool = False) -> Column:
    """Aggregate: share of ``rise`` plus half the share of ``neutral``, in percent.

    The denominator counts every row, also NULLs and other labels; ``valid_only`` counts the three
    known labels only and gives NULL where there are none.
    """
    rows = F.count_if(values.isin(*K.IMPACT_DOMAIN)) if valid_only else F.count(F.lit(1))
    points = F.count_if(values == "rise") + F.lit(0.5) * F.count_if(values == "neutral")
    return F.try_divide(points * 100, rows.cast("double"))


def diffusion_name(column: str) -> str:
    return column.replace("market_impact_", "") + "_diffusion_index"


def daily_aggregates(means: Sequence[str] = K.MEAN_METRICS, impacts: Sequence[str] = K.IMPACT_METRICS, valid_only: bool = False) -> list[Column]:
    return [
        *[F.avg(c).alias(c) for c in means],
        *[diffusion_index(F.col(c), valid_only).alias(diffusion_name(c)) for c in impacts],
        F.count(F.lit(1)).cast("int").alias("speech_count"),
    ]


def daily_indices(
    prepared: DataFrame, keys: Sequence[str] = ("country",), date: str = "date",
    means: Sequence[str] = K.MEAN_METRICS, impacts: Sequence[str] = K.IMPACT_METRICS, valid_only: bool = False,
) -> DataFrame:
    """Sparse index: one row per group and day that has rows. Rows without a date are left out."""
    return (
        prepared.where(F.col(date).isNotNull())
        .groupBy(*keys, F.col(date).alias("date"))
        .agg(*daily_aggregates(means, impacts, valid_only))
    )


def index_coverage(index: DataFrame, keys: Sequence[str] = ("country",)) -> DataFrame:
    """Days, days with rows, filled days, rows in all and per covered day."""
    count = F.col("speech_count")
    return index.groupBy(*keys).agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.count(F.lit(1)).alias("total_days"),
        F.count_if(count > 0).alias("days_with_speeches"), F.count_if(count == 0).alias("days_filled"),
        F.sum(count).alias("total_speeches"),
        F.avg(F.when(count > 0, count)).alias("avg_per_date"),
    )


def index_summary(
    index: DataFrame, keys: Sequence[str] = ("country",), metrics: Sequence[str] = K.INDEX_METRICS,
) -> DataFrame:
    """Long form: mean and sample standard deviation per group and metric."""
    long = index.select(*keys, *metrics).unpivot(list(keys), list(metrics), "metric", "value")
    return long.groupBy(*keys, "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
