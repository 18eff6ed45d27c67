"""Calendar completion of daily series. Inputs are daily tables: one row per key and day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonegauge import constants as K

COUNT = "speech_count"


def _values(daily: DataFrame, keys: Sequence[str], count: str) -> list[str]:
    return [c for c in daily.columns if c not in (*keys, "date", count)]


def calendar_spine(daily: DataFrame, keys: Sequence[str] = ("country",)) -> DataFrame:
    """Every day from the first to the last of each key, weekends included."""
    spans = daily.where(F.col("date").isNotNull()).groupBy(*keys).agg(F.min("date").alias("_first"), F.max("date").alias("_last"))
    return spans.select(*keys, F.explode(F.sequence("_first", "_last", F.expr("INTERVAL 1 DAY"))).alias("date"))


def fill_calendar(
    daily: DataFrame, keys: Sequence[str] = ("country",), count: str = COUNT,
    end: Column | None = None, extend_only: Sequence[str] | None = None,
) -> DataFrame:
    """Complete each key's calendar, carry values forward and count 0 on filled days.

    Each row is stretched up to the day before its successor, so one sort by key and day serves the
    carrying of values over NULLs, the missing days and the zero counts; no spine is joined.
    ``end`` (see ``common_end``) stretches the last row of each key, or only of those whose first key
    column is in ``extend_only``, to that day.
    """
    ordered = Window.partitionBy(*keys).orderBy("date")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dated = daily.where(F.col("date").isNotNull())
    last_day = F.col("date")
    if end is not None:
        last_day = end if extend_only is None else F.when(F.col(keys[0]).isin(*extend_only), end).otherwise(last_day)
    values = _values(daily, keys, count)
    until = F.coalesce(F.date_sub(F.lead("date").over(ordered), 1), last_day)
    carried = dated.select(
        *keys, F.col("date").alias("_from"), until.alias("_until"),
        *[F.last(c, ignorenulls=True).over(so_far).alias(c) for c in values], F.col(count).alias("_count"),
    )
    stretched = carried.select(
        *keys, F.explode(F.sequence("_from", "_until", F.expr("INTERVAL 1 DAY"))).alias("date"), *values, "_from", "_count"
    )
    filled = F.when(F.col("date") == F.col("_from"), F.coalesce("_count", F.lit(0))).otherwise(F.lit(0)).cast("int")
    return stretched.select(*keys, "date", *values, filled.alias(count))


def common_end(daily: DataFrame) -> Column:
    """Latest day of all keys, as a scalar subquery."""
    return daily.agg(F.max("date")).scalar()


def carry_forward(series: DataFrame, keys: Sequence[str], values: Sequence[str], order: str = "date") -> DataFrame:
    """Last non-NULL value so far, per key; leading NULLs stay."""
    so_far = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return series.withColumns({c: F.last(c, ignorenulls=True).over(so_far) for c in values})


def metric_catalog(spark) -> DataFrame:
    """One row per metric: family, neutral value, range, title and scale note."""
    return spark.createDataFrame(
        list(K.METRIC_CATALOG),
        "metric string, family string, neutral double, low double, high double, title string, scale string",
    ).withColumn(
        "title_with_scale",
        F.when(F.col("scale").isNotNull(), F.concat("title", F.lit(" ("), "scale", F.lit(")"))).otherwise(F.col("title")),
    )


def long_index(index: DataFrame, keys: Sequence[str] = ("country",), count: str = COUNT, catalog: DataFrame | None = None) -> DataFrame:
    """One row per key, day and metric, with the metric's catalogue entry; NULL entries for metrics it does not know.

    ``catalog`` (see ``metric_catalog``) is as long as there are metrics, that is columns, so it is broadcast.
    """
    metrics = [*_values(index, keys, count), count]
    doubles = index.withColumns({c: F.col(c).cast("double") for c in metrics})
    long = doubles.unpivot([*keys, "date"], metrics, "metric", "value")
    return long.join(F.broadcast(catalog if catalog is not None else metric_catalog(index.sparkSession)), "metric", "left")


def calendar_grid(daily: DataFrame, keys: Sequence[str] = ("country",), count: str = COUNT) -> DataFrame:
    """Values for calendar heat maps, per key and year with data.

    Metrics with a neutral value cover all days of those years, missing days at neutral; the others
    keep their own days, with exact zeros of topic and level metrics lifted to a visible value.
    """
    metrics = [*_values(daily, keys, count), count]
    own = daily.withColumns({c: F.col(c).cast("double") for c in metrics}).unpivot([*keys, "date"], metrics, "metric", "value")
    years = daily.select(*keys, F.year("date").alias("_year")).distinct()
    days = F.sequence(F.make_date("_year", F.lit(1), F.lit(1)), F.make_date("_year", F.lit(12), F.lit(31)), F.expr("INTERVAL 1 DAY"))
    diverging = F.array(*[F.struct(F.lit(m[0]).alias("metric"), F.lit(m[2]).alias("neutral")) for m in K.METRIC_CATALOG if m[2] is not None and m[0] in metrics]).cast("array<struct<metric: string, neutral: double>>")
    grid = years.select(*keys, F.explode(days).alias("date")).select(*keys, "date", F.explode(diverging).alias("_m"))
    grid = grid.select(*keys, "date", "_m.metric", F.col("_m.neutral").alias("value"))
    lifted = F.when((F.col("value") == 0) & (F.startswith("metric", F.lit("topic_")) | F.col("metric").isin("uncertainty", "forward_guidance_strength")), F.lit(K.ZERO_DISPLAY_VALUE)).otherwise(F.col("value"))
    present = own.withColumn("value", lifted).withColumn("_own", F.lit(1))
    # own rows win over grid rows: one shuffle of union rows instead of a join
    merged = present.unionByName(grid.withColumn("_own", F.lit(0))).groupBy(*keys, "metric", "date").agg(
        F.max_by("value", "_own").alias("value")
    )
    return merged.withColumn("year", F.year("date"))
