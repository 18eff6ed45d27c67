"""Counts, distributions and completeness of prepared records.

Group totals are folded from counts already reduced per group and value or per group and month, so
what grouping sets and cubes expand is the reduced table, not the input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonegauge import constants as K
from tonegauge.operators.quantiles import exact_quantiles
from tonegauge.session import cut_lineage


def _rows() -> Column:
    return F.count(F.lit(1))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first; NULLs are not counted."""
    present = df.where(F.col(column).isNotNull())
    return present.groupBy(column).agg(_rows().alias("count")).orderBy(F.desc("count"), column)


def year_counts(df: DataFrame, date: str = "date", last: int | None = 10) -> DataFrame:
    """Rows per year, newest first; the last ``last`` years."""
    years = df.where(F.col(date).isNotNull()).groupBy(F.year(date).alias("year")).agg(_rows().alias("count")).orderBy(F.desc("year"))
    return years if last is None else years.limit(last)


def month(date: str = "date") -> Column:
    return F.trunc(F.col(date), "month")


def month_counts(df: DataFrame, date: str = "date", keys: Sequence[str] = ()) -> DataFrame:
    dated = df.where(F.col(date).isNotNull())
    return dated.groupBy(*keys, month(date).alias("month")).agg(_rows().alias("count"))


def describe_dataset(df: DataFrame, date: str = "date", group: str = "country") -> DataFrame:
    """One row: rows, distinct groups, first and last date, span in days, number of columns."""
    return df.agg(
        _rows().alias("total_rows"), F.count_distinct(group).alias("groups"),
        F.min(date).alias("earliest"), F.max(date).alias("latest"),
        F.date_diff(F.max(date), F.min(date)).cast("bigint").alias("span_days"),
        F.lit(len(df.columns)).alias("columns"),
    )


def dataset_contents(df: DataFrame, date: str = "date", group: str = "country") -> DataFrame:
    """What ``describe_dataset`` counts, in full: part (column, group or year), label, place of a column, rows.

    One scan: rows are counted per group and year, and the few counts are folded to each. NULL groups and dates have no row.
    """
    cells = df.groupBy(F.col(group).cast("string").alias("g"), F.year(date).cast("string").alias("y")).agg(_rows().alias("n"))
    sides = F.explode(F.array(*[F.struct(F.lit(part).alias("part"), F.col(c).alias("label")) for part, c in (("group", "g"), ("year", "y"))])).alias("side")
    folded = cells.select(sides, "n").where("side.label IS NOT NULL").groupBy("side.part", "side.label").agg(F.sum("n").alias("rows"))
    columns = df.sparkSession.createDataFrame([("column", name, i) for i, name in enumerate(df.columns)], "part string, label string, place int")
    return columns.withColumn("rows", F.lit(None).cast("bigint")).unionByName(folded.withColumn("place", F.lit(None).cast("int")))


def date_span(df: DataFrame, date: str = "date") -> DataFrame:
    return df.agg(
        F.min(date).alias("first_date"), F.max(date).alias("last_date"),
        F.date_diff(F.max(date), F.min(date)).cast("bigint").alias("days"),
    )


def month_crosstab(df: DataFrame, group: str = "country", date: str = "date") -> DataFrame:
    """Long crosstab with margins; only cells with rows appear.

    ``Total`` labels a margin, and ``all_months`` and ``all_groups`` mark it, so a group named ``Total`` stays apart.
    """
    label = lambda c: F.when(F.grouping(c) == 1, F.lit("Total")).otherwise(F.col(c))
    cells = month_counts(df, date, [group]).withColumn("month", F.date_format("month", "yyyy-MM"))
    return cells.where(F.col(group).isNotNull()).cube("month", group).agg(
        F.sum("count").alias("count"), label("month").alias("_m"), label(group).alias("_g"),
        (F.grouping("month") == 1).alias("all_months"), (F.grouping(group) == 1).alias("all_groups"),
    ).select(F.col("_m").alias("month"), F.col("_g").alias(group), "count", "all_months", "all_groups")


def month_crosstab_wide(df: DataFrame, groups: Sequence[str], group: str = "country", date: str = "date") -> DataFrame:
    """Wide crosstab: one column per group and ``Total``, a ``Total`` row, 0 where there are no rows."""
    long = month_crosstab(df, group, date)
    cell = lambda test: F.coalesce(F.sum(F.when(test, F.col("count"))), F.lit(0))
    own = [cell(~F.col("all_groups") & (F.col(group) == name)).alias(name) for name in groups if name != "Total"]
    return long.groupBy("month").agg(*own, cell(F.col("all_groups")).alias("Total"))


def busy_days(df: DataFrame, group: str = "country", date: str = "date", more_than: int = 1) -> DataFrame:
    dated = df.where(F.col(date).isNotNull() & F.col(group).isNotNull())
    return dated.groupBy(F.col(date).alias("date"), group).agg(_rows().alias("count")).where(F.col("count") > more_than)


def busiest_days(df: DataFrame, group: str = "country", date: str = "date", k: int = 10) -> DataFrame:
    return busy_days(df, group, date).orderBy(F.desc("count"), "date", group).limit(k)


def day_load(df: DataFrame, date: str = "date") -> DataFrame:
    """Mean, median and maximum of rows per day, and days with one or with more rows.

    Days are as few as the calendar has, and equal counts fold, so the median's state stays small.
    """
    per_day = df.where(F.col(date).isNotNull()).groupBy(date).agg(_rows().alias("_c"))
    return per_day.agg(
        F.avg("_c").alias("mean"), F.median("_c").alias("median"), F.max("_c").alias("max"),
        F.count_if(F.col("_c") == 1).alias("days_with_one"), F.count_if(F.col("_c") >= 2).alias("days_with_more"),
    )


def distinct_dates(df: DataFrame, date: str = "date") -> DataFrame:
    """Unique days and months."""
    days = df.where(F.col(date).isNotNull()).select(F.col(date).cast("date").alias("_d")).distinct()
    return days.agg(_rows().alias("unique_dates"), F.count_distinct(month("_d")).alias("unique_months"))


def describe_by_group(
    df: DataFrame, metrics: Sequence[str] = K.MEAN_METRICS, group: str = "country",
) -> DataFrame:
    """Rows, mean, sample deviation, minimum, quartiles and maximum per metric: OVERALL and per group.

    ``rows`` counts all rows of the group, also those whose metric is NULL. ``is_total`` marks the rows
    of all groups together, so a group that bears their label stays apart. All metrics are reduced in one
    pass over grouping sets; quartiles are picked by rank from folded counts.
    """
    points = [0.25, 0.5, 0.75]
    values = df.select(F.col(group).alias("_g"), *[F.col(m).cast("double").alias(m) for m in metrics])
    aggregates = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    sets = values.groupingSets([[], [F.col("_g")]], F.col("_g")).agg(
        _rows().alias("rows"), F.grouping("_g").alias("_all"),
        *[f(m).alias(f"{name}_{m}") for m in metrics for name, f in aggregates.items()],
    ).where((F.col("_all") == 1) | F.col("_g").isNotNull())
    stats = [F.struct(F.lit(m).alias("metric"), *[F.col(f"{name}_{m}").alias(name) for name in aggregates]) for m in metrics]
    label = F.when(F.col("_all") == 1, F.lit("OVERALL")).otherwise(F.col("_g"))
    moments = sets.select(label.alias("group"), (F.col("_all") == 1).alias("is_total"), "rows", F.inline(F.array(*stats)))

    long = values.unpivot(["_g"], list(metrics), "metric", "value")
    # equal values fold before they are copied for all groups together
    folded = long.where(F.col("value").isNotNull()).groupBy("_g", "metric", "value").agg(_rows().alias("_c"))
    own = F.struct(F.col("_g").alias("group"), F.lit(False).alias("is_total"))
    labels = F.array(F.struct(F.lit("OVERALL").alias("group"), F.lit(True).alias("is_total")), own)
    spread = folded.select(F.explode(labels).alias("_l"), "metric", "value", "_c").where("_l.group IS NOT NULL")
    quartiles = exact_quantiles(spread.select("_l.group", "_l.is_total", "metric", "value", "_c"), ["group", "is_total", "metric"], "value", points, "_c")
    return moments.join(quartiles, ["group", "is_total", "metric"], "left").select(
        "group", "is_total", "metric", "rows", "mean", "std", "min",
        F.col("q_0").alias("p25"), F.col("q_1").alias("p50"), F.col("q_2").alias("p75"), "max",
    )


def group_difference(
    df: DataFrame, first: str, second: str, metrics: Sequence[str] = K.MEAN_METRICS, group: str = "country", threshold: float = 10,
) -> DataFrame:
    """Mean of ``first`` minus mean of ``second`` per metric, flagged above ``threshold``."""
    long = df.where(F.col(group).isin(first, second)).select(group, *[F.col(m).cast("double").alias(m) for m in metrics])
    means = long.unpivot([group], list(metrics), "metric", "value").groupBy("metric").agg(
        F.avg(F.when(F.col(group) == first, F.col("value"))).alias("_a"),
        F.avg(F.when(F.col(group) == second, F.col("value"))).alias("_b"),
    )
    difference = F.col("_a") - F.col("_b")
    return means.select("metric", difference.alias("difference"), (F.abs(difference) > threshold).alias("substantial"))


def category_shares(df: DataFrame, columns: Sequence[str] = K.IMPACT_METRICS, group: str = "country") -> DataFrame:
    """Count and percentage of all rows per value: OVERALL and per group; NULL counts in the base only."""
    long = df.select(F.col(group).alias("_g"), *columns).unpivot(["_g"], list(columns), "column", "value")
    counted = long.groupBy("_g", "column", "value").agg(_rows().alias("_c"))
    # cut, so that the input is scanned once for the counts and for their base
    levels = F.array_compact(F.array(F.lit("OVERALL"), F.col("_g")))
    spread = cut_lineage(counted).select(F.explode(levels).alias("group"), "column", "value", "_c")
    both = spread.groupBy("group", "column", "value").agg(F.sum("_c").alias("count"))
    base = spread.groupBy("group", "column").agg(F.sum("_c").alias("_total"))
    return both.where(F.col("value").isNotNull()).join(base, ["group", "column"]).select(
        "group", "column", "value", "count", (F.col("count") / F.col("_total") * 100).alias("percent")
    )


def missing_profile(df: DataFrame, columns: Sequence[str] = K.KEY_COLUMNS) -> DataFrame:
    """NULLs per column, count and percent, and a ``TOTAL`` row."""
    present = [c for c in columns if c in df.columns]
    flags = [F.count_if(F.col(c).isNull()).alias(c) for c in present]
    counts = df.agg(_rows().alias("_n"), *flags)
    total = sum((F.col(c) for c in present), start=F.lit(0))
    long = counts.withColumn("TOTAL", total).unpivot(["_n"], [*present, "TOTAL"], "column", "missing")
    share = F.when(F.col("column") != "TOTAL", F.try_divide(F.col("missing") * 100.0, F.col("_n").cast("double")))
    return long.select("column", "missing", share.alias("percent"))


def invalid_dates(coerced: DataFrame, column: str = "date") -> DataFrame:
    """Dates that were given but could not be read, of all rows."""
    return coerced.agg(_rows().alias("rows"), F.count_if(F.col(column).isNull()).alias("invalid_dates"))


def score_distribution(
    df: DataFrame, metrics: Sequence[str] = ("hawkish_dovish_score", "uncertainty", "forward_guidance_strength"),
) -> DataFrame:
    """Mean, median, deviation, range and stance buckets per metric; NULLs are dropped.

    Buckets are filled for the first metric only.
    """
    long = df.select(F.lit(0).alias("_all"), *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        ["_all"], list(metrics), "metric", "value"
    ).where(F.col("value").isNotNull()).drop("_all")
    v = F.col("value")
    bucket = {
        "very_dovish": v < -50, "dovish": (v >= -50) & (v < -10), "neutral": (v >= -10) & (v <= 10),
        "hawkish": (v > 10) & (v <= 50), "very_hawkish": v > 50,
    }
    moments = long.groupBy("metric").agg(
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        *[F.count_if(test).alias(name) for name, test in bucket.items()],
    )
    medians = exact_quantiles(long, ["metric"], "value", [0.5])
    moments = moments.join(medians.withColumnRenamed("q_0", "median"), "metric", "left")
    first = F.col("metric") == metrics[0]
    return moments.select(
        "metric", "mean", "median", "std", "min", "max", *[F.when(first, F.col(name)).alias(name) for name in bucket]
    )


def most_active_month(df: DataFrame, group: str = "country", date: str = "date") -> DataFrame:
    """Month with most rows per group, the earliest among equals."""
    counts = month_counts(df, date, [group])
    rank = F.struct("count", (-F.unix_date("month")).alias("earlier"))
    return counts.groupBy(group).agg(F.max_by("month", rank).alias("month"), F.max("count").alias("count"))


def average_per_month(df: DataFrame, group: str = "country", date: str = "date") -> DataFrame:
    """Rows of a group divided by the distinct months of all groups."""
    counts = cut_lineage(month_counts(df, date, [group]))  # used twice
    months = counts.agg(F.count_distinct("month")).scalar()
    return counts.groupBy(group).agg(F.sum("count").alias("total")).withColumn("avg_per_month", F.col("total") / months)
