"""A daily index kept up to date: deliveries add to the sums of their days, and only what that changes is computed anew.

Three tables below one folder, all in months: ``parts`` (sums and counts per delivery, group and day), ``daily`` (the sparse
index) and ``index`` (the calendar-complete one). A delivery writes its own parts, which a repeated delivery replaces; the
days it touches are added up from the parts of their months; and the calendar is rewritten from each touched day to the day
before the next one on which every value is known, for beyond that day nothing is carried.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonegauge import constants as K
from tonegauge.operators.calendar import COUNT, fill_calendar
from tonegauge.operators.indices import diffusion_name
from tonegauge.session import settle
from tonegauge.sources.tables import MONTH, exists, month_of, read_months, touched_months, upsert


def day_parts(records: DataFrame, keys: Sequence[str], means: Sequence[str], impacts: Sequence[str], date: str = "date") -> DataFrame:
    """What one delivery adds to each group and day: sums that merge by addition."""
    return records.where(F.col(date).isNotNull()).groupBy(*keys, F.col(date).cast("date").alias("date")).agg(
        *[F.sum(F.col(m).cast("double")).alias(f"{m}_sum") for m in means], *[F.count(m).alias(f"{m}_n") for m in means],
        *[F.count_if(F.col(i) == label).alias(f"{i}_{label}") for i in impacts for label in ("rise", "neutral")], F.count("*").alias("rows"),
    )


def finish_parts(parts: DataFrame, keys: Sequence[str], means: Sequence[str], impacts: Sequence[str]) -> DataFrame:
    """The sparse daily index from any number of parts of each group and day."""
    sums = [c for c in parts.columns if c not in (*keys, "date")]
    whole = parts.groupBy(*keys, "date").agg(*[F.sum(c).alias(c) for c in sums])
    share = lambda i: ((F.col(f"{i}_rise") + 0.5 * F.col(f"{i}_neutral")) * 100 / F.col("rows")).cast("double")
    return whole.select(
        *keys, "date", *[F.try_divide(f"{m}_sum", F.col(f"{m}_n").cast("double")).alias(m) for m in means],
        *[share(i).alias(diffusion_name(i)) for i in impacts], F.col("rows").cast("int").alias(COUNT),
    )


def _same(keys: Sequence[str], left: str, right: str) -> Column:
    on = F.lit(True)
    for key in keys:
        on = on & F.col(f"{left}.{key}").eqNullSafe(F.col(f"{right}.{key}"))
    return on


def update_index(
    records: DataFrame, folder: str, delivery: str, keys: Sequence[str] = ("country",), date: str = "date",
    means: Sequence[str] = K.MEAN_METRICS, impacts: Sequence[str] = K.IMPACT_METRICS,
) -> None:
    """Add one delivery of records to the index below ``folder``; repeating it under the same name changes nothing.

    Rows without a date are left out, groups may be NULL, and days may lie before or between those already there. A
    delivery repeated with other rows is recomputed for the days of the new rows only: withdraw days by delivering them
    under the same name.
    """
    spark, root, keys = records.sparkSession, folder.rstrip("/"), list(keys)
    new = settle(day_parts(records, keys, means, impacts, date), "parts")
    months = touched_months(new)
    if not months:
        return
    named = new.withColumns({MONTH: month_of(), "delivery": F.lit(delivery)})
    named.repartition(MONTH).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH, "delivery").parquet(f"{root}/parts")
    days = new.select(*keys, "date")
    held = read_months(spark, f"{root}/parts", new.schema, months)
    touched = held.alias("h").join(days.alias("d"), _same([*keys, "date"], "h", "d"), "left_semi")
    fresh = settle(finish_parts(touched, keys, means, impacts), "fresh")
    upsert(fresh, f"{root}/daily", [*keys, "date"])
    _refill(fresh, root, keys)


def _refill(fresh: DataFrame, root: str, keys: list[str]) -> None:
    """Bring the calendar up to date after the days of ``fresh`` have changed."""
    spark = fresh.sparkSession
    values = [c for c in fresh.columns if c not in (*keys, "date", COUNT)]
    first = fresh.groupBy(*keys).agg(F.min("date").alias("_from"))
    since = month_of(F.lit(fresh.agg(F.min("date")).first()[0]))
    series = spark.read.parquet(f"{root}/daily").where(F.col(MONTH) >= since).select(*fresh.columns)
    later = series.alias("s").join(first.alias("f"), _same(keys, "s", "f") & (F.col("s.date") >= F.col("f._from"))).select("s.*")
    mark = fresh.select(*keys, "date", F.lit(True).alias("_new"))
    marked = later.alias("s").join(mark.alias("m"), _same([*keys, "date"], "s", "m"), "left").select("s.*", F.coalesce("_new", F.lit(False)).alias("_new"))
    full = F.lit(True)
    for name in values:
        full = full & F.col(name).isNotNull()
    ahead = Window.partitionBy(*keys).orderBy("date").rowsBetween(1, Window.unboundedFollowing)
    until = F.coalesce(F.min(F.when(full, F.col("date"))).over(ahead), F.lit("9999-12-31").cast("date"))
    # the day before a touched one may have been its group's last: what lies between them is new
    before_new = F.coalesce(F.lead("_new").over(Window.partitionBy(*keys).orderBy("date")), F.lit(False))
    marked = marked.withColumn("_valid_to", F.when(F.col("_new") | before_new, until)).withColumn("_reach", F.max("_valid_to").over(Window.partitionBy(*keys)))
    own = marked.where(F.col("date") <= F.col("_reach")).select(*fresh.columns, "_valid_to")
    if exists(spark, f"{root}/index"):
        # a group's latest day before its first touched one holds all that is carried on from it
        places = spark.read.parquet(f"{root}/index").where(F.col(MONTH) <= F.lit(touched_months(first.select(F.col("_from").alias("date")))[-1])).select(*keys, "date")
        eves = places.alias("s").join(first.alias("f"), _same(keys, "s", "f") & (F.col("s.date") < F.col("f._from"))).groupBy(*[F.col(f"f.{k}").alias(k) for k in keys], "_from").agg(F.max("date").alias("_eve"))
        eves = settle(eves, "eves")
        index = read_months(spark, f"{root}/index", fresh.schema, touched_months(eves.select(F.col("_eve").alias("date"))))
        gap = F.when(F.col("_eve") < F.date_sub("_from", 1), F.col("_from")).alias("_valid_to")
        eve = index.alias("s").join(eves.alias("f"), _same(keys, "s", "f") & (F.col("s.date") == F.col("f._eve"))).select("s.*", gap)
        own = own.unionByName(eve)
    filled = fill_calendar(own, keys).where(F.col("date") < F.col("_valid_to")).drop("_valid_to")
    upsert(settle(filled, "refilled"), f"{root}/index", [*keys, "date"])
