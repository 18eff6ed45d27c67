"""Exact interpolated quantiles, one way for every size.

Equal values fold to one row with a count. The folded rows are range-partitioned on group and value, so a group of any
size is spread over many slices; running counts inside the slices and the few totals of (slice, group) pieces give every
row its rank, and the rows that cover the wanted ranks are picked where they lie.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonegauge.operators.positions import SLICE, ordered_slices
from tonegauge.session import settle


def _same(keys: Sequence[str], left: str, right: str) -> Column:
    on = F.lit(True)
    for key in keys:
        on = on & F.col(f"{left}.{key}").eqNullSafe(F.col(f"{right}.{key}"))
    return on


def exact_quantiles(values: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float], count: str | None = None) -> DataFrame:
    """One row per group with columns ``q_0``, ``q_1`` ... (linear interpolation between neighbours).

    ``values`` is a long frame of group keys and one number, with ``count`` equal rows each if that is given; NULL and
    NaN values are left out. A rank that no row covers is an error.
    """
    keys = list(keys)
    clean = values.select(*keys, F.col(value).cast("double").alias("_v"), (F.col(count) if count else F.lit(1)).cast("bigint").alias("_c"))
    clean = clean.where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    folded = clean.groupBy(*keys, "_v").agg(F.sum("_c").alias("_c"))
    # the range bounds are sampled, so the slices are kept before several readers rely on them
    sliced = settle(ordered_slices(folded, [*keys, "_v"]).select(*keys, "_v", "_c", SLICE), "folded")
    inside = Window.partitionBy(SLICE).orderBy(*keys, "_v").rowsBetween(Window.unboundedPreceding, 0)
    running = sliced.withColumn("_upto", F.sum("_c").over(inside))
    # a piece is what one slice has of one group: as few as slices and groups together
    pieces = running.groupBy(SLICE, *keys).agg(F.sum("_c").alias("_n"), F.max("_upto").alias("_end"))
    before = Window.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    totals = sliced.groupBy(SLICE).agg(F.sum("_c").alias("_rows")).select(SLICE, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    begun = pieces.join(F.broadcast(totals), SLICE)  # one row per slice
    groups = begun.groupBy(*keys).agg(F.min(F.col("_start") + F.col("_end") - F.col("_n")).alias("_first"), F.sum("_n").alias("_size"))
    placed = begun.alias("b").join(groups.alias("g"), _same(keys, "b", "g")).select(f"b.{SLICE}", *[f"b.{k}" for k in keys], "_start", "_first", "_size")
    rows = running.alias("r").join(placed.alias("p"), (F.col(f"r.{SLICE}") == F.col(f"p.{SLICE}")) & _same(keys, "r", "p")).select(
        *[f"r.{k}" for k in keys], "_v", "_c", (F.col("_start") + F.col("_upto") - F.col("_first")).alias("_upto"), "_size"
    )

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_upto") > rank) & (F.col("_upto") - F.col("_c") <= rank), F.col("_v")))

    ranks = [F.lit(float(p)) * (F.col("_size") - 1) for p in probabilities]
    ends = [at(edge).alias(f"_{name}{i}") for i, rank in enumerate(ranks) for name, edge in (("lo", F.floor(rank)), ("hi", F.ceil(rank)))]
    found = rows.groupBy(*keys).agg(F.max("_size").alias("_size"), *ends)

    def between(i: int, rank: Column) -> Column:
        low, high = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        missing = F.raise_error(F.lit("no row covers the rank of a quantile")).cast("double")
        # equal neighbours are returned as they are: infinite values have no difference
        return F.when(low.isNull() | high.isNull(), missing).when(low == high, low).otherwise(low + (high - low) * (rank - F.floor(rank)))

    return found.select(*keys, *[between(i, rank).alias(f"q_{i}") for i, rank in enumerate(ranks)])
