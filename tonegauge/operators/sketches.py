"""Mergeable sketches as an opt-in: kept per day in a table, merged over any range of days without the rows.

Distinct counts by HyperLogLog (relative error about 1.04 / sqrt(2 ** precision) of one standard deviation), quantiles by
KLL (the rank of the answer is off by at most about 2.296 / k ** 0.9723 of all rows, 99 times in 100). The exact operators
(``distinct_dates``, ``exact_quantiles``) stay the default.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRECISION, KLL_SIZE = 12, 400


def distinct_error(precision: int = PRECISION) -> float:
    """One standard deviation of the relative error of a distinct count."""
    return 1.04 / 2 ** (precision / 2)


def rank_error(size: int = KLL_SIZE) -> float:
    """Share of all rows by which the rank of a quantile is off at most, 99 times in 100."""
    return 2.296 / size**0.9723


def daily_sketches(rows: DataFrame, keys: Sequence[str], distinct: Sequence[str], values: Sequence[str], date: str = "date", precision: int = PRECISION, size: int = KLL_SIZE) -> DataFrame:
    """One row per group and day: number of rows, a sketch ``{column}_hll`` or ``{column}_kll`` for each column.

    Rows without a date are left out; NULLs count in no sketch, and a sketch of NULLs only is empty.
    """
    return rows.where(F.col(date).isNotNull()).groupBy(*keys, F.col(date).cast("date").alias("date")).agg(
        F.count("*").alias("rows"), *[F.hll_sketch_agg(c, precision).alias(f"{c}_hll") for c in distinct],
        *[F.kll_sketch_agg_double(F.col(c).cast("double"), size).alias(f"{c}_kll") for c in values],
    )


def merged_sketches(daily: DataFrame, by: Sequence[Column | str]) -> DataFrame:
    """The sketches of all days of each group of ``by``: states only, whatever the number of rows behind them."""
    kinds = [c for c in daily.columns if c.endswith(("_hll", "_kll"))]
    return daily.groupBy(*by).agg(
        F.sum("rows").alias("rows"), *[(F.hll_union_agg(c) if c.endswith("_hll") else F.kll_merge_agg_double(c)).alias(c) for c in kinds],
    )


def estimates(merged: DataFrame, keep: Sequence[str], probabilities: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """``{column}_distinct`` and ``{column}_q{i}`` of merged sketches; quantiles of no value are NULL."""
    found = []
    for c in merged.columns:
        if c.endswith("_hll"):
            found.append(F.hll_sketch_estimate(c).alias(f"{c[:-4]}_distinct"))
        elif c.endswith("_kll"):
            some = F.kll_sketch_get_n_double(c) > 0
            found += [F.when(some, F.kll_sketch_get_quantile_double(F.when(some, F.col(c)), F.lit(float(p)))).alias(f"{c[:-4]}_q{i}") for i, p in enumerate(probabilities)]
    return merged.select(*keep, "rows", *found)
