"""Dense row positions in a total order, without sending the table through one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonegauge.session import settle

SLICE, OFFSET = "_slice", "_offset"


def default_slices(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ordered_slices(df: DataFrame, order_by: Sequence[str], slices: int | None = None) -> DataFrame:
    """Range-partitioned, sorted rows with their slice number and offset inside the slice.

    The range bounds come from a sample, so the result has to be kept (``settle``, ``cut_lineage``)
    before two readers may rely on the same slices.
    """
    slice_id = F.spark_partition_id()
    offset = F.monotonically_increasing_id() - F.shiftleft(slice_id.cast("bigint"), 33)
    ranged = df.repartitionByRange(slices or default_slices(df), *order_by).sortWithinPartitions(*order_by)
    return ranged.withColumns({SLICE: slice_id, OFFSET: offset})


def slice_starts(sliced: DataFrame) -> DataFrame:
    """Rows before each slice: one row per slice, so the running sum is as small as the slice count."""
    counts = sliced.groupBy(SLICE).agg((F.max(OFFSET) + 1).alias("_rows"))
    before = Window.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(SLICE, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))


def add_positions(
    df: DataFrame, order_by: Sequence[str], key: Sequence[str] | None = None,
    name: str = "row_index", slices: int | None = None,
) -> DataFrame:
    """Add the 0-based position of each row in the total order ``order_by``.

    With a unique ``key`` only the key and the order columns are range-partitioned and kept, and
    the positions are joined back; wide text is then shuffled at most once.
    """
    narrow = df.select(*dict.fromkeys([*(key or []), *order_by])) if key else df
    sliced = settle(ordered_slices(narrow, order_by, slices), "slices")
    # one row per slice: small enough to broadcast whatever the size of the table
    starts = F.broadcast(slice_starts(sliced))
    placed = sliced.join(starts, SLICE).withColumn(name, F.col(OFFSET) + F.col("_start")).drop(SLICE, OFFSET, "_start")
    return df.join(placed.select(*key, name), list(key)) if key else placed


def sequential_ids(
    df: DataFrame, order_by: Sequence[str], key: Sequence[str] | None = None,
    prefix: str = "speech_", name: str = "speech_id", slices: int | None = None,
) -> DataFrame:
    """``speech_0``, ``speech_1`` and so on along a total order."""
    placed = add_positions(df, order_by, key, "_position", slices)
    return placed.withColumn(name, F.concat(F.lit(prefix), F.col("_position").cast("string"))).drop("_position")
