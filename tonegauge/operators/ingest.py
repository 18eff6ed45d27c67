"""Row filters and derivations applied right after a scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonegauge.functions.scoring import number_in
from tonegauge.operators.contracts import resolve_column


def sample_years(
    df: DataFrame, start_year: int, end_year: int,
    institution: str | None = None, institution_column: str = "institution", skip_unknown: bool = False,
) -> DataFrame:
    """Rows of the years ``start_year`` to ``end_year``. An institution filter on a column that is absent is an error,
    unless ``skip_unknown`` asks to do without it.

    A table without a ``year`` column gets one; its bounds then compare the date itself, so they reach the scan.
    """
    if "year" in df.columns:
        kept = df.where(F.col("year").between(start_year, end_year))
    else:
        stamp, first = F.col("date"), lambda year: F.lit(f"{year:04d}-01-01").cast("date")
        kept = df.where((stamp >= first(start_year)) & (stamp < first(end_year + 1))).withColumn("year", F.year("date"))
    if institution and institution_column not in df.columns:
        if not skip_unknown:
            raise ValueError(f"no column {institution_column} to find {institution} in")
    elif institution:
        kept = kept.where(F.col(institution_column) == institution)
    return kept


def between_dates(df: DataFrame, start: str, end: str, midnight_end: bool = False) -> DataFrame:
    """Inclusive date range on ``date`` (or ``Date``).

    The bounds compare against the unchanged column, so they reach the scan. ``midnight_end`` ends
    the range at 00:00 of the last day, as a comparison of raw timestamps does.
    """
    name = resolve_column(df, ("date", "Date"))
    if name is None:
        raise ValueError("No date column found in dataset")
    stamp = F.col(name)
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    is_date = dict(df.dtypes)[name] == "date"
    upper = stamp <= last if is_date or midnight_end else stamp < F.date_add(last, 1)
    kept = df.where((stamp >= first) & upper)
    return kept if name == "date" else kept.withColumnRenamed(name, "date")


def only_institution(df: DataFrame, institution: str, column: str = "country") -> DataFrame:
    return df.where(F.col(column) == institution)


def coerce_dates(df: DataFrame, column: str = "date") -> DataFrame:
    """Unreadable dates become NULL; the original stays in ``<column>_raw``."""
    return df.withColumns({f"{column}_raw": F.col(column), column: F.col(column).try_cast("date")})


def split_by_date(df: DataFrame, column: str = "date") -> tuple[DataFrame, DataFrame]:
    """(rows with a valid date, rows set aside)"""
    coerced = coerce_dates(df, column)
    return (
        coerced.where(F.col(column).isNotNull()).drop(f"{column}_raw"),
        coerced.where(F.col(column).isNull()),
    )


def with_row_index(df: DataFrame, id_column: str = "speech_id", prefix: str = "speech_", strict: bool = False) -> DataFrame:
    return df.withColumn("row_index", number_in(F.col(id_column), prefix, strict=strict))


def speech_id(number: Column, prefix: str = "speech_") -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def by_time(df: DataFrame, columns: Sequence[str] = ("date", "speech_id")) -> DataFrame:
    return df.orderBy(*columns)


def by_id(df: DataFrame, column: str = "speech_id") -> DataFrame:
    """String order: ``speech_10`` comes before ``speech_2``."""
    return df.orderBy(column)


def head(df: DataFrame, order_by: Sequence[str], columns: Sequence[str], n: int = 5) -> DataFrame:
    return df.orderBy(*order_by).select(*columns).limit(n)


def union_chunks(parts: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL by column name; duplicates stay."""
    first, *others = parts
    for part in others:
        first = first.unionByName(part)
    return first


def latest_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], columns: Sequence[str] | None = None, count: str | None = None) -> DataFrame:
    """One row per key, the greatest by ``order_by``, with ``columns`` (all by default) and the number of rows as ``count``.

    A map-side combined aggregate over structs, which Spark sorts by key: name the columns that are needed. Where these
    are the keys and a single order column, it is a hash aggregate.
    """
    wanted = list(df.columns if columns is None else columns)
    others = [c for c in wanted if c not in keys]
    rows = F.count("*").alias("_count")
    if others == list(order_by) and len(others) == 1:
        return df.groupBy(*keys).agg(F.max(others[0]).alias(others[0]), *([F.count("*").alias(count)] if count else [])).select(*wanted, *([count] if count else []))
    latest = df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order_by)).alias("_row"), *([rows] if count else []))
    found = latest.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others], *([F.col("_count").alias(count)] if count else []))
    return found.select(*wanted, *([count] if count else []))
