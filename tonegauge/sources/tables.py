"""Parquet tables that are kept up to date in place: rows replaced by key, only the touched months rewritten."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonegauge.session import settle

MONTH = "month"


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.schema("x int").parquet(path).schema
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def month_of(date: str = "date"):
    return F.date_format(date, "yyyy-MM")


def read_months(spark: SparkSession, path: str, schema, months: Sequence[str] | None = None) -> DataFrame:
    """The table's rows without the month; only the folders of ``months`` if given. No table: no row."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    held = spark.read.schema(T.StructType([*schema.fields, T.StructField(MONTH, T.StringType())])).parquet(path)
    wanted = held if months is None else held.where(F.col(MONTH).isin(*months))  # prunes folders
    return wanted.drop(MONTH)


def replace_months(rows: DataFrame, path: str, date: str = "date") -> None:
    """Write rows into their months; a month that gets any row is replaced, the others keep their files."""
    named = rows.withColumn(MONTH, month_of(date))
    named.repartition(MONTH).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path)


def touched_months(rows: DataFrame, date: str = "date") -> list[str]:
    """Months of some rows: as few as the calendar has."""
    return sorted(r[0] for r in rows.select(month_of(date)).distinct().collect())


def upsert(rows: DataFrame, path: str, keys: Sequence[str], date: str = "date") -> None:
    """Replace the rows of the same key (which holds ``date``), keep the others; months without a new row are not read.

    Keys may be NULL. Repeating the call with the same rows changes nothing.
    """
    months = touched_months(rows, date)
    if not months:
        return
    spark = rows.sparkSession
    held = read_months(spark, path, rows.schema, months).alias("held")
    same = F.lit(True)
    for key in keys:
        same = same & F.col(f"held.{key}").eqNullSafe(F.col(f"new.{key}"))
    others = held.join(rows.select(*keys).alias("new"), same, "left_anti")
    # the folders read are the folders replaced: what stays is kept apart first
    replace_months(settle(others.unionByName(rows), "upsert"), path, date)
