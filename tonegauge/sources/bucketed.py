"""Tables bucketed by their key, so that joins and reductions on it need no exchange (within a bucket Spark still sorts)."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def open_bucketed(spark: SparkSession, path: str, schema, key: str, buckets: int) -> DataFrame:
    """A bucketed table written before, under a name of this session."""
    name = f"bucketed_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> DataFrame:
    """Write ``df`` into ``buckets`` buckets by ``key``, one sorted file each, and open it.

    The rows are dealt by the same hash before they are written, which costs the one exchange that later joins and
    reductions on the key save. Choose the number so that a bucket fits a task; tables that are joined need the same.
    """
    name = f"bucketed_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def latest_of(table: DataFrame, key: str, order: str, columns: Sequence[str], count: str | None = None) -> DataFrame:
    """One row per key of a bucketed table, the greatest by the column ``order`` (ties: by ``columns``): the row's columns.

    One reduction over rows that already lie together.
    """
    kept = [c for c in columns if c not in (key, order)]
    rows = [F.count("*").alias(count)] if count else []
    found = table.groupBy(key).agg(F.max(F.struct(order, *kept)).alias("_row"), *rows)
    return found.select(key, *[F.col(f"_row.{c}").alias(c) for c in columns if c != key], *([count] if count else []))
