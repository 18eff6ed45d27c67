"""Sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, format: str = "csv", mode: str = "overwrite") -> None:
    """Parquet or header CSV; any other format is refused."""
    if format == "parquet":
        df.write.mode(mode).parquet(path)
    elif format == "csv":
        options = {"header": True, "quote": '"', "escape": '"'}
        df.write.mode(mode).options(**options, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    else:
        raise ValueError(f"Unsupported format: {format}")


def chunk_file_name(chunk_id: Column) -> Column:
    """``chunk01_input`` and so on; numbers above 99 keep all their digits."""
    digits = chunk_id.cast("string")
    return F.concat(F.lit("chunk"), F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits), F.lit("_input"))


def write_chunks(df: DataFrame, path: str, line: str = "request", chunk_id: str = "chunk_id", order: Sequence[str] = ("row_index",), split: bool = False) -> None:
    """JSON Lines, one folder ``chunk_file=chunkNN_input`` per chunk, lines in request order.

    A chunk that is bounded by its token budget is one file, written by one task. ``split`` is for chunks without such a
    bound: rows are range-partitioned on chunk and order, so a large chunk becomes several files, in order by name.
    """
    named = df.withColumn("chunk_file", chunk_file_name(F.col(chunk_id)))
    dealt = named.repartitionByRange("chunk_file", *order) if split else named.repartition("chunk_file")
    (
        dealt.sortWithinPartitions("chunk_file", *order)
        .select(F.col(line).alias("value"), "chunk_file")
        .write.mode("overwrite").partitionBy("chunk_file").text(path)
    )


def write_chunk_table(df: DataFrame, path: str, line: str = "request", chunk_id: str = "chunk_id", order: Sequence[str] = ("row_index",)) -> None:
    """All chunks in one Parquet table, many to a file: chunk_id, its name, and the lines in request order.

    Rows are range-partitioned on chunk and order, so neither the number of chunks nor the size of one decides how
    many files or tasks there are; ``write_chunks`` is for readers that want a folder for each chunk.
    """
    named = df.select(F.col(chunk_id).alias("chunk_id"), chunk_file_name(F.col(chunk_id)).alias("chunk_file"), F.col(line).alias("line"), *order)
    named.repartitionByRange("chunk_id", *order).sortWithinPartitions("chunk_id", *order).drop(*order).write.mode("overwrite").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """Nested statistics as JSON documents, one for each row, that keep NULL fields."""
    report.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
