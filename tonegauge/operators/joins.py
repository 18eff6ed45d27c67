"""Joins of records, metadata and job state. Strategies are left to adaptive execution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonegauge.operators.contracts import require_columns
from tonegauge.operators.ingest import with_row_index
from tonegauge.operators.positions import add_positions


def join_by_position(
    metadata: DataFrame, scored: DataFrame, order_by: Sequence[str] | None = None,
    columns: Sequence[str] = ("date", "author", "country", "title"), strict: bool = False,
) -> DataFrame:
    """Inner join of the n-th metadata row with ``speech_n``.

    The metadata brings its own ``row_index`` or an ``order_by`` from which positions are made.
    """
    if "row_index" not in metadata.columns:
        if not order_by:
            raise ValueError("metadata without row_index needs order_by")
        narrow = metadata.select(*dict.fromkeys([*order_by, *columns]))
        metadata = add_positions(narrow, order_by)
    require_columns(metadata, ["row_index", *columns], "metadata")
    left = metadata.select("row_index", *columns)
    return left.join(with_row_index(scored, strict=strict), "row_index").drop("row_index")


def join_by_key(speeches: DataFrame, results: DataFrame, key: str = "speech_id") -> DataFrame:
    """Inner join on the key; duplicates multiply."""
    return speeches.join(results, key, "inner")


def lookup(sample: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join of a sample to its source; ``found`` tells a missing row from an empty one.

    The table is first reduced to the sample's keys, so a small sample can be sent to a large table, not the reverse.
    """
    table = table.join(sample.select(key).distinct(), key, "left_semi")
    return sample.join(table.withColumn("_hit", F.lit(True)), key, "left").withColumn(
        "found", F.coalesce("_hit", F.lit(False))
    ).drop("_hit")


def untracked_chunks(chunk_files: DataFrame, ledger: DataFrame, key: str = "chunk_name") -> DataFrame:
    """Chunk files the ledger does not know; ledger entries starting with ``_`` are metadata."""
    tracked = ledger.where(~F.col(key).startswith("_")).select(key).distinct()
    return chunk_files.join(tracked, key, "left_anti")


def chunks_to_submit(chunk_files: DataFrame, latest: DataFrame, settled: Sequence[str], key: str = "chunk_name") -> DataFrame:
    """Chunk files whose latest state is not one of ``settled``."""
    return chunk_files.join(latest.where(F.col("status").isin(*settled)).select(key), key, "left_anti")
