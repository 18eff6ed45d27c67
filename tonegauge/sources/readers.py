"""Scans. Every scan takes its schema; missing paths are found at analysis time on any file system."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonegauge import schemas


def _first_existing(attempts: Iterable[tuple[str, Callable[[], DataFrame]]]) -> DataFrame:
    tried = []
    for path, load in attempts:
        try:
            return load()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            tried.append(path)
    raise FileNotFoundError(f"none of these paths exists: {tried}")


def read_parquet(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_csv(
    spark: SparkSession, path: str, schema: str | T.StructType,
    multiline: bool = True, date_format: str = "yyyy-MM-dd",
) -> DataFrame:
    """Header CSV with quoted, doubled-quote and multi-line fields.

    ``multiline=False`` keeps files splittable; use it for tables whose text holds no line breaks.
    """
    return (
        spark.read.schema(schema)
        .options(header=True, multiLine=multiline, quote='"', escape='"', dateFormat=date_format)
        .csv(path)
    )


def read_preferred(spark: SparkSession, parquet_path: str, csv_path: str, schema: str | T.StructType) -> DataFrame:
    """Parquet where it exists, else CSV, else FileNotFoundError."""
    return _first_existing([
        (parquet_path, lambda: read_parquet(spark, parquet_path, schema)),
        (csv_path, lambda: read_csv(spark, csv_path, schema)),
    ])


def read_cached(spark: SparkSession, cache_path: str, source_path: str, schema: str | T.StructType | None = None, refresh: bool = False) -> DataFrame:
    """Parquet cache if present; otherwise (or on ``refresh``) fill it from the source first.

    With ``schema`` no footer is read for it. A folder whose write did not end (no ``_SUCCESS``) counts as absent.
    """
    if not refresh:
        try:
            spark.read.format("binaryFile").load(f"{cache_path.rstrip('/')}/_SUCCESS")
            return read_parquet(spark, cache_path, schema)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    source = read_parquet(spark, source_path, schema)
    source.write.mode("overwrite").parquet(cache_path)
    return read_parquet(spark, cache_path, source.schema)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.REQUEST).json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line, kept raw so that malformed lines are set aside rather than lost."""
    return spark.read.text(path).select(F.col("value").alias("raw"), F.col("_metadata.file_name").alias("file_name"))


def read_chunk_results(spark: SparkSession, folder: str, pattern: str = "chunk*_results*") -> DataFrame:
    """All result files of a folder in one scan, with the chunk each line came from."""
    path = f"{folder.rstrip('/')}/{pattern}"
    try:
        lines = spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"no chunk results match {path}") from error
    chunk = F.regexp_extract(F.col("_metadata.file_path"), r"chunk(\d+)_results", 1).try_cast("bigint")
    return lines.select(F.col("value").alias("raw"), chunk.alias("chunk_number"))
