"""Column contracts, resolution and defaults: decided on the schema, without running a job."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, required: Sequence[str], name: str = "DataFrame") -> bool:
    missing = sorted(missing_columns(df, required))
    if missing:
        raise ValueError(f"{name}: no columns {missing} among {df.columns}")
    return True


def missing_columns(df: DataFrame, required: Sequence[str]) -> set[str]:
    return set(required) - set(df.columns)


def resolve_column(df: DataFrame, candidates: Sequence[str] = (), containing: str | None = None) -> str | None:
    """First candidate that exists; else the first column whose lower-cased name holds ``containing``."""
    exact = next((name for name in candidates if name in df.columns), None)
    if exact or containing is None:
        return exact
    return next((name for name in df.columns if containing in name.lower()), None)


def fill_defaults(df: DataFrame, columns: Sequence[str], default: str = "Unknown") -> DataFrame:
    """Absent columns become the default; NULLs in present string columns do as well."""
    filled = {
        name: F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)
        for name in columns
    }
    return df.withColumns(filled)


def fill_missing_columns(df: DataFrame, columns: Sequence[str], default: str = "Unknown") -> DataFrame:
    return df.withColumns({name: F.lit(default) for name in columns if name not in df.columns})


def nan_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Spark keeps NaN apart from NULL; statistics here treat both as missing."""
    floats = [n for n, t in df.dtypes if t in ("double", "float") and (columns is None or n in columns)]
    return df.withColumns({name: F.nullif(F.col(name), F.lit(float("nan"))) for name in floats})


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))
