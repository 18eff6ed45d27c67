"""Columns that later filters cannot copy."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_columns_once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Like ``withColumns``, but through a one-row generator.

    A filter on an ordinary computed column is pushed below it by copying its expression, so parsing
    a document would be paid twice; the output of a generator is filtered where it stands.
    """
    kept = [c for c in df.columns if c not in columns]
    row = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select(*kept, F.inline(F.array(row)))
