"""All registered queries."""

from tonegauge.catalog import profiles, responses, rows, series, sources, texts  # noqa: F401
from tonegauge.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
