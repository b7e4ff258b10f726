"""Registered queries of the library and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import files, filters, images, learning, more, numbers, oracles, shapes  # noqa: F401  they register their queries
from .base import QUERIES, SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Those with SQL first."""
    return {k: QUERIES[k] for k in sorted(QUERIES, key=lambda k: k not in SQL)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
