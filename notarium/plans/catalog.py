"""All core queries by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from notarium.plans import links, records, retrieval, store, streams

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = [retrieval, links, store, records, streams]


def queries() -> dict[str, Query]:
    """Name to query, over every module of queries."""
    return {name: run for module in _MODULES for name, run in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Name to the SQL that gives the same rows."""
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Hybrid retrieval for all logged searches."""
    return retrieval.hybrid_rrf(spark, folder)
