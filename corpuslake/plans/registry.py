"""Collects the named queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import corpus_queries, oracle, store_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name -> (spark, sf_dir) -> DataFrame."""
    return corpus_queries.QUERIES | store_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    """Name -> DuckDB SQL."""
    return oracle.all_sql()
