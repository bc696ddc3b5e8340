"""All queries of the subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import character_queries, language_queries, leakage_queries, scan_queries, stats_queries, token_queries, truncation_queries

_MODULES = [character_queries, stats_queries, scan_queries, language_queries, token_queries, leakage_queries, truncation_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}
