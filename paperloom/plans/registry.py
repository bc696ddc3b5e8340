"""All queries of the core, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperloom.plans import catalogue_queries, content_queries, glyph_queries, nested_queries, page_queries, pdf_queries, scalar_queries

FLAGSHIP = "page_run"
_MODULES = [nested_queries, glyph_queries, page_queries, scalar_queries, pdf_queries, catalogue_queries, content_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}
