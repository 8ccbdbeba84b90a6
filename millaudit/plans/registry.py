"""Registry of queries: name -> (Spark query, checking SQL or none)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millaudit.plans.derived import check_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    """Register a query with the SQL that gives the same rows, if SQL can."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = fn
        if check:
            CHECKS[name] = check_sql(check)
        return fn

    return add


def load_all() -> None:
    """Import every query module."""
    from millaudit.plans import (  # noqa: F401
        queries_items, queries_limits, queries_lines, queries_pages, queries_reports, queries_retrieval, queries_rules,
        queries_standards, queries_streams, queries_sources,
    )
