"""How queries and their SQL are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandloom.plans import views

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def register(f: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    _QUERIES[f.__name__] = f
    if sql:
        _SQL[f.__name__] = sql


def query(sql: str | None):
    """Registers a query with SQL that returns the same rows, or None where SQL has no form for it."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        register(f, sql and views.sql(sql))
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
