"""All registered queries and their DuckDB equivalents, gathered from the families of operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
FAMILIES: tuple[str, ...] = ("retrieval", "timeline", "knowledge", "extract", "graph", "skills", "streaming", "lifecycle", "assembly")


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under name, with the SQL that gives the same rows."""

    def register(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return register


def _load() -> None:
    import importlib

    for family in FAMILIES:
        importlib.import_module(f"loamspark.plans.{family}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
