"""All registered queries: name -> (DataFrame query, SQL twin or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a function under ``name``, by default its own, together with its SQL twin."""

    def add(function: Query) -> Query:
        key = name or function.__name__
        if key in _QUERIES:
            raise ValueError(f"query {key} is registered twice")
        _QUERIES[key] = function
        if sql is not None:
            _SQL[key] = " ".join(sql.split())
        return function

    return add


def _load() -> None:
    from sparkcols.plans import (  # noqa: F401
        column_queries,
        id_queries,
        measurement_queries,
        string_queries,
        table_queries,
    )


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
