"""Queries of this subpackage: name -> (DataFrame query, SQL twin or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    from sparkcols.llm import plans

    return dict(plans.QUERIES)


def oracle_sql() -> dict[str, str]:
    from sparkcols.llm import plans

    return dict(plans.SQL)
