"""Column arithmetic, filters and predicate counts.

Predicates are plain column comparisons with literals, so Catalyst pushes them
to the Parquet scan and prunes row groups by their statistics.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F


def col_multiply(df: DataFrame, a: str, b: str, alias: str = "product") -> DataFrame:
    """The product of two columns as a single column."""
    return df.select((F.col(a) * F.col(b)).alias(alias))


def col_multiply_replace(df: DataFrame, a: str, b: str) -> DataFrame:
    """The whole row with column ``a`` replaced by the product."""
    return df.withColumn(a, F.col(a) * F.col(b))


def filter_gt(df: DataFrame, column: str, threshold: float) -> DataFrame:
    return df.where(F.col(column) > F.lit(threshold))


def filter_text(df: DataFrame, predicate: str) -> DataFrame:
    """Rows that meet a predicate written as SQL text."""
    return df.where(predicate)


def _count(df: DataFrame, predicate: Column) -> DataFrame:
    return df.where(predicate).agg(F.count("*").alias("n"))


def count_eq(df: DataFrame, column: str, value: Any) -> DataFrame:
    return _count(df, F.col(column) == F.lit(value))


def count_in(df: DataFrame, column: str, values: Sequence[Any]) -> DataFrame:
    return _count(df, F.col(column).isin(list(values)))


def count_like(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Count by SQL pattern, where ``_`` stands for any one character."""
    return _count(df, F.col(column).like(pattern))


def point_lookup(df: DataFrame, key: str, value: Any) -> DataFrame:
    return df.where(F.col(key) == F.lit(value))


def multi_lookup(df: DataFrame, key: str, values: Sequence[Any]) -> DataFrame:
    return df.where(F.col(key).isin(list(values)))


def between_open(key: str, low: Any, high: Any) -> Column:
    """Both ends excluded, unlike SQL's BETWEEN."""
    return (F.col(key) > F.lit(low)) & (F.col(key) < F.lit(high))


def range_count(df: DataFrame, key: str, low: Any, high: Any) -> DataFrame:
    return _count(df, between_open(key, low, high))
