"""Aggregations.

All of them are map-side partial aggregates followed by one exchange on the
group key, so a key that holds a third of the rows costs each task one partial
row and the final task as many rows as there are tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_LOW_BITS = 20


def exact_sum(column: str, scale: int) -> Column:
    """Sum of a double column whose values have at most ``scale`` decimals.

    A plain double sum depends on the order in which partitions arrive. Here
    the values are added as whole units, split into high and low bits so that
    neither running total can leave the long range, and the result is the same
    for every partitioning and after any task retry. A value with more decimals
    (or of 2^53 units and more) stops the job; NaN and infinite values make the
    sum what a plain one would be.
    """
    name, factor = column.replace("`", "``"), f"{10**scale}D"
    finite = f"abs(`{name}`) < double('infinity')"
    whole = f"rint(`{name}` * {factor})"
    beyond = f"raise_error(concat('more than {scale} decimals: ', string(`{name}`)))"
    units = f"CASE WHEN {finite} THEN CASE WHEN {whole} / {factor} = `{name}` THEN CAST({whole} AS BIGINT) ELSE CAST({beyond} AS BIGINT) END END"
    high = f"CAST(sum(shiftright({units}, {_LOW_BITS})) AS DECIMAL(20,0))"
    low = f"sum({units} & {2**_LOW_BITS - 1})"
    odd = f"sum(CASE WHEN {finite} THEN NULL ELSE `{name}` END)"
    return F.expr(f"coalesce({odd}, CAST({high} * {2**_LOW_BITS} + {low} AS DOUBLE) / {factor})")


def total_of(column: str, scale: int | None = None) -> Column:
    return F.sum(column) if scale is None else exact_sum(column, scale)


def mean_of(column: str, scale: int | None = None) -> Column:
    return F.avg(column) if scale is None else exact_sum(column, scale) / F.count(column)


def col_sum(df: DataFrame, column: str, scale: int | None = None) -> DataFrame:
    return df.agg(total_of(column, scale).alias("total"))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def count_distinct(df: DataFrame, column: str) -> DataFrame:
    """Exact number of distinct values; NULL is not a value."""
    return df.agg(F.count_distinct(column).alias("n"))


def count_groups(df: DataFrame, column: str) -> DataFrame:
    """Number of groups, where NULL forms a group of its own."""
    return distinct_values(df, column).agg(F.count("*").alias("n"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def group_sum(df: DataFrame, keys: str | list[str], column: str, scale: int | None = None) -> DataFrame:
    """Sum per key; serves few groups, many groups and several key columns alike."""
    keys = [keys] if isinstance(keys, str) else keys
    return df.groupBy(*keys).agg(total_of(column, scale).alias("total"))


def group_count(df: DataFrame, keys: str | list[str]) -> DataFrame:
    keys = [keys] if isinstance(keys, str) else keys
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def group_multi(df: DataFrame, keys: str | list[str], column: str, scale: int | None = None) -> DataFrame:
    """Sum, mean, minimum and maximum in one pass."""
    spec = [("sum", "total"), ("mean", "average"), ("min", "minimum"), ("max", "maximum")]
    return agg_spec(df, keys, {column: spec}, scale)


_FUNCTIONS = {
    "sum": total_of,
    "mean": mean_of,
    "min": lambda column, scale: F.min(column),
    "max": lambda column, scale: F.max(column),
}


def agg_spec(
    df: DataFrame,
    keys: str | list[str],
    spec: dict[str, list[tuple[str, str]]],
    scale: int | None = None,
) -> DataFrame:
    """Aggregates named by ``{column: [(function, alias), ...]}`` in one pass."""
    keys = [keys] if isinstance(keys, str) else keys
    outputs = [
        _FUNCTIONS[function](column, scale).alias(alias)
        for column, parts in spec.items()
        for function, alias in parts
    ]
    return df.groupBy(*keys).agg(*outputs)
