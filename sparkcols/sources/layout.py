"""Stored layouts that let later queries skip data, and column statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkcols.operators.ordering import by_range
from sparkcols.sources.sinks import drop_table


def sorted_layout(df: DataFrame, keys: list[str], path: str, files: int | None = None) -> DataFrame:
    """Range-partitioned files sorted by ``keys``, written and read back.

    Files then cover disjoint key ranges, so equality, ``IN`` and range
    predicates skip all but a few row groups by their minimum and maximum.
    Without ``files`` their number follows from the bytes of the files behind
    ``df``. The range key ends in a hash of the row's position, which is not
    written: a run of equal keys is split evenly over files. The range exchange
    evaluates ``df`` twice, first for a sample of the keys, so a costly ``df``
    is better staged before.
    """
    ends = F.xxhash64(F.monotonically_increasing_id())
    order = [*keys, ends]
    ranged = df.repartitionByRange(files, *order) if files else by_range(df, order)
    ranged.sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def covering_projection(df: DataFrame, keys: list[str], columns: list[str], path: str,
                        files: int | None = None) -> DataFrame:
    """A narrow copy with just the columns a family of group-bys reads, sorted by their keys.

    The other columns end the sort order, so equal neighbours compress to
    almost nothing.
    """
    narrow = df.select(*keys, *columns)
    return sorted_layout(narrow, [*keys, *columns], path, files)


def bucketed_projection(spark: SparkSession, df: DataFrame, keys: list[str], columns: list[str],
                        name: str, path: str, buckets: int) -> DataFrame:
    """A narrow copy bucketed on its keys: grouping on them needs no exchange.

    A bucket is read by one task, so this pays for many keys of similar size;
    for a table with a hot key choose ``covering_projection``.
    """
    narrow = df.select(*keys, *columns)
    drop_table(spark, name)
    # one task per bucket writes one file, instead of every task writing to every bucket
    (
        narrow.repartition(buckets, *keys).write.format("parquet").mode("overwrite")
        .bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    )
    return spark.table(name)


def column_stats(df: DataFrame, columns: list[str] | None = None, exact: bool = False) -> DataFrame:
    """Rows, NULLs, minimum, maximum and distinct values of each column, one row per column.

    The approximate form is one pass with one output row. The exact form counts
    the rows per value, one column at a time, each reading only its own column;
    a single pass would multiply every row by the number of columns before the
    shuffle.
    """
    columns = columns or df.columns
    if exact:
        parts = []
        for c in columns:
            value = F.col("value")
            counts = df.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n"))
            parts.append(counts.agg(
                F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
                F.coalesce(F.sum(F.when(value.isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
                F.min(value).cast("string").alias("minimum"),
                F.max(value).cast("string").alias("maximum"),
                F.count(value).alias("distinct_values"),
            ).select(F.lit(c).alias("column"), "*"))
        return reduce(DataFrame.unionByName, parts)
    packed = df.agg(*[
        F.struct(
            F.lit(c).alias("column"),
            F.count("*").alias("rows"),
            (F.count("*") - F.count(c)).alias("nulls"),
            F.min(c).cast("string").alias("minimum"),
            F.max(c).cast("string").alias("maximum"),
            F.approx_count_distinct(c).alias("distinct_values"),
        ).alias(f"_{i}")
        for i, c in enumerate(columns)
    ])
    return packed.select(F.inline(F.array(*packed.columns)))


def analyze(spark: SparkSession, name: str, columns: list[str]) -> None:
    """Collect table and column statistics for the optimizer."""
    listed = ", ".join(f"`{c.replace('`', '``')}`" for c in columns)
    spark.sql(
        f"ANALYZE TABLE IDENTIFIER(:name) COMPUTE STATISTICS FOR COLUMNS {listed}", args={"name": name}
    )
