"""Creating, filling and dropping tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, types as T


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write a query's result as table ``name`` (replacing it) and return the table."""
    writer = df.write.format("parquet").mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def sink_noop(df: DataFrame) -> None:
    """Compute every row and column without storing or fetching them."""
    df.write.format("noop").mode("overwrite").save()


def create_table(spark: SparkSession, name: str, schema: T.StructType, path: str | None = None) -> DataFrame:
    """An empty Parquet table with declared columns; an existing one is replaced, and the folder ``path`` is emptied."""
    drop_table(spark, name)
    table = spark.catalog.createTable(name, source="parquet", schema=schema, path=path)
    if path:  # dropping a table leaves the files at a path of its own
        spark.createDataFrame([], schema).write.insertInto(name, overwrite=True)
    return table


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql("DROP TABLE IF EXISTS IDENTIFIER(:name)", args={"name": name})


def append(df: DataFrame, name: str) -> None:
    """Insert rows into an existing table, matching columns by name."""
    columns = df.sparkSession.table(name).columns
    df.select(*columns).write.insertInto(name)


def with_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Add the columns of ``defaults`` that the rows do not bring themselves."""
    return df.withColumns({c: value for c, value in defaults.items() if c not in df.columns})
