"""Typed ingest."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sparkcols import schemas

TABLES = {
    "lineitem": schemas.LINEITEM,
    "orders": schemas.ORDERS,
    "events": schemas.EVENTS,
    "part": schemas.PART,
}


def load_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table under a declared schema, so no file is opened to infer one."""
    return spark.read.schema(schema).parquet(path)


def named_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return load_table(spark, f"{sf_dir}/{name}.parquet", TABLES[name])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` in its order and types; a missing column is an error."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def from_arrow(spark: SparkSession, table: pa.Table, schema: T.StructType) -> DataFrame:
    """A table from in-memory columns of driver size, typed by ``schema``."""
    return conform(spark.createDataFrame(table), schema)
