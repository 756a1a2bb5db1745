"""Incremental insert: the same append and defaults, fed by files as they arrive.

The batch operators take streaming DataFrames unchanged; a grouped count or sum
keeps one state row per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, types as T
from pyspark.sql.streaming import StreamingQuery

from sparkcols.sources.sinks import with_defaults


def arriving_rows(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    """Rows of the Parquet files in a folder, including those added later."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def insert_arriving(rows: DataFrame, columns: list[str], defaults: dict[str, Column], path: str,
                    progress: str) -> StreamingQuery:
    """Append what has arrived since the last call, then stop.

    ``progress`` is the stream's checkpoint folder: each file is inserted
    exactly once, also when a run is lost half-way and started again.
    """
    return (
        with_defaults(rows, defaults).select(*columns)
        .writeStream.format("parquet").option("path", path).option("checkpointLocation", progress)
        .trigger(availableNow=True).start()
    )
