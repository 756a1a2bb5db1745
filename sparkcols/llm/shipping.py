"""What every task with Python code needs: the package on the worker's path, and bounded Arrow batches."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: bytes of an Arrow batch: a task holds one in its writer and one in its worker, out of the heap
BATCH = 8 << 20
SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Let Python workers find this package even when it isn't installed on them."""
    known = spark.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        known["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """``df.mapInArrow`` with the package shipped and batches of ``BATCH`` bytes and a row at most; a session's own
    lower bound stays."""
    ship(df.sparkSession)
    if df.sparkSession._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH:
        df.sparkSession.conf.set(SETTING, str(BATCH))
    return df.mapInArrow(function, schema)
