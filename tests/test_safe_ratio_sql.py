"""safe_ratio against its SQL on rows that the test tables lack."""

import duckdb
from pyspark.sql import types as T

import __spark_entry__ as entry
from sparkcols import schemas


def test_safe_ratio_equals_sql_without_users_and_values(spark, tmp_path):
    rows = [(1, 1.5, None), (2, None, None), (3, None, 3), (4, 1.5, 0), (5, 1.5, -3), (6, None, 0), (7, 2.5, 2**53 + 1)]
    given = T.StructType([schemas.EVENTS[c] for c in ("event_id", "value", "user_id")])
    spark.createDataFrame(rows, given).write.parquet(str(tmp_path / "events.parquet"))
    got = {r.event_id: r.ratio for r in entry.queries()["safe_ratio"](spark, str(tmp_path)).collect()}
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == dict(duck.execute(entry.oracle_sql()["safe_ratio"]).fetchall())
