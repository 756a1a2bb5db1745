"""Ingest, table writes, layouts, statistics, footprint, reports and streams."""

import glob
import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F, types as T

from conftest import plan_of
from sparkcols import schemas, session
from sparkcols.functions import scalars
from sparkcols.operators import aggregates as agg, columns as cols, compare, storage
from sparkcols.sources import generators, layout, sinks
from sparkcols.sources.tables import conform, from_arrow, load_table, named_table
from sparkcols.streaming import incremental


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_arrow_columns_become_a_typed_table(spark):
    table = pa.table({"quantity": [1, 2], "id": [0, 1], "amount": [1, 2], "category": ["a", None], "subcategory": ["x", "y"]})
    df = from_arrow(spark, table, schemas.SALES)
    assert df.schema.simpleString() == schemas.SALES.simpleString()
    assert values(df) == [(0, "a", "x", 1.0, 1), (1, None, "y", 2.0, 2)]
    with pytest.raises(Exception):
        from_arrow(spark, table.drop_columns(["amount"]), schemas.SALES)


def test_declared_schema_is_used(spark, tmp_path):
    path = str(tmp_path / "t")
    generators.gen_uniform(spark, 100).write.parquet(path)
    df = load_table(spark, path, schemas.SALES)
    assert df.schema == schemas.SALES and df.count() == 100


def test_create_append_default_drop(spark):
    name, path = session.new_table(spark, "t")
    sinks.create_table(spark, name, schemas.KEYED_VALUES["uuid"], path)
    assert spark.table(name).count() == 0
    rows = spark.range(50).select(F.timestamp_millis(F.col("id") + 10**12).alias("ts"), "id").select(
        "ts", F.col("id").alias("n"), scalars.rand_u64("id").alias("value")
    )
    filled = sinks.with_defaults(rows, {"id": scalars.uuid_v7("ts", "n"), "value": F.lit(0)})
    sinks.append(filled, name)
    sinks.append(filled.select("value", F.upper("id").alias("id")), name)
    out = spark.table(name)
    assert out.count() == 100 and out.select("id").distinct().count() == 100
    assert out.where("value = 0").count() == 0
    assert [f.dataType for f in out.schema] == [f.dataType for f in schemas.KEYED_VALUES["uuid"]]
    sinks.drop_table(spark, name)
    assert not spark.catalog.tableExists(name)
    sinks.drop_table(spark, name)


def test_materialize_replaces(spark):
    name, path = session.new_table(spark, "m")
    assert sinks.materialize(spark.range(5), name, path).count() == 5
    assert sinks.materialize(spark.range(3), name, path).count() == 3
    sinks.sink_noop(spark.table(name))
    sinks.drop_table(spark, name)


def test_shared_dir_is_the_configured_one(spark):
    named = spark.sparkContext.getCheckpointDir()
    assert session.shared_dir(spark) == (named or spark.sparkContext.getCheckpointDir())
    assert session.new_table_path(spark, "x").startswith(session.shared_dir(spark))


def test_shuffle_partitions_follow_the_input(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert session.size_shuffles(spark, 10) == spark.sparkContext.defaultParallelism
        assert session.size_shuffles(spark, 64 * 1024**3) == 1024
        assert session.size_shuffles(spark, 100 * 1024**4) == 4 * 100 * 1024**4 // session.PARTITION_BYTES
        assert spark.conf.get("spark.sql.shuffle.partitions") == str(4 * 100 * 1024**4 // session.PARTITION_BYTES)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def sales(spark, hot=False):
    df = generators.gen_uniform(spark, 20_000)
    return df.withColumn("subcategory", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("subcategory"))) if hot else df


def test_covering_copy_is_narrow_and_balanced(spark, tmp_path):
    path = str(tmp_path / "c")
    df = sales(spark, hot=True)
    narrow = layout.covering_projection(df, ["subcategory"], ["amount"], path, files=8)
    assert narrow.columns == ["subcategory", "amount"]
    assert values(agg.group_sum(narrow, "subcategory", "amount", 2)) == values(agg.group_sum(df, "subcategory", "amount", 2))
    rows = [r["count"] for r in narrow.groupBy(F.input_file_name()).count().collect()]
    assert len(rows) == 8 and max(rows) < 20_000 / 4


def test_equal_rows_are_split_over_files(spark, tmp_path):
    df = spark.range(200_000).select((F.col("id") % 3 == 0).cast("int").alias("k"), F.lit(1).alias("x"))
    narrow = layout.covering_projection(df, ["k"], ["x"], str(tmp_path / "two"), files=8)
    rows = [r["count"] for r in narrow.groupBy(F.input_file_name()).count().collect()]
    assert len(rows) == 8 and max(rows) < 2 * min(rows)
    assert narrow.columns == ["k", "x"] and values(narrow.groupBy("k").count()) == values(df.groupBy("k").count())


@pytest.mark.parametrize("hot", [False, True])
def test_bucketed_copy(spark, hot):
    name, path = session.new_table(spark, "b")
    df = sales(spark, hot)
    table = layout.bucketed_projection(spark, df, ["subcategory"], ["amount"], name, path, buckets=32)
    grouped = agg.group_sum(table, "subcategory", "amount", 2)
    assert values(grouped) == values(agg.group_sum(df, "subcategory", "amount", 2))
    # no exchange on the bucketed copy, whatever the keys: the layout is the caller's choice
    assert "hashpartitioning(subcategory" not in plan_of(grouped)
    sinks.drop_table(spark, name)


def test_statistics(spark):
    rows = [(1, "b", 2.5), (2, None, 1.5), (2, "a", None), (None, "a", 9.0)]
    df = spark.createDataFrame(rows, "k long, s string, x double")
    expected = [("k", 4, 1, "1", "2", 2), ("s", 4, 1, "a", "b", 2), ("x", 4, 1, "1.5", "9.0", 3)]
    assert values(layout.column_stats(df)) == expected
    assert values(layout.column_stats(df, exact=True)) == expected
    empty = [("k", 0, 0, None, None, 0)]
    assert values(layout.column_stats(df.limit(0), ["k"])) == values(layout.column_stats(df.limit(0), ["k"], True)) == empty
    plan = plan_of(layout.column_stats(df, ["s"], exact=True))
    assert "Sort (" not in plan and plan.count("HashAggregate (") >= 2
    name, path = session.new_table(spark, "s")
    sinks.materialize(df, name, path)
    layout.analyze(spark, name, ["k", "s"])
    described = {r.info_name: r.info_value for r in spark.sql(f"DESCRIBE EXTENDED {name} k").collect()}
    assert described["distinct_count"] == "2" and described["num_nulls"] == "1"
    sinks.drop_table(spark, name)


def test_stored_bytes_are_the_file_sizes(spark, sf_dir, tmp_path):
    folder = str(tmp_path / "many")
    spark.range(1000).repartition(4).write.parquet(folder)
    tables = {"many": folder, "part": f"{sf_dir}/part.parquet", "orders": f"{sf_dir}/orders.parquet"}
    got = {r.table: (r.bytes, r.readable) for r in storage.stored_bytes(spark, tables).collect()}
    assert got["many"][0] == sum(os.path.getsize(f) for f in glob.glob(f"{folder}/*.parquet"))
    for name in ("part", "orders"):
        assert got[name][0] == os.path.getsize(tables[name])
    assert got["part"][1].endswith("KB")


def test_stored_and_logical_bytes_in_one_report(spark, tmp_path):
    folder = str(tmp_path / "t")
    rows = spark.createDataFrame([("é",), ("abc",), (None,)], "s string")
    rows.write.option("compression", "none").text(folder)
    row = storage.table_report(spark, {"t": (folder, rows)}).first()
    assert (row.table, row.rows, row.stored, row.logical) == ("t", 3, 8, 5)
    assert row.stored_text == "8.0 B" and row.logical_text == "5.0 B" and row.gain == 5 / 8


def test_dictionary_pages_shrink_a_repeating_column(spark, tmp_path):
    df = generators.gen_events(spark, 50_000, 10).select("id", "event_type")
    plain, coded = str(tmp_path / "plain"), str(tmp_path / "coded")
    df.write.option("parquet.enable.dictionary", "false").option("compression", "none").parquet(plain)
    df.write.option("compression", "none").parquet(coded)
    size = {r.table: r.bytes for r in storage.stored_bytes(spark, {"plain": plain, "coded": coded}).collect()}
    assert size["coded"] < size["plain"] * 0.7


def test_logical_bytes(spark):
    df = spark.createDataFrame([(1, "é", 1.0, True), (None, "ab", None, None)], "k long, s string, x double, b boolean")
    df = df.withColumn("v", scalars.rand_u64("s"))
    assert {r.column: r.bytes for r in storage.logical_bytes(df).collect()} == {"k": 8, "s": 4, "x": 8, "b": 1, "v": 32}
    assert tuple(storage.table_size(df).first()) == (2, 53)
    assert tuple(storage.table_size(df.limit(0)).first()) == (0, 0)
    with pytest.raises(TypeError):
        storage.logical_bytes(df.select(F.array("k").alias("a")))


RUNS = [
    # op, variant, run, seconds, bytes
    ("sum", "fast", 0, 90.0, 10), ("sum", "fast", 1, 1.0, -5), ("sum", "fast", 2, 3.0, 2048),
    ("sum", "slow", 0, 0.1, 7), ("sum", "slow", 1, 8.0, 0),
    ("sort", "fast", 5, 1.0, -1), ("sort", "fast", 7, 0.0, -2),
    ("sort", "slow", 0, 1.0, 1), ("sort", "slow", 1, 4.0, 1536),
    ("join", "fast", 0, 1.0, 5),  # nothing left after the warm-up
    ("join", "slow", 3, 1.0, 5), ("join", "slow", 4, 2.0, 5),
    ("tie", "fast", 0, 1.0, 5), ("tie", "fast", 1, 2.0, 5), ("tie", "slow", 0, 1.0, 5), ("tie", "slow", 1, 2.0, 5),
]


@pytest.fixture(scope="module")
def runs(spark):
    return spark.createDataFrame(random.Random(1).sample(RUNS, len(RUNS)), schemas.MEASUREMENTS)


def test_mean_without_the_first_run(runs):
    assert values(compare.mean_after_warmup(runs)) == [
        ("join", "slow", 2.0), ("sort", "fast", 0.0), ("sort", "slow", 4.0),
        ("sum", "fast", 2.0), ("sum", "slow", 8.0), ("tie", "fast", 2.0), ("tie", "slow", 2.0),
    ]


def test_reports(runs):
    means = compare.mean_after_warmup(runs)
    assert ("join", None, 2.0) in values(compare.comparison_pivot(means, ["fast", "slow"]))
    assert values(compare.fastest(means)) == [
        ("join", "slow", None), ("sort", "fast", None), ("sum", "fast", 4.0), ("tie", "fast", None),
    ]
    ratios = {r.op: r.slow_to_fast for r in compare.ratio_to(means, "fast", ["slow"]).collect()}
    assert ratios == {"sum": 4.0, "sort": float("inf"), "join": None, "tie": 1.0}
    assert values(compare.memory_pivot(runs, ["fast", "slow"])) == [
        ("join", "5.0 B", "5.0 B"), ("sort", "0.0 B", "1.5 KB"), ("sum", "2.0 KB", "7.0 B"), ("tie", "5.0 B", "5.0 B"),
    ]


def test_arriving_files_are_inserted_once(spark, sf_dir, tmp_path):
    incoming, target, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    events = named_table(spark, sf_dir, "events")
    defaults = {"id": scalars.uuid_v7("ts", "event_id"), "value": F.lit(0.0)}

    def insert():
        rows = incremental.arriving_rows(spark, incoming, schemas.EVENTS)
        incremental.insert_arriving(rows, ["id", "value"], defaults, target, progress).awaitTermination()
        return spark.read.parquet(target).count()

    events.write.parquet(incoming)
    n = events.count()
    assert insert() == n
    assert insert() == n
    events.limit(10).write.mode("append").parquet(incoming)
    assert insert() == n + 10


def test_batch_operators_take_streams(spark, sf_dir, tmp_path):
    incoming = str(tmp_path / "in")
    events = named_table(spark, sf_dir, "events")
    events.write.parquet(incoming)
    stream = cols.filter_gt(incremental.arriving_rows(spark, incoming, schemas.EVENTS), "value", 50.0)
    counts = agg.group_count(stream, "event_type")
    done = counts.writeStream.format("memory").queryName("by_type").outputMode("complete").trigger(availableNow=True).start()
    done.awaitTermination()
    assert values(spark.table("by_type")) == values(agg.group_count(cols.filter_gt(events, "value", 50.0), "event_type"))


def test_conform_orders_and_casts(spark):
    df = spark.range(2).select(F.col("id").cast("int").alias("b"), F.lit("7").alias("a"), "id")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    assert values(conform(df, schema)) == [(7, 0), (7, 1)]
