"""Ranks, pages, samples and time-ordered IDs, with hot groups and small bounds."""

import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from sparkcols.functions import scalars
from sparkcols.operators import columns as cols, ids, joins, ordering as order
from sparkcols.sources import generators, layout

BASE = 1_700_000_000_000  # milliseconds


def events_at(spark, rows):
    """Rows of (id, machine, millisecond offset)."""
    df = spark.createDataFrame(rows, "id long, machine long, ms long")
    return df.withColumn("ts", F.timestamp_millis(F.col("ms") + BASE)).repartition(5)


def slots_by_hand(rows, seq_bits):
    """Sequential reference: each machine walks its rows in (time, id) order."""
    out, last = {}, {}
    for row_id, machine, ms in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        slot = max((BASE + ms) << seq_bits, last.get(machine, -1) + 1)
        last[machine] = slot
        tick, seq = slot >> seq_bits, slot & (2**seq_bits - 1)
        out[row_id] = (tick << (10 + seq_bits)) | (machine << seq_bits) | seq
    return out


@pytest.mark.parametrize("seq_bits", [2, 4, 12])
def test_timed_id_equals_the_sequential_walk(spark, seq_bits):
    draw = random.Random(seq_bits)
    # one machine holds a third of the rows, and a third of those share a millisecond
    rows = []
    for i in range(3000):
        machine = 7 if i % 3 == 0 else draw.randrange(40)
        ms = 500 if i % 9 == 0 else draw.randrange(1500)
        rows.append((i, machine, ms))
    got = ids.timed_id(events_at(spark, rows), "ts", F.col("machine"), "id", seq_bits=seq_bits)
    got = {r.id: r.sid for r in got.collect()}
    assert got == slots_by_hand(rows, seq_bits)
    assert len(set(got.values())) == len(rows)


def test_timed_id_fields_and_order(spark):
    rows = [(i, i % 3, i * 2) for i in range(600)]
    df = ids.timed_id(events_at(spark, rows), "ts", F.col("machine"), "id")
    out = df.select("id", "machine", "ms", "sid").collect()
    for r in out:
        assert r.sid >> 22 == BASE + r.ms and (r.sid >> 12) & 1023 == r.machine and r.sid & 4095 == 0
    for m in range(3):
        mine = sorted((r for r in out if r.machine == m), key=lambda r: r.ms)
        assert [r.sid for r in mine] == sorted(r.sid for r in mine)


def test_timed_id_without_time_or_machine(spark):
    rows = [(1, 1, 5), (2, None, 5), (3, 1, None), (4, 1, 5)]
    got = {r.id: r.sid for r in ids.timed_id(events_at(spark, rows), "ts", F.col("machine"), "id").collect()}
    assert got[2] is None and got[3] is None
    assert got[4] > got[1]


@pytest.fixture
def fixed_partitions(spark):
    """Small inputs keep their shuffle partitions."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_timed_id_window_runs_on_range_partitions(spark, fixed_partitions):
    rows = events_at(spark, [(i, 1, i) for i in range(100)])
    df = ids.timed_id(rows, "ts", F.col("machine"), "id", seq_bits=1, tick=F.floor(F.col("ms") / 7) + BASE)
    plan = plan_of(df)
    assert "shufflepartitionidpassthrough" in plan
    assert plan.count("hashpartitioning(_part") == 1  # of the summary rows only
    assert df.select("sid").distinct().count() == 100


@pytest.mark.parametrize("seq_bits", [1, 3])
def test_timed_id_carries_over_many_partitions(spark, fixed_partitions, seq_bits):
    draw = random.Random(9)
    rows = [(i, 5 if i % 3 else i % 2, draw.randrange(200)) for i in range(2000)]
    got = ids.timed_id(events_at(spark, rows), "ts", F.col("machine"), "id", seq_bits=seq_bits)
    assert {r.id: r.sid for r in got.collect()} == slots_by_hand(rows, seq_bits)


def test_uuid_is_version_7_and_time_ordered(spark):
    df = spark.range(500).withColumn("ts", F.timestamp_millis(F.col("id") * 1000 + BASE))
    out = [r.u for r in df.orderBy("id").select(scalars.uuid_v7("ts", "id").alias("u")).collect()]
    assert out == sorted(out) and len(set(out)) == 500
    for i, text in enumerate(out):
        assert len(text) == 36 and text[14] == "7" and text[19] == "8"
        assert int(text.replace("-", "")[:12], 16) == BASE + i * 1000


def test_timestamps_without_a_zone_are_utc_in_every_session(spark):
    times = [datetime(2024, 1, 1, 0, 0, 7, 179575), datetime(2024, 3, 31, 2, 30, 0, 999999), datetime(1969, 12, 31, 23, 59, 58, 500)]
    expected = [int(t.replace(tzinfo=timezone.utc).timestamp() * 1000 // 1) for t in times]
    df = spark.createDataFrame([(t,) for t in times], "ts timestamp_ntz")
    try:
        for zone in ("UTC", "Europe/Berlin", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert [r[0] for r in df.select(scalars.epoch_millis("ts")).collect()] == expected
            zoned = spark.range(1).select(F.timestamp_millis(F.lit(BASE)).alias("ts"))
            assert zoned.select(scalars.epoch_millis("ts")).first()[0] == BASE
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert "unix_millis" not in plan_of(df.select(scalars.epoch_millis("ts").alias("ms")))


def test_random_values_cover_the_unsigned_range(spark):
    rows = spark.range(5000).select(scalars.rand_u64("id").alias("v")).agg(
        F.max("v").alias("hi"), F.min("v").alias("lo"), F.count_distinct("v").alias("n")
    ).first()
    assert rows.hi > 2**63 and rows.lo < 2**56 and rows.n == 5000


def test_uuid_key_facts(spark):
    n = 10_000
    df = spark.range(n).select(scalars.uuid_v7(F.timestamp_millis(F.col("id") * 50 + BASE), "id").alias("id")).cache()
    five = [r.id for r in ids.anchor_keys(df, "id").orderBy("id").collect()]
    assert cols.point_lookup(df, "id", five[0]).count() == 1
    assert cols.range_count(df, "id", five[0], five[-1]).first().n == 3
    assert cols.multi_lookup(df, "id", five).count() == 5
    sample = ids.sample_keys(df, "id", 100)
    assert joins.join_count(df, sample, "id", "id").first().n == 100
    assert df.distinct().count() == n


@pytest.mark.parametrize("offset,limit", [(0, 5), (25_000, 5), (10_000, 100), (49_990, 100), (60_000, 5)])
@pytest.mark.parametrize("kind", ["long", "text"])
def test_page_is_narrowed_to_the_same_rows(spark, kind, offset, limit):
    key = F.col("id") * 3 if kind == "long" else F.md5(F.col("id").cast("string"))
    df = spark.range(50_000).select(key.alias("k"))
    expected = [r.k for r in df.orderBy("k").offset(offset).limit(limit).collect()]
    assert [r.k for r in order.page(df, "k", limit, offset).collect()] == expected


def test_page_inside_a_hot_run(spark):
    hot = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 15_000).otherwise(F.col("id")).alias("k"))
    for offset in (9_990, 15_000, 19_990, 19_999):
        expected = [r.k for r in hot.orderBy("k").offset(offset).limit(30).collect()]
        assert [r.k for r in order.page(hot, "k", 30, offset).collect()] == expected


def test_sample_is_cut_to_the_same_keys(spark):
    df = spark.range(40_000)
    expected = [r.id for r in df.orderBy(F.md5(F.col("id").cast("string")), "id").limit(200).collect()]
    sample = ids.sample_keys(df, "id", 200)
    assert [r.id for r in sample.collect()] == expected
    assert "Limit" not in plan_of(sample) and "TakeOrdered" not in plan_of(sample)
    salted = [r.id for r in ids.sample_keys(df, "id", 200, salt="s").collect()]
    assert len(set(salted)) == 200 and salted != expected
    assert ids.sample_keys(df, "id", 50_000).count() == 40_000


def test_bound_values_are_data_not_text(spark):
    df = spark.createDataFrame([("x' OR '1'='1",), ("y",)], "name string")
    got = ids.bound_query(spark, "SELECT * FROM {t} WHERE name = :n", {"t": df}, n="x' OR '1'='1").collect()
    assert len(got) == 1


def test_sort_breaks_ties_by_id(spark):
    df = spark.createDataFrame([(i, float(i % 2)) for i in range(50)], "id long, amount double").repartition(6)
    got = [(r.id, r.amount) for r in order.sort_desc(df, "amount", "id").collect()]
    assert got == sorted(((i, float(i % 2)) for i in range(50)), key=lambda r: (-r[1], r[0]))
    view = order.ordered_view(df, "amount DESC, id")
    assert [(r.id, r.amount) for r in view.collect()] == got
    assert "Sort" in plan_of(view)


def test_row_number_with_a_hot_value(spark):
    df = spark.range(9_000).select("id", F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 11).alias("v"))
    got = {r.id: r.rn for r in order.with_row_number(df, [F.desc("v"), "id"]).collect()}
    pairs = [(i, 5 if i % 3 == 0 else i % 11) for i in range(9_000)]
    expected = {i: rn for rn, (i, v) in enumerate(sorted(pairs, key=lambda p: (-p[1], p[0])), 1)}
    assert got == expected


def test_positions_split_a_hot_value_over_tasks(spark, fixed_partitions):
    df = spark.range(80_000).select("id", F.lit(1).alias("v"))
    sizes = [r["count"] for r in order.with_position(df, ["v", "id"]).groupBy("_part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 20_000


def test_sorted_layout_has_disjoint_files_and_prunes(spark, tmp_path):
    df = generators.gen_values(spark, 20_000).orderBy(F.xxhash64("id"))
    stored = layout.sorted_layout(df, ["id"], str(tmp_path / "ids"), files=4)
    assert stored.exceptAll(df).count() == 0 and stored.count() == 20_000
    ranges = (
        stored.withColumn("file", F.input_file_name()).groupBy("file")
        .agg(F.min("id").alias("lo"), F.max("id").alias("hi")).orderBy("lo").collect()
    )
    assert len(ranges) == 4
    assert all(a.hi < b.lo for a, b in zip(ranges, ranges[1:]))
    plan = plan_of(cols.multi_lookup(stored, "id", [10, 11, 12]))
    assert "In(id, [10,11,12])" in plan
    assert "EqualTo(id,10)" in plan_of(cols.point_lookup(stored, "id", 10))


@pytest.mark.parametrize("k", [0, 1, 99, 100, 101, 5_000, 8_999, 9_000, 9_001])
def test_sample_with_a_hot_key(spark, k):
    """A third of the rows share a key: the cut can fall inside its run."""
    df = spark.range(9_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"))
    expected = [r.k for r in df.orderBy(F.md5(F.col("k").cast("string")), "k").limit(k).collect()]
    assert [r.k for r in ids.sample_keys(df, "k", k).collect()] == expected


def test_sample_keeps_its_partitions(spark, fixed_partitions):
    df = spark.range(0, 40_000, 1, 6)
    keys = df.select("id")
    cut, excess = ids.digest_cut(keys, scalars.digest("id"), 4_000)
    assert excess == 0
    kept = keys.where(F.substring(scalars.digest("id"), 1, len(cut)) <= cut)
    assert kept.count() == 4_000 and kept.rdd.getNumPartitions() == 6


def test_page_sorts_only_its_own_rows(spark, fixed_partitions):
    df = spark.range(30_000).select(F.md5(F.col("id").cast("string")).alias("k"))
    plan = plan_of(order.page(df, "k", 100, 20_000))
    assert "TakeOrdered" not in plan and "Limit" not in plan and "_part" in plan
    assert order.page(df.limit(0), "k", 5).count() == 0


def test_names_of_its_own_are_refused(spark):
    df = spark.range(3).withColumn("_part", F.lit(9))
    with pytest.raises(ValueError):
        order.with_row_number(df, ["id"])
    with pytest.raises(ValueError):
        ids.timed_id(events_at(spark, [(1, 1, 1)]).withColumn("_Tick", F.lit(1)), "ts", F.col("machine"), "id")


@pytest.mark.parametrize("text", ["2110-01-01", "1969-12-31 23:59:59"])
def test_times_without_an_id_stop_the_job(spark, text):
    df = spark.createDataFrame([(1, 1)], "id long, machine long").withColumn("ts", F.lit(text).cast("timestamp"))
    with pytest.raises(Exception, match="no ID for the time"):
        ids.timed_id(df, "ts", F.col("machine"), "id").collect()
    last = df.withColumn("ts", F.lit("2039-01-01").cast("timestamp"))
    assert ids.timed_id(last, "ts", F.col("machine"), "id").first().sid > 0


def test_uuid_bytes_and_text(spark):
    df = spark.range(300).withColumn("ts", F.timestamp_millis(F.col("id") * 1000 + BASE))
    rows = df.select(scalars.uuid_bytes("ts", "id").alias("b"), scalars.uuid_v7("ts", "id").alias("t")).collect()
    assert all(len(r.b) == 16 and r.t.replace("-", "") == r.b.hex() for r in rows)
    back = df.select(scalars.uuid_text(scalars.uuid_bytes("ts", "id")).alias("t")).collect()
    assert [r.t for r in back] == [r.t for r in rows]
    with pytest.raises(Exception, match="no UUID for the time"):
        df.select(scalars.uuid_v7(F.timestamp_millis(F.lit(-1)), "id")).collect()
    assert df.select(scalars.uuid_v7(F.lit(None).cast("timestamp"), "id").alias("t")).first().t is None


def scanned_rows(df) -> int:
    """Rows that the scan of a plan without exchanges gave out."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


@pytest.mark.parametrize("kind", ["long", "uuid", "text"])
def test_lookups_on_stored_ids_skip_row_groups(spark, tmp_path, kind):
    n = 40_000
    df = spark.range(n).withColumn("ts", F.timestamp_millis(F.col("id") * 50 + BASE))
    key = {"long": F.col("id") * 7, "uuid": scalars.uuid_bytes("ts", "id"), "text": scalars.uuid_v7("ts", "id")}[kind]
    path = str(tmp_path / kind)
    table = layout.sorted_layout(df.select(key.alias("id"), F.col("id").alias("event_id")), ["id"], path, files=8)
    five = [r.id for r in ids.anchor_keys(table, "id").collect()]
    five = [bytes(x) if kind == "uuid" else x for x in five]
    point, several = cols.point_lookup(table, "id", five[0]), cols.multi_lookup(table, "id", five)
    span = table.where(cols.between_open("id", five[0], five[-1]))
    for found, rows, pushed in ((point, 1, "EqualTo(id"), (several, 5, "In(id"), (span, 3, "GreaterThan(id")):
        plan = plan_of(found)
        assert pushed in plan.split("PushedFilters: ")[1].split("\n")[0]
        assert found.count() == rows
        assert scanned_rows(found) <= n / 4
