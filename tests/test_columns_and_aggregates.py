"""Column operators and aggregates: hand-made edge cases, golden facts and plans."""

import math
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from conftest import plan_of
from sparkcols.functions import scalars
from sparkcols.operators import aggregates as agg, columns as cols, ordering as order
from sparkcols.sources import generators
from sparkcols.sources.tables import named_table

SALES = "id long, category string, subcategory string, amount double, quantity long"


@pytest.fixture(scope="module")
def sales(spark):
    rows = [
        (0, "a", "x", 1.5, 2), (1, "a", "y", 500.0, 1), (2, "b", "x", 500.01, 3),
        (3, None, "x", 2.0, 4), (4, "b", None, None, 5), (5, "a|x", "y", 2.0, 1), (6, "a", "x|y", 4.0, 1),
    ]
    return spark.createDataFrame(rows, SALES)


def values(df):
    return [tuple(r) for r in df.collect()]


def test_multiply_one_column_or_whole_row(sales):
    assert values(cols.col_multiply(sales, "amount", "quantity"))[0] == (3.0,)
    replaced = cols.col_multiply_replace(sales, "amount", "quantity")
    assert replaced.columns == sales.columns
    assert values(replaced)[2] == (2, "b", "x", 500.01 * 3, 3)


def test_threshold_is_strict_and_drops_null(sales):
    assert [r.id for r in cols.filter_gt(sales, "amount", 500.0).collect()] == [2]
    assert values(cols.filter_text(sales, "amount > 500.0")) == values(cols.filter_gt(sales, "amount", 500.0))


def test_open_range_excludes_both_ends(sales):
    assert values(cols.range_count(sales, "id", 1, 4)) == [(2,)]


def test_like_underscore_is_a_wildcard(spark):
    names = spark.createDataFrame([("tab_click",), ("tab_dblclick",), ("click",), ("tabclick",)], "name string")
    assert values(cols.count_like(names, "name", "%_click")) == [(3,)]


def test_null_rules_of_counts(sales):
    assert values(agg.count_distinct(sales, "category")) == [(3,)]
    assert values(agg.count_groups(sales, "category")) == [(4,)]
    assert dict(values(agg.group_count(sales, "category"))) == {"a": 3, "b": 2, None: 1, "a|x": 1}


def test_empty_input(spark):
    empty = spark.createDataFrame([], SALES)
    assert values(agg.col_sum(empty, "amount", 2)) == [(None,)]
    assert values(agg.row_count(empty)) == [(0,)]
    assert values(agg.group_multi(empty, "category", "amount", 2)) == []
    assert values(order.page(empty, "id", 5, 0)) == []
    assert values(order.with_row_number(empty, ["id"])) == []


def test_text_keys_can_collide_where_column_keys_do_not(sales):
    pairs = sales.where("id >= 5")
    joined = pairs.withColumn("k", scalars.concat_key("category", "subcategory"))
    assert agg.group_count(joined, "k").count() == 1
    assert agg.group_count(pairs, ["category", "subcategory"]).count() == 2


def test_spec_names_and_functions(sales):
    spec = {"amount": [("sum", "s"), ("mean", "m")], "quantity": [("min", "lo"), ("max", "hi")]}
    out = {r.category: tuple(r)[1:] for r in agg.agg_spec(sales, "category", spec).collect()}
    assert out["b"] == (500.01, 500.01, 3, 5)


def test_exact_sum_does_not_depend_on_partitioning(spark):
    draw = random.Random(3)
    cents = [draw.randrange(-10**9, 10**9) for _ in range(5000)] + [None, 0]
    df = spark.createDataFrame([(None if c is None else c / 100,) for c in cents], "x double")
    expected = sum(c for c in cents if c is not None) / 100
    for parts in (1, 3, 16):
        row = df.repartition(parts).agg(agg.exact_sum("x", 2).alias("t"), agg.mean_of("x", 2).alias("m")).first()
        assert row.t == expected
        assert row.m == expected / 5001


def test_exact_sum_goes_beyond_the_long_range(spark):
    big = spark.range(3000).select(F.lit(2.0**52).alias("x"))
    assert big.agg(agg.exact_sum("x", 2).alias("t")).first().t == pytest.approx(3000 * 2.0**52, rel=1e-15)


def test_event_counts_follow_from_the_generator(spark):
    n = 20_000
    for k, in_list, clicks in ((10, n // 10, 2 * n // 10), (1000, 5 * n // 1000, 100 * n // 1000)):
        events = generators.gen_events(spark, n, k)
        names = ["button_click", "link_hover", "form_submit", "modal_open", "grid_resize"]
        counts = agg.group_count(events, "event_type").collect()
        assert len(counts) == k and {r.n for r in counts} == {n // k}
        assert values(cols.count_eq(events, "event_type", "button_click")) == [(n // k,)]
        assert values(cols.count_in(events, "event_type", names)) == [(in_list,)]
        assert values(cols.count_like(events, "event_type", "%_click")) == [(clicks,)]
        assert values(agg.count_distinct(events, "event_type")) == [(k,)]
        first = "button_blur" if k == 10 else "accordion_blur"
        expected = [first] * min(100, n // k)
        assert [r[0] for r in order.top_asc(events, "event_type", 100).collect()][: len(expected)] == expected


def test_uniform_generator_domains_and_independence(spark):
    sales = generators.gen_uniform(spark, 50_000)
    row = sales.agg(
        F.count_distinct("category").alias("c"), F.count_distinct("subcategory").alias("s"),
        F.count_distinct("category", "subcategory").alias("cs"), F.min("amount").alias("lo"),
        F.max("amount").alias("hi"), F.min("quantity").alias("qlo"), F.max("quantity").alias("qhi"),
        F.avg((F.col("amount") > 500).cast("int")).alias("half"),
    ).first()
    assert (row.c, row.s, row.qlo, row.qhi) == (10, 1000, 1, 100)
    assert row.cs > 9_900 and 0 <= row.lo and row.hi < 1000 and abs(row.half - 0.5) < 0.02
    assert values(sales.orderBy("id").limit(50)) == values(
        generators.uniform_columns(spark.range(50_000).repartition(7), "id").orderBy("id").limit(50)
    )


def python_bytes(n):
    """Independent text rule: divide by 1024 until below it."""
    size, units = float(n), ["B", "KB", "MB", "GB", "TB", "PB"]
    while size >= 1024 and len(units) > 1:
        size, units = size / 1024, units[1:]
    return f"{size:.1f} {units[0]}"


def python_time(s):
    scale = [(3600, 1 / 3600, "hour"), (60, 1 / 60, "min"), (1, 1, "sec"), (1e-3, 1e3, "ms"), (1e-6, 1e6, "us")]
    for floor, _, unit in scale:
        if s >= floor:
            value = s / floor if floor >= 1 else s * (1e3 if unit == "ms" else 1e6)
            return f"{value:.2f} {unit}"
    return f"{s * 1e9:.2f} ns"


def test_readable_sizes(spark):
    sizes = [0, 1, 1023, 1024, 1280, 1792, 1536, 1024**2 - 1, 1024**2, 1024**3 * 5 // 4, 1024**4, 1024**5 * 7, 10**18]
    draw = random.Random(5)
    sizes += [draw.randrange(2 ** draw.randrange(1, 60)) for _ in range(500)]
    df = spark.createDataFrame([(n,) for n in sizes] + [(None,)], "n long")
    got = {r.n: r.t for r in df.select("n", scalars.readable_bytes("n").alias("t")).collect()}
    assert got.pop(None) is None
    assert got == {n: python_bytes(n) for n in sizes}


def test_readable_durations(spark):
    draw = random.Random(6)
    times = [0.0, 123.30, 0.125, 1.005, 59.995, 60.0, 3599.99, 3600.0, 1e-3, 1e-6, 1e-9, 5e5, 2.675, 0.001005]
    times += [round(draw.uniform(0, 10 ** draw.randrange(-6, 6)), draw.randrange(2, 9)) for _ in range(800)]
    df = spark.createDataFrame([(t,) for t in times], "s double")
    got = {r.s: r.t for r in df.select("s", scalars.readable_time("s").alias("t")).collect()}
    assert got == {t: python_time(t) for t in times}


@settings(max_examples=15, deadline=None)
@given(a=st.floats(-1e6, 1e6), b=st.one_of(st.none(), st.floats(-10, 10), st.just(0.0)))
def test_safe_ratio(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a double, b double")
    got = df.select(scalars.safe_ratio("a", "b")).first()[0]
    assert got == (None if b is None else a / b if b > 0 else math.inf)


def test_filter_and_columns_reach_the_scan(spark, sf_dir):
    lineitem = named_table(spark, sf_dir, "lineitem")
    plan = plan_of(agg.group_sum(cols.filter_gt(lineitem, "l_extendedprice", 5e4), "l_returnflag", "l_quantity"))
    assert "GreaterThan(l_extendedprice,50000.0)" in plan
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_returnflag:string>" in plan
    assert plan.count("Exchange") <= 3  # one exchange, named again in the details


def test_top_k_is_one_operator(spark, sf_dir):
    plan = plan_of(order.top_asc(named_table(spark, sf_dir, "part"), "p_name", 100))
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


def test_exact_sums_refuse_further_decimals_and_keep_nan(spark):
    df = spark.createDataFrame([(0.125,), (0.125,)], "x double")
    with pytest.raises(Exception, match="more than 2 decimals"):
        agg.col_sum(df, "x", scale=2).collect()
    assert agg.col_sum(df, "x", scale=3).first().total == 0.25
    cents = spark.range(100_000).select((F.col("id") / 100).alias("x"))
    assert agg.col_sum(cents, "x", scale=2).first().total == 49999500.0
    for odd, test in ((float("nan"), lambda v: v != v), (float("inf"), lambda v: v == float("inf"))):
        rows = spark.createDataFrame([(1.5,), (odd,), (None,)], "x double")
        assert test(agg.col_sum(rows, "x", scale=2).first().total)
    assert agg.col_sum(df.limit(0), "x", scale=2).first().total is None
