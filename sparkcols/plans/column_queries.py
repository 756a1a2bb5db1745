"""Column and group-by queries over the sales-like table (``lineitem``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkcols.functions import scalars
from sparkcols.operators import aggregates as agg, columns as cols, ordering as order
from sparkcols.plans.registry import query
from sparkcols.sources.tables import named_table

PRICE_SUM = "CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE)"
PRICE_THRESHOLD = 50000.0
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named_table(spark, sf_dir, "lineitem")


@query(
    f"""SELECT l_returnflag, {PRICE_SUM} AS total, {PRICE_SUM} / count(l_extendedprice) AS average,
    min(l_extendedprice) AS minimum, max(l_extendedprice) AS maximum FROM lineitem GROUP BY l_returnflag"""
)
def group_multi(spark, sf_dir):
    return agg.group_multi(lineitem(spark, sf_dir), "l_returnflag", "l_extendedprice", scale=2)


@query("SELECT * FROM orders")
def select_all(spark, sf_dir):
    return named_table(spark, sf_dir, "orders").select("*")


@query("SELECT l_orderkey, l_extendedprice FROM lineitem")
def select_columns(spark, sf_dir):
    return lineitem(spark, sf_dir).select("l_orderkey", "l_extendedprice")


@query(f"SELECT {PRICE_SUM} AS total FROM lineitem")
def col_sum(spark, sf_dir):
    return agg.col_sum(lineitem(spark, sf_dir), "l_extendedprice", scale=2)


@query("SELECT l_extendedprice * l_quantity AS product FROM lineitem")
def col_multiply(spark, sf_dir):
    return cols.col_multiply(lineitem(spark, sf_dir), "l_extendedprice", "l_quantity")


@query("SELECT * REPLACE (l_extendedprice * l_quantity AS l_extendedprice) FROM lineitem")
def col_multiply_replace(spark, sf_dir):
    return cols.col_multiply_replace(lineitem(spark, sf_dir), "l_extendedprice", "l_quantity")


@query("SELECT * FROM lineitem WHERE l_extendedprice > 50000")
def filter_gt(spark, sf_dir):
    return cols.filter_gt(lineitem(spark, sf_dir), "l_extendedprice", PRICE_THRESHOLD)


@query("SELECT * FROM lineitem WHERE l_extendedprice > 50000")
def filter_text(spark, sf_dir):
    return cols.filter_text(lineitem(spark, sf_dir), f"l_extendedprice > {PRICE_THRESHOLD}")


@query("SELECT * FROM lineitem")
def sort_desc(spark, sf_dir):
    return order.sort_desc(lineitem(spark, sf_dir), "l_extendedprice", *LINE_KEY)


@query(
    """SELECT *, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey)
    AS rn FROM lineitem"""
)
def sort_rank(spark, sf_dir):
    """The same sort with each row's position, which makes its order checkable."""
    return order.with_row_number(lineitem(spark, sf_dir), [F.desc("l_extendedprice"), *LINE_KEY])


@query("SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def ordered_view(spark, sf_dir):
    return order.ordered_view(named_table(spark, sf_dir, "orders"), "o_totalprice DESC, o_orderkey")


@query("SELECT count(*) AS n FROM lineitem")
def row_count(spark, sf_dir):
    return agg.row_count(lineitem(spark, sf_dir))


@query("SELECT count(DISTINCT p_brand) AS n FROM part")
def count_distinct(spark, sf_dir):
    return agg.count_distinct(named_table(spark, sf_dir, "part"), "p_brand")


@query("SELECT count(*) AS n FROM (SELECT p_brand FROM part GROUP BY p_brand)")
def count_groups(spark, sf_dir):
    return agg.count_groups(named_table(spark, sf_dir, "part"), "p_brand")


@query(f"SELECT l_returnflag, {PRICE_SUM} AS total FROM lineitem GROUP BY l_returnflag")
def group_sum(spark, sf_dir):
    return agg.group_sum(lineitem(spark, sf_dir), "l_returnflag", "l_extendedprice", scale=2)


@query("SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def group_count(spark, sf_dir):
    return agg.group_count(lineitem(spark, sf_dir), "l_returnflag")


@query(f"SELECT l_returnflag, l_partkey, {PRICE_SUM} AS total FROM lineitem GROUP BY l_returnflag, l_partkey")
def group_multikey_sum(spark, sf_dir):
    return agg.group_sum(lineitem(spark, sf_dir), ["l_returnflag", "l_partkey"], "l_extendedprice", scale=2)


@query(f"SELECT l_partkey, {PRICE_SUM} AS total FROM lineitem GROUP BY l_partkey")
def group_highcard_sum(spark, sf_dir):
    return agg.group_sum(lineitem(spark, sf_dir), "l_partkey", "l_extendedprice", scale=2)


@query(
    """SELECT l_returnflag, sum(l_quantity) AS total, sum(l_quantity) / count(l_quantity) AS average,
    min(l_quantity) AS minimum, max(l_quantity) AS maximum, min(l_discount) AS lowest_discount
    FROM lineitem GROUP BY l_returnflag"""
)
def agg_spec(spark, sf_dir):
    spec = {
        "l_quantity": [("sum", "total"), ("mean", "average"), ("min", "minimum"), ("max", "maximum")],
        "l_discount": [("min", "lowest_discount")],
    }
    return agg.agg_spec(lineitem(spark, sf_dir), "l_returnflag", spec, scale=2)


@query(
    f"""SELECT l_returnflag || '|' || CAST(l_partkey AS VARCHAR) AS group_key, {PRICE_SUM} AS total
    FROM lineitem GROUP BY group_key"""
)
def concat_key(spark, sf_dir):
    keyed = lineitem(spark, sf_dir).withColumn("group_key", scalars.concat_key("l_returnflag", "l_partkey"))
    return agg.group_sum(keyed, "group_key", "l_extendedprice", scale=2)


@query("SELECT o_orderkey, o_orderkey % 10 AS remainder FROM orders")
def modulo(spark, sf_dir):
    return named_table(spark, sf_dir, "orders").select("o_orderkey", scalars.modulo("o_orderkey", 10).alias("remainder"))


@query("SELECT l_orderkey, ['A', 'B', 'C', 'D', 'E', 'F', 'G'][l_linenumber] AS letter FROM lineitem")
def array_element(spark, sf_dir):
    return lineitem(spark, sf_dir).select("l_orderkey", scalars.pick(list("ABCDEFG"), "l_linenumber").alias("letter"))
