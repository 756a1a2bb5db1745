"""Queries on text columns, plain and dictionary-encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkcols.operators import aggregates as agg, columns as cols, dictionary, ordering as order, storage
from sparkcols.plans.registry import query
from sparkcols.sources import generators
from sparkcols.sources.tables import named_table

BRANDS = ["Brand#1", "Brand#2", "Brand#3", "Brand#4", "Brand#99"]  # the last one is in no row
EVENT_NAMES = "[" + ", ".join(f"'{name}'" for name in generators.vocabulary(10)) + "]"


def part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named_table(spark, sf_dir, "part")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named_table(spark, sf_dir, "events")


@query("SELECT count(*) AS n FROM events WHERE event_type = 'click'")
def count_eq(spark, sf_dir):
    return cols.count_eq(events(spark, sf_dir), "event_type", "click")


@query(f"SELECT count(*) AS n FROM part WHERE p_brand IN ({', '.join(repr(b) for b in BRANDS)})")
def count_in(spark, sf_dir):
    return cols.count_in(part(spark, sf_dir), "p_brand", BRANDS)


@query("SELECT count(*) AS n FROM part WHERE p_name LIKE '%_bolt'")
def count_like(spark, sf_dir):
    return cols.count_like(part(spark, sf_dir), "p_name", "%_bolt")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def group_count_text(spark, sf_dir):
    return agg.group_count(events(spark, sf_dir), "event_type")


@query("SELECT DISTINCT p_brand FROM part")
def distinct_values(spark, sf_dir):
    return agg.distinct_values(part(spark, sf_dir), "p_brand")


@query("SELECT p_name FROM part ORDER BY p_name LIMIT 100")
def top_asc(spark, sf_dir):
    return order.top_asc(part(spark, sf_dir), "p_name", 100)


@query("SELECT event_id, CAST(dense_rank() OVER (ORDER BY event_type) AS INTEGER) AS code FROM events")
def dict_encode(spark, sf_dir):
    codes, _ = dictionary.dict_encode(events(spark, sf_dir).select("event_id", "event_type"), "event_type")
    return codes


@query("SELECT CAST(dense_rank() OVER (ORDER BY p_name) AS INTEGER) AS code, p_name FROM (SELECT DISTINCT p_name FROM part)")
def dict_entries(spark, sf_dir):
    return dictionary.build_dictionary(part(spark, sf_dir), "p_name")


@query("SELECT p_partkey, p_name FROM part")
def dict_decode(spark, sf_dir):
    return dictionary.dict_decode(*dictionary.dict_encode(part(spark, sf_dir).select("p_partkey", "p_name"), "p_name"))


@query(
    """SELECT p_partkey, code FROM (SELECT p_partkey, p_name,
    CAST(dense_rank() OVER (ORDER BY p_name) AS INTEGER) AS code FROM part) WHERE p_name LIKE '%_bolt'"""
)
def dict_filter(spark, sf_dir):
    codes, entries = dictionary.dict_encode(part(spark, sf_dir).select("p_partkey", "p_name"), "p_name")
    return dictionary.dict_filter(codes, entries, F.col("p_name").like("%_bolt"))


@query("SELECT count(*) AS n FROM part WHERE p_name LIKE '%_bolt'")
def dict_filter_count(spark, sf_dir):
    return agg.row_count(dict_filter(spark, sf_dir))


@query("SELECT p_name, count(*) AS n FROM part GROUP BY p_name")
def dict_group_count(spark, sf_dir):
    return dictionary.dict_group_count(*dictionary.dict_encode(part(spark, sf_dir).select("p_name"), "p_name"))


@query(
    """SELECT sum(strlen(p_name))::BIGINT AS plain, count(*) * 4 AS codes,
    (SELECT sum(strlen(p_name))::BIGINT FROM (SELECT DISTINCT p_name FROM part)) AS dict FROM part"""
)
def encoding_report(spark, sf_dir):
    return storage.encoding_report(part(spark, sf_dir), "p_name")


@query(
    """SELECT sum(strlen(text))::BIGINT AS plain, count(text) * 4 AS codes,
    (SELECT sum(strlen(text))::BIGINT FROM (SELECT DISTINCT text FROM documents)) AS dict FROM documents"""
)
def encoding_report_texts(spark, sf_dir):
    """The other extreme: long texts with almost no repeats, where codes gain little."""
    return storage.encoding_report(spark.read.schema("doc_id long, text string").parquet(f"{sf_dir}/documents.parquet"), "text")


@query(f"SELECT event_id AS id, ({EVENT_NAMES})[event_id % 10 + 1] AS event_type FROM events")
def gen_events(spark, sf_dir):
    return generators.event_columns(events(spark, sf_dir), "event_id", 10).select("id", "event_type")


@query(
    f"""SELECT count(*) AS n FROM (SELECT ({EVENT_NAMES})[event_id % 10 + 1] AS event_type FROM events)
    WHERE event_type LIKE '%_click'"""
)
def gen_events_like(spark, sf_dir):
    return cols.count_like(generators.event_columns(events(spark, sf_dir), "event_id", 10), "event_type", "%_click")


@query("SELECT count(*) AS n, CAST(1 AS BIGINT) AS stamps FROM events")
def stamp_now(spark, sf_dir):
    """The insert time is one value for the whole query."""
    stamped = generators.event_columns(events(spark, sf_dir), "event_id", 10)
    return stamped.agg(F.count("*").alias("n"), F.count_distinct("created_at").alias("stamps"))
