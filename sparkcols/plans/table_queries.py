"""Ingest, generators, table writes, layouts, statistics and storage footprint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkcols import schemas
from sparkcols.functions import scalars
from sparkcols.operators import aggregates as agg, columns as cols, storage
from sparkcols.plans.column_queries import PRICE_SUM, PRICE_THRESHOLD, lineitem
from sparkcols.plans.id_queries import U64_SQL, UUID_SQL
from sparkcols.plans.registry import query
from sparkcols.session import new_table, new_table_path
from sparkcols.sources import generators, layout, sinks
from sparkcols.sources.tables import conform, from_arrow, named_table

STATS_COLUMNS = ["l_orderkey", "l_quantity", "l_extendedprice", "l_returnflag"]
SEED_SQL = "('0x' || substr(md5('42:{0}:' || CAST(o_orderkey AS VARCHAR)), 1, 15))::BIGINT"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named_table(spark, sf_dir, "events")


def typed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        F.col("event_id").alias("id"), "event_type", F.col("ts").cast("timestamp").alias("created_at")
    )


def released(spark: SparkSession, name: str) -> DataFrame:
    """The rows of a table whose name is given back; its files stay where they are."""
    rows = spark.table(name)
    sinks.drop_table(spark, name)
    return rows


@query(
    """SELECT l_orderkey AS id, l_returnflag AS category, CAST(l_partkey AS VARCHAR) AS subcategory,
    l_extendedprice AS amount, CAST(l_quantity AS BIGINT) AS quantity FROM lineitem"""
)
def ingest(spark, sf_dir):
    rows = lineitem(spark, sf_dir).select(
        F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("category"),
        F.col("l_partkey").alias("subcategory"), F.col("l_extendedprice").alias("amount"),
        F.col("l_quantity").alias("quantity"),
    )
    name, path = new_table(spark, "sales")
    sinks.materialize(conform(rows, schemas.SALES), name, path)
    return released(spark, name)


@query(
    """SELECT p_brand AS brand, count(*) AS parts, min(p_size)::BIGINT AS smallest, max(p_size)::BIGINT AS largest
    FROM part GROUP BY p_brand"""
)
def ingest_arrow(spark, sf_dir):
    """In-memory columns of driver size: here one row for each brand, fetched as an Arrow table and stored typed."""
    parts = named_table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand"))
    columns = parts.agg(F.count("*").alias("parts"), F.min("p_size").alias("smallest"), F.max("p_size").alias("largest")).toArrow()
    name, path = new_table(spark, "brands")
    sinks.materialize(from_arrow(spark, columns, schemas.BRANDS), name, path)
    return released(spark, name)


@query(
    f"""SELECT o_orderkey AS id, 'cat_' || ({SEED_SQL.format('category')} % 10) AS category,
    'sub_' || ({SEED_SQL.format('subcategory')} % 1000) AS subcategory,
    ({SEED_SQL.format('amount')} % 100000) / 100 AS amount,
    {SEED_SQL.format('quantity')} % 100 + 1 AS quantity FROM orders"""
)
def gen_uniform(spark, sf_dir):
    return generators.uniform_columns(named_table(spark, sf_dir, "orders"), "o_orderkey")


@query("SELECT unnest(range((SELECT count(*) FROM orders))) AS id")
def number_sequence(spark, sf_dir):
    return generators.number_sequence(spark, named_table(spark, sf_dir, "orders").count())


@query("SELECT * FROM lineitem WHERE l_extendedprice > 50000")
def materialize(spark, sf_dir):
    rows = cols.filter_gt(lineitem(spark, sf_dir), "l_extendedprice", PRICE_THRESHOLD)
    name, path = new_table(spark, "filtered")
    sinks.materialize(rows, name, path)
    return released(spark, name)


@query(
    """SELECT event_id AS id, event_type FROM events
    UNION ALL SELECT event_id + 1000000000000 AS id, upper(event_type) AS event_type FROM events"""
)
def append(spark, sf_dir):
    name, path = new_table(spark, "appended")
    sinks.create_table(spark, name, schemas.TYPED_EVENTS, path)
    rows = typed_events(spark, sf_dir)
    sinks.append(rows, name)
    sinks.append(
        rows.withColumns({"id": F.col("id") + 1_000_000_000_000, "event_type": F.upper("event_type")}), name
    )
    return released(spark, name).select("id", "event_type")


@query("SELECT event_id AS id, event_type FROM events")
def create_table(spark, sf_dir):
    """A table created, dropped and created again holds just the rows inserted last."""
    name, path = new_table(spark, "created")
    sinks.create_table(spark, name, schemas.KEYED_VALUES["long"], path)
    sinks.drop_table(spark, name)
    sinks.create_table(spark, name, schemas.TYPED_EVENTS, new_table_path(spark, "created"))
    sinks.append(typed_events(spark, sf_dir), name)
    return released(spark, name).select("id", "event_type")


@query(f"SELECT u.id, {U64_SQL.replace('event_id', 'u.event_id')} AS value FROM ({UUID_SQL}) u")
def with_defaults(spark, sf_dir):
    """Rows that bring a value only; the ID column is filled by its default."""
    name, path = new_table(spark, "defaults")
    sinks.create_table(spark, name, schemas.KEYED_VALUES["uuid"], path)
    rows = events(spark, sf_dir).withColumn("value", scalars.rand_u64("event_id"))
    sinks.append(sinks.with_defaults(rows, {"id": scalars.uuid_v7("ts", "event_id")}), name)
    return released(spark, name)


@query("SELECT event_id, ts, user_id, event_type, value FROM events")
def sorted_layout(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "ts", "user_id", "event_type", "value")
    return layout.sorted_layout(rows, ["event_id"], new_table_path(spark, "sorted"))


@query(f"SELECT l_returnflag, l_partkey, {PRICE_SUM} AS total FROM lineitem GROUP BY l_returnflag, l_partkey")
def covering_projection(spark, sf_dir):
    narrow = layout.covering_projection(
        lineitem(spark, sf_dir), ["l_returnflag", "l_partkey"], ["l_extendedprice"], new_table_path(spark, "covering")
    )
    return agg.group_sum(narrow, ["l_returnflag", "l_partkey"], "l_extendedprice", scale=2)


@query(f"SELECT l_partkey, {PRICE_SUM} AS total FROM lineitem GROUP BY l_partkey")
def bucketed_projection(spark, sf_dir):
    name, path = new_table(spark, "bucketed")
    layout.bucketed_projection(
        spark, lineitem(spark, sf_dir), ["l_partkey"], ["l_extendedprice"], name, path, buckets=8
    )
    return agg.group_sum(released(spark, name), "l_partkey", "l_extendedprice", scale=2)


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS nulls,
        CAST(min({c}) AS VARCHAR) AS minimum, CAST(max({c}) AS VARCHAR) AS maximum,
        count(DISTINCT {c}) AS distinct_values FROM lineitem"""
        for c in STATS_COLUMNS
    )
)
def column_stats(spark, sf_dir):
    return layout.column_stats(lineitem(spark, sf_dir), STATS_COLUMNS, exact=True)


@query(
    """SELECT unnest(['event_id', 'event_type', 'value']) AS "column",
    unnest([count(event_id) * 8, sum(strlen(event_type))::BIGINT, count(value) * 8]) AS bytes FROM events"""
)
def logical_bytes(spark, sf_dir):
    return storage.logical_bytes(events(spark, sf_dir).select("event_id", "event_type", "value"))


TEXT_COLUMNS = {"events": "event_type", "part": "p_name", "orders": "o_orderpriority"}


def text_tables(spark: SparkSession, sf_dir: str) -> dict[str, tuple[str, DataFrame]]:
    """A text column of each table, stored as uncompressed lines: their size is that of the text and a line end each."""
    out = {}
    for name, column in TEXT_COLUMNS.items():
        path, rows = new_table_path(spark, f"lines_{name}"), named_table(spark, sf_dir, name).select(column)
        rows.write.option("compression", "none").text(path)
        out[name] = (path, rows)
    return out


@query(" UNION ALL ".join(f"""SELECT '{t}' AS "table", sum(strlen({c}) + 1)::BIGINT AS bytes FROM {t}""" for t, c in TEXT_COLUMNS.items()))
def stored_bytes(spark, sf_dir):
    folders = {name: folder for name, (folder, _) in text_tables(spark, sf_dir).items()}
    return storage.stored_bytes(spark, folders).select("table", "bytes")


@query(
    " UNION ALL ".join(
        f"""SELECT '{t}' AS "table", count(*) AS rows, sum(strlen({c}) + 1)::BIGINT AS stored,
        sum(strlen({c}))::BIGINT AS logical, sum(strlen({c}))::DOUBLE / sum(strlen({c}) + 1)::DOUBLE AS gain FROM {t}"""
        for t, c in TEXT_COLUMNS.items()
    )
)
def table_report(spark, sf_dir):
    report = storage.table_report(spark, text_tables(spark, sf_dir))
    return report.select("table", "rows", "stored", "logical", "gain")


@query()
def stored_bytes_parquet(spark, sf_dir):
    """Compressed columnar files, whose size SQL can't know."""
    names = ["lineitem", "orders", "events", "part"]
    return storage.stored_bytes(spark, {name: f"{sf_dir}/{name}.parquet" for name in names})
