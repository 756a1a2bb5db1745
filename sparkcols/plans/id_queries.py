"""ID generation and queries by key, for integer, UUID and text keys."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkcols import schemas
from sparkcols.functions import scalars
from sparkcols.operators import aggregates as agg, columns as cols, ids, joins, ordering as order
from sparkcols.plans.registry import query
from sparkcols.session import new_table_path, path_exists, staged
from sparkcols.sources import layout
from sparkcols.sources.tables import named_table

UUID_SQL = """SELECT h[1:8] || '-' || h[9:12] || '-7' || r[1:3] || '-8' || r[4:6] || '-' || r[7:18] AS id, event_id
    FROM (SELECT event_id, lpad(lower(hex(epoch_us(ts) // 1000)), 12, '0') AS h, md5(event_id::VARCHAR) AS r
    FROM events)"""
U64_SQL = "('0x' || substr(md5(event_id::VARCHAR), 1, 16))::UBIGINT::DECIMAL(20,0)"


def _timed_sql(machine: str, tick: str, bits: int) -> str:
    return f"""WITH e AS (SELECT event_id, {machine} AS m, {tick} AS tick FROM events),
        p AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY tick, event_id) - 1 AS rn FROM e),
        s AS (SELECT *, rn + max(tick * {2**bits} - rn) OVER (PARTITION BY m ORDER BY tick, event_id
        ROWS UNBOUNDED PRECEDING) AS slot FROM p)
        SELECT event_id, ((slot >> {bits}) << {bits + 10}) | (m << {bits}) | (slot & {2**bits - 1}) AS sid FROM s"""


TIMED_SQL = _timed_sql("user_id % 1024", "epoch_us(ts) // 1000", 12)
TABLE_SQL = {
    "long": f"SELECT sid AS id, event_id FROM ({TIMED_SQL})",
    "uuid": UUID_SQL,
    "text": UUID_SQL,
}
#: folders of the stored tables, by application, input and kind of key
_STORED: dict[tuple[str, str, str], str] = {}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named_table(spark, sf_dir, "events")


def keyed(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """The events under an ID of one kind: a time-ordered 64-bit number, a UUID of 16 bytes, or its text."""
    rows = events(spark, sf_dir)
    if kind == "long":
        made = ids.timed_id(rows.select("event_id", "ts", "user_id"), "ts", F.col("user_id"), "event_id")
        return made.select(F.col("sid").alias("id"), "event_id")
    key = scalars.uuid_bytes("ts", "event_id") if kind == "uuid" else scalars.uuid_v7("ts", "event_id")
    return rows.select(key.alias("id"), "event_id")


def stored(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """The same, stored once per application in the order of the ID, so that lookups skip row groups."""
    place = (spark.sparkContext.applicationId, sf_dir, kind)
    if place not in _STORED or not path_exists(spark, _STORED[place]):
        path = new_table_path(spark, f"keyed_{kind}")
        layout.sorted_layout(keyed(spark, sf_dir, kind), ["id"], path)
        _STORED[place] = path
    return spark.read.schema(schemas.STORED_KEYS[kind]).parquet(_STORED[place])


def shown(kind: str, df: DataFrame) -> DataFrame:
    """UUIDs as text, for people to read."""
    return df.withColumn("id", scalars.uuid_text("id")) if kind == "uuid" else df


def anchors(spark: SparkSession, sf_dir: str, kind: str) -> list:
    """Five neighbouring IDs from the middle: the literals the lookups are run with."""
    found = [r["id"] for r in ids.anchor_keys(stored(spark, sf_dir, kind), "id").collect()]
    return sorted(bytes(x) for x in found) if kind == "uuid" else sorted(found)


def point_lookup(kind, spark, sf_dir):
    return shown(kind, cols.point_lookup(stored(spark, sf_dir, kind), "id", anchors(spark, sf_dir, kind)[0]))


def range_count(kind, spark, sf_dir):
    found = anchors(spark, sf_dir, kind)
    return cols.range_count(stored(spark, sf_dir, kind), "id", found[0], found[-1])


def multi_lookup(kind, spark, sf_dir):
    return shown(kind, cols.multi_lookup(stored(spark, sf_dir, kind), "id", anchors(spark, sf_dir, kind)))


def top_desc(kind, spark, sf_dir):
    return shown(kind, order.top_desc(stored(spark, sf_dir, kind), "id", 100))


def page(kind, spark, sf_dir):
    """A hundred keys from the middle on."""
    return shown(kind, order.page(stored(spark, sf_dir, kind), "id", limit=100))


def page_at(kind, spark, sf_dir):
    return shown(kind, order.page(stored(spark, sf_dir, kind), "id", limit=100, offset=5000))


def anchor_keys(kind, spark, sf_dir):
    return shown(kind, ids.anchor_keys(stored(spark, sf_dir, kind), "id"))


def sample_keys(kind, spark, sf_dir):
    rows = shown(kind, stored(spark, sf_dir, kind))
    return ids.sample_keys(rows, "id", rows.count() // 100)


def join_count(kind, spark, sf_dir):
    lookup = sample_keys(kind, spark, sf_dir)
    if kind == "uuid":
        lookup = lookup.select(F.unhex(F.translate("id", "-", "")).alias("id"))
    found = joins.join_count(stored(spark, sf_dir, kind), staged(lookup, "lookup"), "id", "id")
    return found.select(F.col("n").cast("long").alias("n"))


for _kind, _table in TABLE_SQL.items():
    _anchor = "SELECT id FROM t ORDER BY id LIMIT 5 OFFSET (SELECT count(*) // 2 FROM t)"
    _sample = "SELECT id FROM t ORDER BY md5(id::VARCHAR), id LIMIT (SELECT count(*) // 100 FROM t)"
    _ends = f"(SELECT min(id) FROM ({_anchor})) AND id {{}} (SELECT max(id) FROM ({_anchor}))"
    _bodies = {
        point_lookup: f"SELECT * FROM t WHERE id = (SELECT min(id) FROM ({_anchor}))",
        range_count: f"SELECT count(*) AS n FROM t WHERE id > {_ends.format('<')}",
        multi_lookup: f"SELECT * FROM t WHERE id IN ({_anchor})",
        top_desc: "SELECT id FROM t ORDER BY id DESC LIMIT 100",
        page: "SELECT id FROM t ORDER BY id LIMIT 100 OFFSET (SELECT count(*) // 2 FROM t)",
        page_at: "SELECT id FROM t ORDER BY id LIMIT 100 OFFSET 5000",
        anchor_keys: _anchor,
        sample_keys: _sample,
        join_count: f"SELECT count(*) AS n FROM t a JOIN ({_sample}) b ON a.id = b.id",
    }
    for _function, _body in _bodies.items():
        query(f"WITH t AS ({_table}) {_body}", f"{_function.__name__}_{_kind}")(partial(_function, _kind))


@query("SELECT count(*) AS n FROM lineitem a JOIN orders b ON a.l_orderkey = b.o_orderkey")
def join_count_tables(spark, sf_dir):
    fact, lookup = named_table(spark, sf_dir, "lineitem"), named_table(spark, sf_dir, "orders")
    return joins.join_count(fact, lookup, "l_orderkey", "o_orderkey").select(F.col("n").cast("long").alias("n"))


@query("SELECT count(*) AS n FROM lineitem a JOIN orders b ON a.l_orderkey = b.o_orderkey")
def join_count_large(spark, sf_dir):
    """The same count as for a lookup beyond the broadcast bound."""
    fact, lookup = named_table(spark, sf_dir, "lineitem"), named_table(spark, sf_dir, "orders")
    return joins.join_count(fact, lookup, "l_orderkey", "o_orderkey", limit=0).select(F.col("n").cast("long").alias("n"))


@query(TIMED_SQL)
def timed_id(spark, sf_dir):
    return ids.timed_id(events(spark, sf_dir).select("event_id", "ts", "user_id"), "ts", F.col("user_id"),
                            "event_id").select("event_id", "sid")


@query(_timed_sql("user_id % 4", "epoch_us(ts) // 86400000000", 6))
def timed_id_overflow(spark, sf_dir):
    """Four machines and 64 slots a day: full days run over into the next ones."""
    day = F.floor(scalars.epoch_millis("ts") / 86_400_000)
    rows = events(spark, sf_dir).select("event_id", "ts", "user_id")
    return ids.timed_id(rows, "ts", F.col("user_id") % 4, "event_id", seq_bits=6, tick=day).select("event_id", "sid")


@query(UUID_SQL)
def uuid_v7(spark, sf_dir):
    return events(spark, sf_dir).select(scalars.uuid_v7("ts", "event_id").alias("id"), "event_id")


@query("SELECT CAST(event_id AS VARCHAR) AS id FROM events")
def id_text(spark, sf_dir):
    return events(spark, sf_dir).select(scalars.id_text("event_id").alias("id"))


@query(f"SELECT event_id, {U64_SQL} AS value FROM events")
def rand_u64(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", scalars.rand_u64("event_id").alias("value"))


@query(f"SELECT value, count(*) AS n FROM (SELECT {U64_SQL} AS value FROM events) GROUP BY value")
def group_near_unique(spark, sf_dir):
    rows = events(spark, sf_dir).select(scalars.rand_u64("event_id").alias("value"))
    return agg.group_count(rows, "value")


@query("SELECT * FROM events WHERE event_id = 5000 AND event_type <> 'none'")
def bound_lookup(spark, sf_dir):
    text = "SELECT * FROM {rows} WHERE event_id = :id AND event_type <> :skipped"
    return ids.bound_query(spark, text, {"rows": events(spark, sf_dir)}, id=5000, skipped="none")
