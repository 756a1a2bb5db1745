"""Declared table schemas; nothing is inferred from values."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


U64 = T.DecimalType(20, 0)  # an unsigned 64-bit value does not fit a long

SALES = _schema(
    ("id", T.LongType()),
    ("category", T.StringType()),
    ("subcategory", T.StringType()),
    ("amount", T.DoubleType()),
    ("quantity", T.LongType()),
)

TYPED_EVENTS = _schema(
    ("id", T.LongType()),
    ("event_type", T.StringType()),
    ("created_at", T.TimestampType()),
)

KEYED_VALUES = {
    "long": _schema(("id", T.LongType()), ("value", U64)),
    "uuid": _schema(("id", T.StringType()), ("value", U64)),
    "text": _schema(("id", T.StringType()), ("value", U64)),
}

MEASUREMENTS = _schema(
    ("op", T.StringType()),
    ("variant", T.StringType()),
    ("run", T.LongType()),
    ("seconds", T.DoubleType()),
    ("bytes", T.LongType()),
)

LINEITEM = _schema(
    ("l_orderkey", T.LongType()),
    ("l_partkey", T.LongType()),
    ("l_suppkey", T.LongType()),
    ("l_linenumber", T.IntegerType()),
    ("l_quantity", T.DoubleType()),
    ("l_extendedprice", T.DoubleType()),
    ("l_discount", T.DoubleType()),
    ("l_tax", T.DoubleType()),
    ("l_returnflag", T.StringType()),
    ("l_linestatus", T.StringType()),
    ("l_shipdate", T.TimestampNTZType()),
)

ORDERS = _schema(
    ("o_orderkey", T.LongType()),
    ("o_custkey", T.LongType()),
    ("o_orderstatus", T.StringType()),
    ("o_totalprice", T.DoubleType()),
    ("o_orderdate", T.TimestampNTZType()),
    ("o_orderpriority", T.StringType()),
)

EVENTS = _schema(
    ("event_id", T.LongType()),
    ("ts", T.TimestampNTZType()),
    ("user_id", T.LongType()),
    ("event_type", T.StringType()),
    ("value", T.DoubleType()),
    ("props", T.StringType()),
)

PART = _schema(
    ("p_partkey", T.LongType()),
    ("p_name", T.StringType()),
    ("p_brand", T.StringType()),
    ("p_type", T.StringType()),
    ("p_size", T.IntegerType()),
    ("p_retailprice", T.DoubleType()),
)

#: events under a generated ID: a 64-bit number, a UUID of 16 bytes, or a UUID's text
STORED_KEYS = {
    kind: _schema(("id", type_), ("event_id", T.LongType()))
    for kind, type_ in (("long", T.LongType()), ("uuid", T.BinaryType()), ("text", T.StringType()))
}

BRANDS = _schema(
    ("brand", T.StringType()), ("parts", T.LongType()), ("smallest", T.LongType()), ("largest", T.LongType())
)
