"""Equi-joins of a large table with a lookup table.

A side is broadcast only after its rows and bytes have been measured. Beyond
the bound, counts are joined after both sides are reduced to one row per key,
and row-returning lookups deal the rows of hot keys over several tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sparkcols.operators.ordering import free_of
from sparkcols.operators.storage import has_logical_size, table_size
from sparkcols.session import staged

BROADCAST_BYTES = 64 * 1024**2
ROW_OVERHEAD = 32
#: rows of one key that a task may take, and over how many salts rows without a key are dealt
HOT_ROWS = 1_000_000
KEYLESS = 1 << 20


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """True when the measured size of ``df`` is within ``limit`` bytes.

    One aggregate over the columns that would be sent. A table with nested
    columns is never taken for small.
    """
    if not has_logical_size(df):
        return False
    size = table_size(df).first()
    return (size["bytes"] or 0) + size["rows"] * ROW_OVERHEAD <= limit


def join_count(fact: DataFrame, lookup: DataFrame, fact_key: str, lookup_key: str,
               limit: int = BROADCAST_BYTES) -> DataFrame:
    """Number of row pairs with equal keys, as DECIMAL(38,0): products of row counts can leave the long range.

    The lookup is first reduced to its row count per key, which is written, so
    that it's read once and a key repeated on both sides is never expanded into
    its pairs. Within ``limit`` those counts are broadcast and the fact rows are
    not shuffled. Beyond it the facts are counted per key too, and a hot key
    crosses the network as one row per task.
    """
    facts = fact.select(F.col(fact_key).alias("key")).where("key IS NOT NULL")
    keys = lookup.select(F.col(lookup_key).alias("key")).where("key IS NOT NULL")
    whole = "decimal(38,0)"
    right = staged(keys.groupBy("key").agg(F.count("*").alias("right_rows")), "key_counts")
    if fits_broadcast(right, limit):
        # a partial sum is at most a task's rows times the lookup's rows: it needs the wide type too
        pairs = facts.join(F.broadcast(right), "key").agg(F.sum(F.col("right_rows").cast("decimal(28,0)")).alias("n"))
    else:
        left = facts.groupBy("key").agg(F.count("*").alias("left_rows"))
        product = F.col("left_rows").cast("decimal(19,0)") * F.col("right_rows").cast("decimal(19,0)")
        pairs = left.join(right, "key").agg(F.sum(product.cast("decimal(38,0)")).alias("n"))
    return pairs.select(F.coalesce("n", F.lit(0)).cast(whole).alias("n"))


def key_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of ``rows`` with their number of rows, ``_rows``; only the keys are read."""
    return rows.select(*keys).dropna().groupBy(*keys).agg(F.count("*").alias("_rows"))


def _pieces(counts: DataFrame, keys: list[str], hot_rows: int) -> DataFrame:
    """(``_mark``, ``_pieces``): hashes of the keys with more than ``hot_rows`` rows, and into how many pieces they go.

    There is at most one entry for each ``hot_rows`` rows of the input, and an
    entry has 16 bytes however long the key is. Keys with one hash share it.
    """
    hot = counts.where(F.col("_rows") > hot_rows)
    return hot.groupBy(F.xxhash64(*keys).alias("_mark")).agg(F.max(F.ceil(F.col("_rows") / hot_rows)).cast("int").alias("_pieces"))


def salted_join(rows: DataFrame, lookup: DataFrame, keys: list[str], how: str, counts: DataFrame | None = None,
                hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join with one row per key where both sides are shuffled and no task gets more than about ``hot_rows`` rows of a key.

    Rows of a hot key are dealt over pieces by a hash of the row and of the
    partition they lie in, and only that key's lookup row is repeated, once per
    piece. Rows without a key are dealt out evenly. Keys are hot by exact counts
    (``counts``, or counted here); each side is scanned once.
    """
    hot = F.broadcast(_pieces(key_counts(rows, keys) if counts is None else counts, keys, hot_rows))
    mark = F.xxhash64(*keys)
    # equal on every run of a task: neither part depends on the order of rows
    spread = F.xxhash64(*rows.columns, F.spark_partition_id())
    no_key = F.lit(False)
    for k in keys:
        no_key = no_key | F.col(k).isNull()
    left = rows.withColumns({"_mark": mark, "_spread": spread}).join(hot, "_mark", "left")
    salt = F.when(no_key, F.col("_spread") % KEYLESS).otherwise(F.pmod("_spread", F.coalesce("_pieces", F.lit(1))))
    left = left.withColumn("_salt", salt.cast("int")).drop("_mark", "_pieces", "_spread")
    right = lookup.withColumn("_mark", mark).join(hot, "_mark", "left")
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1)))
    return left.join(right.drop("_mark", "_pieces"), [*keys, "_salt"], how).drop("_salt")


def lookup_join(rows: DataFrame, lookup: DataFrame, key: str | list[str], how: str = "left",
                limit: int = BROADCAST_BYTES, small: bool | None = None, counts: DataFrame | None = None,
                hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join rows with a table that has one row per key (``left``, ``inner`` or ``left_semi``).

    ``small`` states the outcome of a size check that was already made. A lookup
    beyond ``limit`` is joined by ``salted_join``, with ``counts`` of the rows
    per key if they are known. Columns named like that join's own are refused.
    """
    keys = [key] if isinstance(key, str) else key
    if fits_broadcast(lookup, limit) if small is None else small:
        return rows.join(F.broadcast(lookup), keys, how)
    free_of(rows, "_mark", "_pieces", "_salt", "_spread")
    return salted_join(rows, lookup, keys, how, counts, hot_rows)
