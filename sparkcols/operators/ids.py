"""Time-ordered IDs, key samples and anchor keys."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sparkcols.functions.scalars import digest, epoch_millis
from sparkcols.operators.ordering import free_of, page, part_offsets, with_position

# Bit widths of a 64-bit time-ordered ID (41-bit milliseconds on top).
MACHINE_BITS = 10
SEQUENCE_BITS = 12

#: hexadecimal digits of a digest, and how many of them a histogram takes
DIGEST_DIGITS, RADIX = 32, 3


def timed_id(
    df: DataFrame,
    ts: str,
    machine: Column,
    tie: str,
    seq_bits: int = SEQUENCE_BITS,
    tick: Column | None = None,
    alias: str = "sid",
) -> DataFrame:
    """Adds a unique 64-bit ID ordered by time within each machine.

    Every machine has ``2^seq_bits`` slots per millisecond. A row takes the
    first slot of its millisecond or the one after its predecessor's, whichever
    is later, so a full millisecond runs over into the next. With ``g`` the
    row's position in (machine, time, tie) order, that slot is
    ``g + max(first slot - g)`` over the machine's rows so far: a running
    maximum. It is taken inside the range partitions of the sort and then over
    one summary row per partition and machine, so no task holds a whole
    machine, however many rows it has.

    A row without time or machine has no ID. A time that doesn't fit the bits
    left for it (before 1970, or from 2109 on with 12 sequence bits) stops the
    job instead of giving an ID out of order; columns named like the operator's
    own are refused.
    """
    free_of(df, "_machine", "_tick", "_part", "_place", "_before", "_carry", "_lead", "_slot", alias)
    base = df.withColumns({
        "_machine": F.pmod(machine, F.lit(2**MACHINE_BITS)).cast("long"),
        "_tick": (epoch_millis(ts) if tick is None else tick).cast("long"),
    })
    placed = with_position(base, ["_machine", "_tick", tie])

    first_slot = F.col("_tick") * F.lit(2**seq_bits)
    # one row per range partition and machine: at most partitions + machines rows
    summary = placed.groupBy("_part", "_machine").agg(F.max(first_slot - F.col("_place")).alias("_lead"))
    earlier = Window.partitionBy("_machine").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets, parts = part_offsets(placed)
    carry = summary.join(F.broadcast(offsets), "_part").select(
        "_part", "_machine", "_before", F.max(F.col("_lead") - F.col("_before")).over(earlier).alias("_carry")
    )

    # one task per range partition: these are even in size, hashed pairs of part and machine are not
    spread = placed.repartitionById(parts, F.col("_part"))
    rows = spread.join(
        F.broadcast(carry),
        (spread["_part"] == carry["_part"]) & spread["_machine"].eqNullSafe(carry["_machine"]),
    ).select(spread["*"], carry["_before"], carry["_carry"])
    g = F.col("_before") + F.col("_place")
    so_far = Window.partitionBy("_part", "_machine").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_slot", g + F.greatest(F.max(first_slot - g).over(so_far), F.col("_carry")))
    slot = F.col("_slot")
    tick_bits = 63 - MACHINE_BITS - seq_bits
    fits = (F.col("_tick") >= 0) & (F.shiftright(slot, seq_bits) < F.lit(2**tick_bits))
    sid = (
        F.shiftleft(F.shiftright(slot, seq_bits), MACHINE_BITS + seq_bits)
        .bitwiseOR(F.shiftleft(F.col("_machine"), seq_bits))
        .bitwiseOR(slot.bitwiseAND(F.lit(2**seq_bits - 1)))
    )
    known = F.col("_tick").isNotNull() & F.col("_machine").isNotNull()
    beyond = F.raise_error(F.concat(F.lit("no ID for the time "), F.col("_tick").cast("string"))).cast("long")
    return rows.withColumn(alias, F.when(known & fits, sid).when(known, beyond)).select(*df.columns, alias)


def digest_cut(keys: DataFrame, mark: Column, k: int) -> tuple[str, int]:
    """The least leading digits of the k-th digest that part it from the next, and how many digests up to
    there are taken too much (equal keys at the cut).

    A histogram of the digests' leading digits names the bucket that holds the
    k-th one, the next histogram refines that bucket, until the cut falls
    between two buckets. Each is one aggregate with at most 16^RADIX rows,
    whatever the number of keys.
    """
    cut, wanted = "", k
    while True:
        digits = len(cut) + RADIX
        inside = keys.where(F.substring(mark, 1, len(cut)) == cut) if cut else keys
        counts = inside.groupBy(F.substring(mark, 1, digits).alias("head")).agg(F.count("*").alias("n"))
        for head, n in sorted((r["head"], r["n"]) for r in counts.collect()):
            if n >= wanted:
                break
            wanted -= n
        cut = head
        if n == wanted or digits >= DIGEST_DIGITS:
            return cut, n - wanted


def sample_keys(df: DataFrame, key: str, k: int, salt: str = "") -> DataFrame:
    """``k`` keys in the order of a salted digest: random, yet equal on every run.

    The exact k-th digest is selected first (see ``digest_cut``); the sample is
    then a filter on the digest, in as many partitions as the table has, and
    put in order by ranges. Rows without a key are not drawn; a repeated key can
    be drawn as often as it occurs.
    """
    keys = df.select(key).where(F.col(key).isNotNull())
    mark = digest(key, salt)
    if k <= 0:
        return keys.limit(0)
    if keys.count() <= k:
        return keys.orderBy(mark, key)
    cut, excess = digest_cut(keys, mark, k)
    head = F.substring(mark, 1, len(cut))
    drawn = keys.where(head <= cut)
    if excess:  # the cut falls into a run of one key: all its rows are alike
        drawn = keys.where(head < cut)
        at_cut = keys.where(head == cut)
        value = at_cut.first()[0]
        rest = keys.sparkSession.range(at_cut.count() - excess).select(F.lit(value).cast(df.schema[key].dataType).alias(key))
        drawn = drawn.unionByName(rest)
    return drawn.orderBy(mark, key)


def anchor_keys(df: DataFrame, key: str, n: int = 5, offset: int | None = None) -> DataFrame:
    """``n`` neighbouring keys, from the middle of the table unless told otherwise."""
    return page(df, key, n, offset)


def bound_query(spark: SparkSession, text: str, tables: dict[str, DataFrame], **values: Any) -> DataFrame:
    """SQL with named parameters; values are bound by type and never spliced into the text."""
    return spark.sql(text, args=values, **tables)
