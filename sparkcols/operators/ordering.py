"""Sorts, top-k, pages and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from sparkcols.session import parts_for, staged


def sort_desc(df: DataFrame, column: str, *ties: str) -> DataFrame:
    """All columns, ``column`` descending. Ties break on ``ties``, which also lets
    the range exchange split a run of equal values over several tasks."""
    return df.orderBy(F.desc(column), *ties)


def ordered_view(df: DataFrame, order: str) -> DataFrame:
    """A lazy ordered view from SQL text such as ``"amount DESC, id"``."""
    return df.sparkSession.sql(f"SELECT * FROM {{rows}} ORDER BY {order}", rows=df)


def top_asc(df: DataFrame, column: str, k: int) -> DataFrame:
    return df.select(column).orderBy(column).limit(k)


def top_desc(df: DataFrame, column: str, k: int) -> DataFrame:
    return df.select(column).orderBy(F.desc(column)).limit(k)


def page(df: DataFrame, key: str, limit: int, offset: int | None = None) -> DataFrame:
    """``limit`` keys in ascending order after skipping ``offset``, by default half of them.

    Keys are unique IDs; rows without one are not counted. The keys alone are
    sorted by range, whose row counts tell in which partitions and at which
    places the page begins and ends. So offset + limit rows never meet in one
    task, however deep the page lies; only its own rows are put in order last.
    """
    placed = with_position(df.select(key).where(F.col(key).isNotNull()), [key])
    counts = part_counts(placed)
    total = sum(n for _, n in counts)
    offset = total // 2 if offset is None else offset
    end = min(offset + limit, total)
    if offset >= end:
        return placed.select(key).limit(0)
    at = F.struct("_part", "_place")
    bounds = (place_of(counts, rank) for rank in (offset, end - 1))
    first, last = (F.struct(F.lit(part).cast("int"), F.lit(place).cast("long")) for part, place in bounds)
    return placed.where((at >= first) & (at <= last)).select(key).orderBy(key)


def by_range(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """Rows in ranges of ``order``, as many as the files behind ``df`` ask for.

    Adaptive execution merges small ranges but can't cut a large one, so beyond
    the session's number of shuffle partitions the exchange states its own.
    """
    parts = parts_for(df)
    if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df.repartitionByRange(parts, *order)
    return df.repartitionByRange(*order)


def free_of(df: DataFrame, *names: str) -> None:
    """An error if the input has a column of an operator's own name."""
    clash = {n.lower() for n in names} & {c.lower() for c in df.columns}
    if clash:
        raise ValueError(f"input has the columns {sorted(clash)}")


def with_position(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """Rows range-partitioned and sorted by ``order`` with their partition and place.

    Adds ``_part`` (partition number, ascending with the order) and ``_place``
    (0-based row number inside it). ``order`` ends in a unique key, so equal
    leading values spread over partitions. The result is written to the shared
    folder, because the ranges could differ in a second evaluation. Input
    columns of these names are refused.
    """
    free_of(df, "_part", "_place", "_mark")
    ranged = by_range(df, order).sortWithinPartitions(*order)
    marked = ranged.withColumn("_mark", F.monotonically_increasing_id())
    placed = marked.withColumns({
        "_part": F.shiftright("_mark", 33).cast("int"),
        "_place": F.col("_mark").bitwiseAND(F.lit(2**33 - 1)),
    }).drop("_mark")
    return staged(placed, "ranged")


def part_counts(placed: DataFrame) -> list[tuple[int, int]]:
    """(partition, rows) in ascending order: one entry per partition."""
    counts = placed.groupBy("_part").agg(F.count("*").alias("n")).collect()
    return sorted((r["_part"], r["n"]) for r in counts)


def place_of(counts: list[tuple[int, int]], rank: int) -> tuple[int, int]:
    """Partition and place of the row with a 0-based rank."""
    for part, n in counts:
        if rank < n:
            return part, rank
        rank -= n
    raise IndexError("rank beyond the last row")


def part_offsets(placed: DataFrame) -> tuple[DataFrame, int]:
    """Number of rows before each partition, ``_before``, one row per partition; and the
    number of partitions."""
    counts = part_counts(placed)
    offsets, before = [], 0
    for part, n in counts:
        offsets.append((part, before))
        before += n
    schema = T.StructType([T.StructField("_part", T.IntegerType()), T.StructField("_before", T.LongType())])
    parts = counts[-1][0] + 1 if counts else 1
    return placed.sparkSession.createDataFrame(offsets, schema), parts


def with_row_number(df: DataFrame, order: list[Column | str], alias: str = "rn") -> DataFrame:
    """1-based position in the total order, without a single-task window.

    One range exchange sorts the rows; the row counts of its partitions, a
    table as long as there are partitions, give the offset of each.
    """
    placed = with_position(df, order)
    offsets, _ = part_offsets(placed)
    numbered = placed.join(F.broadcast(offsets), "_part")
    return numbered.withColumn(alias, F.col("_before") + F.col("_place") + 1).select(*df.columns, alias)
