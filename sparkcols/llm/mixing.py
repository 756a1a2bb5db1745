"""Mixing sources to target weights: proportionate-fair (Pfair) schedule of source blocks.

Each stream (a named source, or all others together, who may take turns) owns ``units`` slots in
every period of ``sum(units)`` slots. Its block number k may run from slot
``floor(k * period / units)`` on and has to run before slot
``ceil((k + 1) * period / units)``. Earliest deadline first meets every window,
so that after any number of slots a stream is less than one block away from its
share. The schedule repeats every period: only one period of it is worked out,
from the weights alone.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkcols.operators.ordering import with_row_number
from sparkcols.session import staged

#: stream name of all sources without a weight of their own, and of null
OTHERS = "(others)"
#: target weights of the registered query, in slots per period
WEIGHTS = {"src0": 12, "src1": 9, "src2": 8, "src3": 5, "src4": 4, "src5": 2, OTHERS: 60}
#: characters of text in one block
BLOCK_CHARS = 65536


def period_slots(weights: dict[str, int]) -> dict[str, list[int]]:
    """For each stream the slots of its blocks 0 .. units - 1 within one period."""
    period = sum(weights.values())
    window = lambda s, k: (-(-(k + 1) * period // weights[s]), s, k)
    waiting = [(0, window(s, 0)) for s in sorted(weights) if weights[s] > 0]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    slots: dict[str, list[int]] = {s: [] for s in weights}
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            heapq.heappush(ready, heapq.heappop(waiting)[1])
        _, name, k = heapq.heappop(ready)
        slots[name].append(slot)
        if k + 1 < weights[name]:
            heapq.heappush(waiting, ((k + 1) * period // weights[name], window(name, k + 1)))
    return slots


def slot_of(stream: Column, block: Column, weights: dict[str, int]) -> Column:
    """The slot of a block: its place in the period plus whole periods."""
    period, found = sum(weights.values()), None
    for name, slots in period_slots(weights).items():
        if not slots:
            continue
        units = len(slots)
        places = F.array(*(F.lit(s) for s in slots))
        slot = F.floor(block / units) * period + F.get(places, (block % units).cast("int"))
        test = stream == name
        found = F.when(test, slot) if found is None else found.when(test, slot)
    return found.cast("long")


def own_stream(source: Column) -> Column:
    """A stream name for every source: ``(null)`` for null; sources that look like it get further brackets."""
    source = source.cast("string")
    bracketed = F.when(source.rlike(r"^\(+null\)+$"), F.concat(F.lit("("), source, F.lit(")"))).otherwise(source)
    return F.coalesce(bracketed, F.lit("(null)"))


def schedule(
    df: DataFrame,
    weights: dict[str, int] = WEIGHTS,
    block_chars: int = BLOCK_CHARS,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    each: bool = False,
) -> DataFrame:
    """``df`` with ``mix_stream``, ``mix_mark``, ``mix_block`` and ``mix_slot``; sort by slot, mark and key to read it.

    Within a stream rows follow the digest of their key; a row lies in the
    block in which its first character falls. A running length over a whole
    stream would end in one task, so lengths are summed by leading digits of
    the digest first and the running sum inside such a bucket starts there.

    No row is dropped: when a stream ends, its slots stay empty. Null or unknown
    sources belong to ``OTHERS``; null and empty texts have length 0; repeated
    rows follow each other. Input columns named like the four are refused.

    With ``each`` there is no common stream: every source of the input without
    a weight, and null, has a stream of its own with an equal share of that of
    ``OTHERS``. They take turns in its slots: block k of the j-th of n is its
    block k * n + j, which is earliest deadline first for equal weights and keeps
    each of them less than one block away from its own share of all slots. Any
    number of sources will do; none reaches the driver. Without such sources
    the slots of ``OTHERS`` are left out of the period.
    """
    clash = {"mix_stream", "mix_mark", "mix_block", "mix_slot", "mix_bucket", "mix_base", "mix_turn"} & set(df.columns)
    if clash:
        raise ValueError(f"input has the columns {sorted(clash)}")
    if any(u < 0 for u in weights.values()) or weights.get(OTHERS, 0) < 1:
        raise ValueError(f"weights are whole numbers, and {OTHERS!r} needs one of at least 1")
    named = [s for s in weights if s != OTHERS and weights[s] > 0]
    stream = F.when(F.col(source).isin(*named), F.col(source)).otherwise(F.lit(OTHERS))
    if each:
        stream = own_stream(F.col(source))
    length = F.length(F.coalesce(F.col(text), F.lit(""))).cast("long")
    mark = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    marked = df.withColumns(
        {
            "mix_stream": stream,
            "mix_mark": mark,
            "mix_bucket": F.substring(mark, 1, 3),
        }
    )
    # one row for each stream and bucket: at most 4096 for a stream
    sums = marked.groupBy("mix_stream", "mix_bucket").agg(F.sum(length).alias("mix_sum"))
    upto = Window.partitionBy("mix_stream").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(
        "mix_stream", "mix_bucket", F.coalesce(F.sum("mix_sum").over(upto), F.lit(0)).alias("mix_base")
    )
    alone = F.col("mix_stream").isin(*named)
    if each:
        rest = staged(df.select(stream.alias("mix_stream")).where(~alone).distinct(), "sources")
        many = rest.count()
        rest = with_row_number(rest, ["mix_stream"], "mix_turn")
        weights = weights if many or not named else {s: weights[s] for s in named}
        turns = rest.withColumn("mix_turn", F.col("mix_turn") - 1)
        bases = bases.join(turns, "mix_stream", "left")
    inside = (
        Window.partitionBy("mix_stream", "mix_bucket")
        .orderBy("mix_mark", F.col(key), length)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.coalesce(F.sum(length).over(inside), F.lit(0))
    blocks = (
        marked.withColumn("mix_block", before)
        .join(bases, ["mix_stream", "mix_bucket"])
        .withColumn("mix_block", F.floor((F.col("mix_base") + F.col("mix_block")) / block_chars).cast("long"))
    )
    slot = slot_of(F.col("mix_stream"), F.col("mix_block"), weights)
    if each:
        turn = F.col("mix_block") * many + F.col("mix_turn")
        slot = F.when(alone, slot) if not many else F.when(alone, slot).otherwise(slot_of(F.lit(OTHERS), turn, weights))
    blocks = blocks.withColumn("mix_slot", slot.cast("long"))
    return blocks.select(*(df[c] for c in df.columns), "mix_stream", "mix_mark", "mix_block", "mix_slot")


def mixed(df: DataFrame, weights: dict[str, int] = WEIGHTS, block_chars: int = BLOCK_CHARS, **columns: str) -> DataFrame:
    """The rows of ``df`` in the order of the schedule, with the columns of ``df``."""
    key = columns.get("key", "doc_id")
    return schedule(df, weights, block_chars, **columns).orderBy("mix_slot", "mix_mark", key).select(*df.columns)


def slot_cases(weights: dict[str, int], stream: str, block: str) -> str:
    """SQL for the slot of a block."""
    period = sum(weights.values())
    cases = " ".join(
        f"WHEN '{s}' THEN (({block}) // {len(x)}) * {period} + ({list(x)})[(({block}) % {len(x)})::INT + 1]"
        for s, x in period_slots(weights).items() if x
    )
    return f"(CASE {stream} {cases} END)::BIGINT"


def schedule_sql(
    weights: dict[str, int] = WEIGHTS, block_chars: int = BLOCK_CHARS, table: str = "documents", each: bool = False
) -> str:
    """SQL twin of the registered queries."""
    own = [s for s in weights if s != OTHERS and weights[s] > 0]
    named = ", ".join(f"'{s}'" for s in own)
    stream = f"CASE WHEN source IN ({named}) THEN source ELSE '{OTHERS}' END"
    slot, rest, last = slot_cases(weights, "mix_stream", "mix_block"), "", "blocks"
    if each:
        stream = r"""CASE WHEN source IS NULL THEN '(null)'
             WHEN regexp_full_match(source, '\(+null\)+') THEN '(' || source || ')' ELSE source END"""
        rest = f""",
    rest AS (
      SELECT mix_stream, row_number() OVER (ORDER BY mix_stream) - 1 AS turn, count(*) OVER () AS many
      FROM (SELECT DISTINCT mix_stream FROM marked WHERE mix_stream NOT IN ({named})))"""
        last = "blocks LEFT JOIN rest USING (mix_stream)"
        alone = slot_cases({s: weights[s] for s in own}, "mix_stream", "mix_block")
        others = slot_cases(weights, f"'{OTHERS}'", "mix_block * many + turn")
        slot = f"""CASE WHEN many IS NOT NULL THEN {others}
             WHEN EXISTS (SELECT 1 FROM rest) THEN {slot} ELSE {alone} END"""
    return f"""
    WITH marked AS (
      SELECT doc_id, {stream} AS mix_stream,
             md5(coalesce(doc_id::VARCHAR, '')) AS mark, length(coalesce(text, '')) AS n
      FROM {table}),
    blocks AS (
      SELECT doc_id, mix_stream, (coalesce(sum(n) OVER (PARTITION BY mix_stream ORDER BY mark, doc_id, n
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {block_chars})::BIGINT AS mix_block
      FROM marked){rest}
    SELECT doc_id, mix_stream, mix_block, {slot} AS mix_slot FROM {last}"""
