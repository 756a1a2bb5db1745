"""Document fingerprints: bottom-k sketches of word shingles.

A sketch is the k smallest 64-bit hashes of a text's distinct shingles, written
as 16 hexadecimal digits each, in ascending order. The sketch of a union is the
bottom k of the parts' sketches, so sketches merge in any order. From two of
them follow estimates of resemblance and containment, from one the number of
distinct shingles; below k shingles all three are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkcols.llm.shipping import map_arrow
from sparkcols.llm.textarrays import pieces, shingle_sets, text_buffer
from sparkcols.session import parts_for

#: hashes in a sketch: an estimate's standard error is at most 1 / (2 * sqrt(SIZE)), 0.044; words in a shingle
SIZE, WIDTH = 128, 5
#: hash classes in which the rows of a group are cut down apart before they meet in one task
CLASSES = 64
DIGITS = 16


def sketches(texts: list[str], size: int = SIZE, width: int = WIDTH) -> list[np.ndarray]:
    """The sketch of each text; texts without a word have an empty one."""
    return [hashes[:size] for hashes in shingle_sets(pa.array(texts, pa.string()), width)]


def written(sketch: np.ndarray) -> str:
    return sketch.astype(">u8").tobytes().hex()


def read(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)


def merged(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The sketch of the union of what two sketches stand for."""
    return np.union1d(a, b)[:size]


def shingle_count(a: np.ndarray, size: int = SIZE) -> float:
    """Distinct shingles behind a sketch: exact below ``size``, else by the density of its hashes."""
    return float(len(a)) if len(a) < size else (size - 1) * 2.0**64 / (float(a[-1]) + 1)


def resemblance(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimated Jaccard similarity; 1 for two empty sketches, 0 for one."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    first = np.empty(len(both), bool)
    first[0], first[1:] = True, both[1:] != both[:-1]
    distinct = np.flatnonzero(first)[:size]
    # a hash of both sketches stands twice
    end = distinct[-1] + 1 + (distinct[-1] + 1 < len(both) and not first[distinct[-1] + 1])
    return (end - len(distinct)) / len(distinct)


def containment(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimated share of a's shingles that are in b; 1 if a is empty."""
    if not len(a):
        return 1.0
    j = resemblance(a, b, size)
    shared = j / (1 + j) * (shingle_count(a, size) + shingle_count(b, size))
    return min(1.0, shared / shingle_count(a, size))


def merge_by(df: DataFrame, *groups: str, fingerprint: str = "fingerprint", size: int = SIZE) -> DataFrame:
    """One fingerprint for each group of rows, of all their shingles together.

    A group may hold any share of the rows: its hashes are cut to the bottom
    ``size`` in classes first, and by every task before the shuffle. Null
    fingerprints count as empty; a group with empty ones only has an empty one.
    """
    known = df.select(*groups).distinct()
    value = F.explode(F.regexp_extract_all(F.col(fingerprint), F.lit(f".{{{DIGITS}}}"), F.lit(0)))
    rows = df.select(*groups, value.alias("_hash")).distinct()
    rows = rows.withColumn("_class", F.pmod(F.xxhash64("_hash"), F.lit(CLASSES)))
    for keys in ([*groups, "_class"], list(groups)):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_hash"))
        rows = rows.withColumn("_rank", rank).where(F.col("_rank") <= size)
    found = rows.groupBy(*groups).agg(F.array_join(F.array_sort(F.collect_list("_hash")), "").alias(fingerprint))
    same = None
    for g in groups:
        test = F.col(f"k.{g}").eqNullSafe(F.col(f"f.{g}"))
        same = test if same is None else same & test
    joined = known.alias("k").join(found.alias("f"), same, "left")
    return joined.select(*(F.col(f"k.{g}").alias(g) for g in groups), F.coalesce(f"f.{fingerprint}", F.lit("")).alias(fingerprint))


def fingerprint(df: DataFrame, text: str = "text", key: str = "doc_id", size: int = SIZE, width: int = WIDTH) -> DataFrame:
    """Key, ``fingerprint`` and ``n_shingles`` (estimated) of every row; null text counts as empty.

    Rows are read one by one: repeated rows give repeated results, other columns
    are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hashes[:size] for hashes in shingle_sets(batch.column(1), width)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([written(x) for x in found], pa.string()),
                    pa.array([shingle_count(x, size) for x in found], pa.float64()),
                ],
                ["k", "fingerprint", "n_shingles"],
            )

    kind = df.schema[key].dataType.simpleString()
    done = map_arrow(df.select(F.col(key), F.col(text)), run, f"k {kind}, fingerprint string, n_shingles double")
    return done.withColumnRenamed("k", key)


def edited_text(text: str, following: str) -> str:
    """``text`` with its last floor(n / 2) characters replaced by the first as many (or all) of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def heads_of(df: DataFrame, key: Column, parts: int) -> list[int]:
    """The greatest keys of about ``parts`` even ranges, descending: values of the table, one for each range."""
    shares = [i / parts for i in range(1, parts)]
    row = df.select(key.alias("k")).agg(
        F.max("k"), *([F.percentile_approx("k", shares, max(10_000, 20 * parts))] if shares else [])
    ).first()
    return [] if row[0] is None else sorted({row[0], *(row[1] or [] if shares else [])}, reverse=True)


def neighbours(df: DataFrame, text: str = "text", key: str = "doc_id", size: int = SIZE, width: int = WIDTH) -> DataFrame:
    """The fingerprint of every text, of the text edited with its follower's, and their likeness.

    Rows follow each other by descending key (a whole number), null last, equal
    keys by a hash of the text; after the last row comes the first. The rows are
    dealt once, into ranges of keys that begin at a key of the table: the rows
    with that key also go to the range before, whose last row they follow. Each
    range is sorted by Spark and read as a stream, so a task holds one piece of it.

    One row per row of ``df``: key, ``n_chars``, ``edited_sha256``,
    ``fingerprint``, ``edited_fingerprint``, ``near_edited`` and ``near_next``.
    A row that is alone follows itself. Null texts count as empty; repeated rows
    follow each other; other columns are not looked at. An empty table gives no
    rows. All rows of one key, and all without one, are read by one task.
    """
    docs = df.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    heads = heads_of(df, F.col(key).cast("long"), parts_for(df.select(key, text)))
    ranges = max(1, len(heads))
    ascending = np.array(heads[::-1], np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            null = column.is_null().to_numpy(zero_copy_only=False)
            keys = column.fill_null(0).to_numpy(zero_copy_only=False)
            above = np.searchsorted(ascending, keys, "left")  # heads below the key
            part = np.where(null, ranges - 1, ranges - 1 - above) if len(ascending) else np.zeros(len(keys), np.int64)
            # the first row of a range also follows the last one of the range before; the very first one that of the last
            if len(ascending):
                head = ~null & (ascending[np.minimum(above, ranges - 1)] == keys)
            else:
                head = np.ones(len(keys), bool)
            own, more = np.arange(len(keys)), np.flatnonzero(head)
            yield batch_of(batch, own, part, 0)
            if len(more):
                yield batch_of(batch, more, (part[more] - 1) % ranges, 1)

    def batch_of(batch: pa.RecordBatch, rows: np.ndarray, part: np.ndarray, extra: int) -> pa.RecordBatch:
        chosen = batch if extra == 0 else batch.take(pa.array(rows))
        return pa.RecordBatch.from_arrays(
            [pa.array(part.astype(np.int32)), pa.array(np.full(len(rows), extra, np.int8)), *chosen.columns],
            ["part", "extra", "k", "t"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # key, text and sketch of the row whose follower is still to come
        for batch in batches:
            _, offsets = text_buffer(batch.column(3))
            for a, b in pieces(offsets):
                part = batch.slice(a, b - a)
                extra = part.column(1).to_numpy(zero_copy_only=False)
                last = np.flatnonzero(extra)
                many = int(last[0]) + 1 if len(last) else len(extra)  # of the rows to follow, only the first counts
                keys = part.column(2).slice(0, many).to_pylist()
                texts = part.column(3).slice(0, many).to_pylist()
                rows = [*([held] if held else []), *zip(keys, texts, sketches(texts, size, width))]
                if len(rows) > 1:
                    yield told(rows)
                if len(last):
                    return
                held = rows[-1]

    def told(rows: list[tuple]) -> pa.RecordBatch:
        edited = [edited_text(x[1], y[1]) for x, y in zip(rows, rows[1:])]
        others = sketches(edited, size, width)
        own = rows[:-1]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([x[0] for x in own], pa.int64()),
                pa.array([len(x[1]) for x in own], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                pa.array([written(x[2]) for x in own], pa.string()),
                pa.array([written(x) for x in others], pa.string()),
                pa.array([resemblance(x[2], y, size) for x, y in zip(own, others)], pa.float64()),
                pa.array([resemblance(x[2], y[2], size) for x, y in zip(own, rows[1:])], pa.float64()),
            ],
            ["k", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    dealt = map_arrow(docs, deal, "part int, extra tinyint, k long, t string").repartitionById(ranges, F.col("part"))
    ordered = dealt.sortWithinPartitions("extra", F.desc_nulls_last("k"), F.xxhash64("t"), "t")
    done = map_arrow(
        ordered,
        run,
        "k long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )
    return done.withColumnRenamed("k", key)
