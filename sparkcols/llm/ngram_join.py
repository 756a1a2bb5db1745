"""N-gram Jaccard join with adaptive prefixes over blocks of shingles.

The range of hashes is cut into m equal blocks, by a number that depends on the
set's size class alone. Sets of the wanted similarity differ in k items at most,
k following from their sizes, so in k blocks at most: they share one of the
first k + 1 blocks in any order of blocks that is the same for both. Blocks with
many items come first. Unlike sets rarely share a whole block, whatever shingles
are frequent, so that the candidates grow with the near copies only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcols.llm.grouping import WORDS, linked, parities, sample_bound
from sparkcols.llm.shipping import map_arrow
from sparkcols.llm.textarrays import mix, pieces, shingle_sets, text_buffer
from sparkcols.session import staged

#: blocks beyond those that can differ, in percent: the weakest ones, with few items or none, then aren't taken
SPARE = 10


def list_of(values: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def digests(docs: DataFrame, width: int) -> DataFrame:
    """``id``, size of the set and two 64-bit digests of it for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, one, two = [], [], []
            for tokens in shingle_sets(batch.column(1), width):
                sizes.append(len(tokens))
                one.append(int(mix(tokens).sum(dtype=np.uint64).view(np.int64)))
                two.append(int(mix(tokens ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64())],
                ["id", "size", "one", "two"],
            )

    return map_arrow(docs, run, "id long, size long, one long, two long")


def most_apart(size: int, percent: int) -> int:
    """In how many items, counted in both, sets of this similarity can differ if the sizes add up to ``size``."""
    return (100 - percent) * size // (100 + percent)


def block_keys(tokens: np.ndarray, percent: int) -> np.ndarray:
    """The keys of the prefix of a set's blocks, for each size class in which it can meet a similar set.

    A class holds the sizes from a power of two to the next. Two similar sets
    meet in the class of the larger one. Equal keys are equal blocks, but for
    collisions of 56 bits, which cost a comparison; their order is that of the
    prefix, whose length follows from the set's own size.
    """
    size = len(tokens)
    largest = 100 * size // percent
    taken = most_apart(size + largest, percent) + 1
    own = size.bit_length()
    total = np.zeros(size + 1, np.uint64)
    np.cumsum(mix(tokens), out=total[1:])
    found = []
    for level in (own, own + 1) if largest >> own else (own,):
        blocks = -(-(100 + SPARE) * (most_apart(2 * ((1 << level) - 1), percent) + 1) // 100)
        at = ((tokens >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
        held = np.bincount(at, minlength=blocks)
        ends = np.cumsum(held)
        place = (np.arange(blocks, dtype=np.uint64) << np.uint64(8)) + np.uint64(level)
        own_hash = mix(mix(place) ^ (total[ends] - total[ends - held])) >> np.uint64(8)
        few_last = (255 - np.minimum(held, 255)).astype(np.uint64) << np.uint64(56)
        found.append(np.sort(few_last | own_hash)[:taken])
    return np.concatenate(found)


def postings(docs: DataFrame, heads: DataFrame, width: int, percent: int) -> DataFrame:
    """(key, id, size, need): one row for each block of the prefix of the documents with these ids.

    A document's prefix is one row until the ids are known to be wanted: that
    moves a small part of its shingles instead of its text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes = [], []
            for tokens in shingle_sets(batch.column(1), width):
                keys.append(block_keys(tokens, percent) if len(tokens) else tokens)
                sizes.append(len(tokens))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), list_of(keys)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "size", "keys"])

    rows = map_arrow(docs, run, "id long, size long, keys array<long>").join(heads, "id", "left_semi")
    return rows.select(F.explode("keys").alias("key"), "id", "size", F.lit(1).alias("need"))


def sets(docs: DataFrame, ids: DataFrame, parts: int, width: int, percent: int) -> DataFrame:
    """(id, size, part, items): the whole sets of these ids and samples of them, dealt by id."""
    bound = np.uint64(sample_bound(percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = text_buffer(batch.column(1))
            for a, b in pieces(offsets):
                found = list(shingle_sets(batch.column(1).slice(a, b - a), width))
                samples = [x[: np.searchsorted(x, bound)] for x in found]
                columns = [batch.column(0).slice(a, b - a), pa.array([len(x) for x in found], pa.int64()), list_of(samples), list_of(found)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "size", "part", "items"])

    # few documents have a candidate: only their texts are dealt by id, so that the buckets need no further exchange
    wanted = docs.join(ids, "id", "left_semi").repartition(parts, "id")
    return map_arrow(wanted, run, "id long, size long, part array<long>, items array<long>")


def set_parities(sets: DataFrame) -> DataFrame:
    """(id, parity): the parities of stored sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, n = batch.column(1), len(batch)
            rows = np.repeat(np.arange(n), items.value_lengths().to_numpy(zero_copy_only=False))
            words = parities(rows, items.flatten().to_numpy().view(np.uint64), n).ravel()
            parity = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * WORDS), pa.array(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), parity], ["id", "parity"])

    return map_arrow(sets.select("id", "items"), run, "id long, parity array<long>")


def components(df: DataFrame, width: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``df``: the key, ``n_shingles`` and ``component_id``, the smallest key that links lead to.

    Documents with equal sets are one class and are compared once. Null and
    empty texts, and texts without words, have an empty set and stay alone.
    Rows with the same key count as one item of the first class that they are
    in; rows without a key stay alone with a null component. Other columns are
    not looked at.
    """
    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    seen = staged(digests(docs, width), "digests")
    real = seen.where("id is not null and size > 0")
    classes = staged(real.groupBy("one", "two", "size").agg(F.min("id").alias("first")), "classes")
    heads = classes.select(F.col("first").alias("id")).distinct()
    roots = linked(
        postings(docs, heads, width, percent),
        lambda ids, parts: sets(docs, ids, parts, width, percent),
        percent,
        parity_of=set_parities,
    )
    named = classes.join(roots.withColumnRenamed("id", "first"), "first", "left").select(
        "one", "two", "size", F.coalesce("root", "first").alias("root")
    )
    return seen.join(named, ["one", "two", "size"], "left").select(
        F.col("id").alias(key), F.col("size").alias("n_shingles"), F.coalesce("root", "id").alias("component_id")
    )


def one_of_each(df: DataFrame, width: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``df`` whose key is the smallest of their group, with the columns of ``df``; rows without a key stay."""
    lost = components(df, width, percent, text, key).where(F.col("component_id") < F.col(key)).select(key).distinct()
    return df.join(lost, key, "left_anti").select(*df.columns)
