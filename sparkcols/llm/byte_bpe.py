"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's parts form a linked list of byte positions. Each neighbouring
pair that is a token waits in the bucket of its merge rank; a bitmap in three
levels marks the ranks with waiting pairs, and find-first-set gives the next.
Entries whose pair has changed meanwhile are stale and skipped, so that n bytes
cost about n log n steps however long the pre-token is.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcols.llm.shipping import map_arrow
from sparkcols.llm.textarrays import pieces, ragged, text_buffer

#: pre-tokens of up to so many characters are remembered, at most so many of them in a worker
SHORT, REMEMBERED = 48, 1 << 19


class RankQueue:
    """Positions by merge rank, lowest rank first and leftmost position first within a rank.

    ``low`` has a bit for each rank with waiting positions, ``mid`` one for each
    word of ``low`` that isn't 0, and the top word one for each word of ``mid``.
    Find-first-set on each level gives the next rank; a word's lowest bit is
    cleared when a bucket runs empty. A queue is empty again after a pre-token,
    so a worker needs one for a vocabulary.
    """

    __slots__ = ("buckets", "low", "mid")

    def __init__(self, ranks: int) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)


def merge(piece: bytes, ranks: dict[bytes, int], queue: RankQueue) -> list[int]:
    """Token ids of one pre-token. What puts into the queue and takes from it stands in the loops: a call would cost more."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n, top = len(piece), 0
    find, buckets, low, mid = ranks.get, queue.buckets, queue.low, queue.mid
    after, before = list(range(1, n + 2)), list(range(-1, n))
    # rank of the pair that starts at each position, as it stands
    pair: list[int | None] = [find(piece[at : at + 2]) for at in range(n - 1)]
    pair.append(None)
    for at, rank in enumerate(pair):
        if rank is None:
            continue
        if rank in buckets:
            buckets[rank].append(at)  # positions ascend
            continue
        buckets[rank] = [at]
        a = rank >> 6
        if not low[a]:
            mid[a >> 6] |= 1 << (a & 63)
            top |= 1 << (a >> 6)
        low[a] |= 1 << (rank & 63)
    while top:
        b = (top & -top).bit_length() - 1
        m = mid[b]
        a = b << 6 | (m & -m).bit_length() - 1
        word = low[a]
        rank = a << 6 | (word & -word).bit_length() - 1
        bucket = buckets[rank]
        if len(bucket) > 1:
            at = heappop(bucket)
        else:
            at = bucket[0]
            del buckets[rank]
            low[a] = word = word & (word - 1)
            if not word:
                mid[b] = m = m & (m - 1)
                if not m:
                    top &= top - 1
        if pair[at] != rank:
            continue
        gone = after[at]
        pair[gone] = None
        after[at] = middle = after[gone]
        left = before[at]
        if middle < n:
            before[middle] = at
            pair[at] = rank = find(piece[at : after[middle]])
        else:
            pair[at] = rank = None
        while True:
            if rank is not None:
                if rank in buckets:
                    heappush(buckets[rank], at)
                else:
                    buckets[rank] = [at]
                    a = rank >> 6
                    if not low[a]:
                        mid[a >> 6] |= 1 << (a & 63)
                        top |= 1 << (a >> 6)
                    low[a] |= 1 << (rank & 63)
            if left < 0:
                break
            at, left = left, -1
            pair[at] = rank = find(piece[at:middle])
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : after[at]]])
        at = after[at]
    return ids


@lru_cache(maxsize=4)
def vocabulary(ranks_file: bytes) -> tuple[dict[bytes, int], np.ndarray, np.ndarray, np.ndarray]:
    """Ranks by token, and for decoding all tokens' bytes, with start and length by id."""
    ranks = {base64.b64decode(t): int(i) for t, i in map(bytes.split, ranks_file.splitlines()) if t}
    size = max(ranks.values()) + 1
    lengths = np.zeros(size, np.int64)
    tokens = [b""] * size
    for token, i in ranks.items():
        tokens[i], lengths[i] = token, len(token)
    return ranks, np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(lengths) - lengths, lengths


@lru_cache(maxsize=4)
def remembered(ranks_file: bytes) -> tuple[dict[str, bytes], RankQueue]:
    """Ids of short pre-tokens met so far and the queue, kept while the worker lives."""
    return {}, RankQueue(len(vocabulary(ranks_file)[3]))


def encode_texts(texts: list[str], find, ranks: dict[bytes, int], known: dict[str, bytes], queue: RankQueue) -> list[np.ndarray]:
    """Token ids of each text, each match of the pattern on its own; a pre-token is merged once for all texts."""
    cut = [find(text) for text in texts]
    fresh = {}
    for pieces_of in cut:
        for piece in set(pieces_of):
            if piece not in known and piece not in fresh:
                fresh[piece] = array("i", merge(piece.encode(), ranks, queue)).tobytes()
    room = REMEMBERED - len(known)
    short = [p for p in fresh if len(p) <= SHORT]
    known.update((p, fresh.pop(p)) for p in short[: max(0, room)])
    out = []
    for pieces_of in cut:
        parts = list(map(known.get, pieces_of))
        if fresh and None in parts:
            parts = [fresh[p] if x is None else x for p, x in zip(pieces_of, parts)]
        out.append(np.frombuffer(b"".join(parts), np.int32))
    return out


def list_array(values: list[np.ndarray], kind: type) -> pa.Array:
    """Lists of ids, or binary values, from one array each."""
    offsets = np.zeros(len(values) + 1, np.int64 if kind is np.uint8 else np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.zeros(0, kind)
    if kind is np.uint8:
        return pa.Array.from_buffers(pa.large_binary(), len(values), [None, pa.py_buffer(offsets), pa.py_buffer(flat)]).cast(
            pa.binary()
        )
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Key and ``ids`` of every row; null text counts as empty and has no ids.

    ``path`` is read on the driver (a vocabulary has a fixed size) and
    broadcast. Rows are encoded one by one: repeated rows give repeated results,
    other columns are not looked at. Batches are cut by bytes of text.
    """
    with open(path, "rb") as file:
        held = df.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = vocabulary(held.value)[0]
        find, (known, queue) = regex.compile(pattern).findall, remembered(held.value)
        for batch in batches:
            _, offsets = text_buffer(batch.column(1))
            for a, b in pieces(offsets):
                part = batch.slice(a, b - a)
                ids = encode_texts([t or "" for t in part.column(1).to_pylist()], find, ranks, known, queue)
                yield pa.RecordBatch.from_arrays([part.column(0), list_array(ids, np.int32)], ["k", "ids"])

    kind = df.schema[key].dataType.simpleString()
    return map_arrow(df.select(F.col(key), F.col(text)), run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes of its token ids; null ids decode to no bytes, unknown ids stop the job."""
    with open(path, "rb") as file:
        held = df.sparkSession.sparkContext.broadcast(file.read())
    at = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, blob, starts, lengths = vocabulary(held.value)
        for batch in batches:
            column = batch.column(at).fill_null([]) if batch.column(at).null_count else batch.column(at)
            flat = column.flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            for a, b in pieces(ends, 1 << 19):
                own = flat[ends[a] : ends[b]]
                size = lengths[own]
                edges = np.concatenate([[0], np.cumsum(size)])[ends[a : b + 1] - ends[a]]
                data = blob[ragged(starts[own], size)]
                values = [data[i:j] for i, j in zip(edges[:-1], edges[1:])]
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(a, b - a).columns, list_array(values, np.uint8)], [*batch.schema.names, out]
                )

    if out in df.columns:
        raise ValueError(f"input has a column {out}")
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return map_arrow(df, run, f"{schema}, `{out}` binary")


def digest(coded: DataFrame, key: str = "doc_id") -> DataFrame:
    """The registered query's columns."""
    return coded.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
