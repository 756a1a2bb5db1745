"""Words, shingles and hashes of whole Arrow batches of text as numpy arrays.

Texts stay in the batch's own byte buffer. A word is hashed as a polynomial of
its bytes modulo 2**64, read off a running sum, so that a batch costs a few
vector operations for each byte and nothing for each word in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: bytes of text that are turned into arrays at a time
PIECE = 1 << 19

_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS["up"]) < n:
        size = max(n, PIECE + 1)
        for name, base in (("up", BASE), ("down", INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if pa.types.is_string(column.type) else column
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes together, at least one text each."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z, all else as it is."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and number of the text of every run without ASCII white space."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    inside = ~blank
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True  # where a text begins or the last one ends
    before = np.empty(len(data), bool)
    before[:1], before[1:] = True, blank[:-1]
    after = np.empty(len(data), bool)
    after[-1:], after[:-1] = True, blank[1:]
    starts = np.flatnonzero(inside & (before | first[:-1]))
    ends = np.flatnonzero(inside & (after | first[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans of one buffer; equal bytes hash alike wherever they stand."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def joined(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for every n consecutive values: their order counts."""
    out = hashes[: len(hashes) - n + 1].copy()
    for i in range(1, n):
        out = mix(out * np.uint64(BASE) + hashes[i : len(hashes) - n + 1 + i])
    return out


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles.

    Letters A-Z are lower-cased. Fewer than n words make one shingle of all of
    them; no word makes none.
    """
    data, offsets = text_buffer(column)
    for a, b in pieces(offsets):
        part, at = lower_ascii(data[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a]
        starts, ends, text = word_spans(part, at)
        words = span_hashes(part, starts, ends)
        bounds = np.searchsorted(text, np.arange(b - a + 1))
        runs = joined(words, n) if len(words) >= n else np.zeros(0, np.uint64)
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if j - i >= n:
                yield np.unique(runs[i : j - n + 1])
            elif j > i:
                yield mix(joined(words[i:j], j - i) + np.uint64(j - i))
            else:
                yield np.zeros(0, np.uint64)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes start, start + 1, ... of every range, one after the other."""
    ends = np.cumsum(lengths)
    shift = np.repeat(starts - (ends - lengths), lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int64) + shift
