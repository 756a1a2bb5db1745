"""Line dedup: fuzzy lines by MinHash of character shingles, one line kept of each component."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcols.llm.grouping import WORDS, linked, parities
from sparkcols.llm.ngram_join import list_of
from sparkcols.llm.shipping import map_arrow
from sparkcols.llm.textarrays import lower_ascii, mix, pieces, powers, ragged, text_buffer
from sparkcols.session import staged

#: characters (bytes) of a shingle; bands and rows of a band: a similarity of 0.8 is found in 99.7 of 100 cases
SHINGLE, BANDS, ROWS = 8, 8, 3
#: bytes of text that are turned into arrays at a time: these then stay in a core's cache
PIECE = 1 << 17
#: places that shingles mark when two lines are compared, a power of two, and rows that are marked at a time
MARKS, ROWS_MARKED = 2048, 64
_rng = np.random.default_rng(20)
FACTORS = _rng.integers(1, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def normal(data: np.ndarray) -> np.ndarray:
    """Lower case, and every white space byte but the line end as a blank."""
    data = lower_ascii(data)
    return np.where((data >= 9) & (data <= 13) & (data != 10), 32, data).astype(np.uint8)


def line_shingles(column: pa.Array) -> Iterator[tuple[int, np.ndarray, ...]]:
    """For pieces of a column: first text, each line's text and number in it, its hash, where its shingles start
    (-1 if blank), bounds and hashes of all shingles, then bytes, starts and ends of the normal forms.

    Blank lines have no shingle. Runs of blanks count as one, those at the ends
    of a line not at all. A line shorter than a shingle is one shingle.
    """
    data, offsets = text_buffer(column)
    for a, b in pieces(offsets, PIECE):
        raw = normal(data[offsets[a] : offsets[b]])
        at = offsets[a : b + 1] - offsets[a]
        # a line end after each text, then no line crosses a text
        ends = np.zeros(len(raw) + b - a, np.uint8)
        places = np.arange(len(raw)) + np.repeat(np.arange(b - a), np.diff(at))
        ends[:] = 10
        ends[places] = raw
        text_end = at[1:] + np.arange(b - a)
        blank, line_end = ends == 32, ends == 10
        edge_before = np.empty(len(ends), bool)
        edge_before[:1], edge_before[1:] = True, (blank | line_end)[:-1]
        after_end = np.empty(len(ends), bool)
        after_end[-1:], after_end[:-1] = True, line_end[1:]
        keep = ~(blank & (edge_before | after_end))
        flat = ends[keep]
        stops = np.flatnonzero(flat == 10)
        starts = np.concatenate([[0], stops[:-1] + 1]) if len(stops) else np.zeros(0, np.int64)
        line_ends = np.flatnonzero(line_end)
        text = np.searchsorted(text_end, line_ends, "left")
        first_line = np.searchsorted(text, np.arange(b - a), "left")
        number = np.arange(len(text)) - first_line[text]
        size = stops - starts
        width = np.minimum(size, SHINGLE)
        many = np.where(size > 0, size - width + 1, 0)
        up, down = powers(len(flat) + 1)
        total = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
        bounds = np.concatenate([[0], np.cumsum(many)])
        whole = mix((total[stops] - total[starts]) * down[starts] + size.astype(np.uint64))
        # hashed at every place, in order, then those that reach over a line end are left out
        over = flat == 10
        for step in (1, 2, 4):
            over[:-step] |= over[step:]
        hashes = np.empty(len(flat), np.uint64)
        last = max(0, len(flat) - SHINGLE + 1)
        hashes[:last] = mix((total[SHINGLE:] - total[:last]) * down[:last] + np.uint64(SHINGLE))
        short = (size > 0) & (size < SHINGLE)
        hashes[starts[short]] = whole[short]
        over[starts[short]] = False
        hashes = hashes[~over]
        yield a, text, number, whole, np.where(size > 0, bounds[:-1], -1), bounds, hashes, flat, starts, stops


def once(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Line and leading bits of each distinct shingle of lines with so many shingles: a number with the line's in its
    leading bits, the hash's leading ones in the rest, is sorted."""
    bits = np.uint64(max(1, len(counts).bit_length()))
    line = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    own = np.sort((line << (np.uint64(64) - bits)) | (hashes >> bits))
    first = np.ones(len(own), bool)
    first[1:] = own[1:] != own[:-1]
    own = own[first]
    return (own >> (np.uint64(64) - bits)).astype(np.int64), own << bits


def distinct_of(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The number of distinct shingles of each line."""
    bits = np.uint64(max(1, (len(bounds) - 1).bit_length()))
    own = np.repeat(np.arange(len(bounds) - 1, dtype=np.uint64) << (np.uint64(64) - bits), np.diff(bounds))
    own |= hashes >> bits
    own.sort()  # a line's shingles stay between its bounds
    first = np.ones(len(own), bool)
    first[1:] = own[1:] != own[:-1]
    return np.diff(np.concatenate([[0], np.cumsum(first)])[bounds])


def band_keys(hashes: np.ndarray, bounds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """The keys of the bands of these lines, a row for each line."""
    # neighbouring lines that aren't asked for are left out, so segments are cut at both ends
    low = np.append((hashes >> np.uint64(32)).astype(np.uint32), np.uint32(0))
    cuts = np.stack([bounds[lines], bounds[lines + 1]], 1).ravel()
    keys = np.empty((BANDS, len(lines)), np.uint64)
    for band in range(BANDS):
        key = np.full(len(lines), band + 1, np.uint64)
        for row in range(ROWS):
            mixed = low * FACTORS[band * ROWS + row]
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0x2C1B3C6D)
            least = np.minimum.reduceat(mixed, cuts)[::2]
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + least)
        keys[band] = key
    return keys.T


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc, line, id, size, bands): every line that isn't blank, with the 64-bit hash of its normal form.

    ``bands`` has the keys of the line's bands, and ``size`` the number of its
    distinct shingles. Both are null where an equal line stands shortly before
    it, and for lines of one shingle, which can only be equal.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for a, text, number, whole, has, bounds, hashes, *_ in line_shingles(batch.column(1)):
                real = np.flatnonzero(has >= 0)
                _, one = np.unique(whole[real], return_index=True)
                first = np.zeros(len(whole), bool)
                first[real[one]] = True
                first &= np.diff(bounds) > 1
                posted = np.flatnonzero(first)
                sizes = np.zeros(len(whole), np.int64)
                starts = np.zeros(len(whole) + 1, np.int32)
                flat = np.zeros(0, np.uint64)
                if len(posted):
                    sizes[posted] = distinct_of(hashes, bounds)[posted]
                    flat = band_keys(hashes, bounds, posted).ravel()
                np.cumsum(first * BANDS, out=starts[1:])
                at = pa.array(np.append(starts[real], starts[-1]), pa.int32(), mask=np.append(~first[real], False))
                columns = [
                    pa.array(keys[a + text[real]], pa.int64()),
                    pa.array(number[real].astype(np.int32)),
                    pa.array(whole[real].view(np.int64)),
                    pa.array(sizes[real], mask=~first[real]),
                    pa.ListArray.from_arrays(at, pa.array(flat.view(np.int64))),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "line", "id", "size", "bands"])

    return map_arrow(docs, run, "doc long, line int, id long, size long, bands array<long>")


def postings(lines: DataFrame) -> DataFrame:
    """(key, id, size, need): a row for each band of each line that has bands; copies of a line repeat its rows."""
    rows = lines.where("bands is not null")
    return rows.select(F.explode("bands").alias("key"), "id", "size", F.lit(1).alias("need"))


def line_texts(docs: DataFrame, lines: DataFrame, ids: DataFrame, parts: int) -> DataFrame:
    """(id, line): the normal forms of the lines with these ids, each read from one document, dealt by id.

    A line is a fraction of its shingles' hashes, so it is lines that are stored and moved to pairs.
    """
    wanted = lines.select("doc", "line", "id").join(ids, "id").groupBy("id").agg(F.min(F.struct("doc", "line")).alias("p"))
    wanted = wanted.groupBy(F.col("p.doc").alias("doc")).agg(F.collect_list("p.line").alias("at"))
    held = docs.join(wanted, "doc").select("text", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(1)
            asked = np.column_stack([np.repeat(np.arange(len(at)), np.diff(at.offsets)), at.flatten().to_numpy()])
            asked = np.unique(asked[:, 0] << 32 | asked[:, 1])
            for a, text, number, whole, _, _, _, flat, starts, stops in line_shingles(batch.column(0)):
                mine = np.flatnonzero(np.isin((a + text) << 32 | number, asked))
                size = (stops - starts)[mine]
                ends = np.zeros(len(mine) + 1, np.int32)
                np.cumsum(size, out=ends[1:])
                data = pa.py_buffer(flat[ragged(starts[mine], size)].tobytes())
                held_lines = pa.StringArray.from_buffers(len(mine), pa.py_buffer(ends.tobytes()), data)
                yield pa.RecordBatch.from_arrays([pa.array(whole[mine].view(np.int64)), held_lines], ["id", "line"])

    found = map_arrow(held, run, "id long, line string")
    # rows with one key give a line more than once; they lie together by now
    return found.repartition(parts, "id").dropDuplicates(["id"])


def line_items(texts: DataFrame) -> DataFrame:
    """(id, items): the distinct shingles of lines in normal form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, text, _, _, _, bounds, hashes, *_ in line_shingles(batch.column(1)):
                items = [np.unique(hashes[i:j]) for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(items)), list_of(items)], ["id", "items"])

    return map_arrow(texts.select("id", "line"), run, "id long, items array<long>")


def line_parities(texts: DataFrame) -> DataFrame:
    """(id, parity): the parities of the distinct shingles of lines in normal form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, _, _, _, bounds, hashes, *_ in line_shingles(batch.column(1)):
                n = len(bounds) - 1
                words = parities(*once(hashes, np.diff(bounds)), n).ravel()
                parity = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * WORDS), pa.array(words))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), parity], ["id", "parity"])

    return map_arrow(texts.select("id", "line"), run, "id long, parity array<long>")


def shingles_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all shingles of rows of one line each, and how many a row has."""
    found, many = [np.zeros(0, np.uint64)], np.zeros(len(column), np.int64)
    for a, _, _, _, _, bounds, hashes, *_ in line_shingles(column):
        many[a : a + len(bounds) - 1] = np.diff(bounds)
        found.append(hashes)
    return np.concatenate(found), many


def marks(hashes: np.ndarray, many: np.ndarray) -> np.ndarray:
    """For each row which of ``MARKS`` places some of its shingles fall on."""
    marked = np.zeros((len(many), MARKS), bool)
    marked.ravel()[np.repeat(np.arange(len(many)) * MARKS, many) + (hashes >> np.uint64(64 - MARKS.bit_length() + 1)).astype(np.int64)] = True
    return marked


def alike(x: pa.Array, y: pa.Array, percent: int) -> np.ndarray:
    """Whether the lines of each row have this similarity.

    A place that one line marks and the other doesn't stands for a shingle or
    more that only one of them has, so most unlike lines are told without a sort.
    """
    (one, n), (two, m) = shingles_of(x), shingles_of(y)
    apart = np.empty(len(x), np.int64)
    # marks of few rows at a time: these stay in a core's cache
    ends_x, ends_y = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(m)])
    for a in range(0, len(x), ROWS_MARKED):
        b = min(a + ROWS_MARKED, len(x))
        left, right = marks(one[ends_x[a] : ends_x[b]], n[a:b]), marks(two[ends_y[a] : ends_y[b]], m[a:b])
        apart[a:b] = np.count_nonzero(left != right, axis=1)
    near = (100 + percent) * apart <= (100 - percent) * (n + m)
    one, two = one[np.repeat(near, n)], two[np.repeat(near, m)]
    (row_x, one), (row_y, two) = once(one, np.where(near, n, 0)), once(two, np.where(near, m, 0))
    # a number with the row's in its leading bits again, as both sides have as many rows
    shift = np.uint64(64 - max(1, len(x).bit_length()))
    one, two = (row_x.astype(np.uint64) << shift) | (one >> np.uint64(64) - shift), (row_y.astype(np.uint64) << shift) | (two >> np.uint64(64) - shift)
    both = np.intersect1d(one, two, assume_unique=True)
    n, m, common = (np.bincount((v >> shift).astype(np.int64), minlength=len(x)) for v in (one, two, both))
    return near & (100 * common >= percent * (n + m - common))


def alike_pairs(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of lines with this similarity; ``texts`` is bucketed by id, so only pairs and one line of each move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(text_buffer(batch.column(2))[1]) + np.diff(text_buffer(batch.column(3))[1])
            for i, j in pieces(np.concatenate([[0], np.cumsum(sizes)])):
                part = batch.slice(i, j - i)
                yield part.select(["a", "b"]).filter(pa.array(alike(part.column(2), part.column(3), percent)))

    left = texts.select(F.col("id").alias("a"), F.col("line").alias("x"))
    right = texts.select(F.col("id").alias("b"), F.col("line").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return staged(map_arrow(both, run, "a long, b long"), "found")


def lost_lines(df: DataFrame, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc, lost): for each document the numbers of the lines that repeat an earlier line, counted from 0.

    Lines are cut at line ends. Of each component of lines whose sets of
    shingles have this Jaccard similarity the one in the smallest key, there the
    first one, stays. Lines without a word always stay, and so do all lines of
    null and empty texts and of rows without a key. Rows with the same key are
    one document: the same line numbers go from each of them.
    """
    docs = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    lines = staged(lines_of(docs), "lines")
    texts = lambda ids, parts: line_texts(docs, lines, ids, parts)
    roots = linked(postings(lines), texts, percent, alike_pairs, line_items, line_parities)
    rooted = lines.join(roots, "id", "left").select("doc", "line", F.coalesce("root", "id").alias("root"))
    first = rooted.groupBy("root").agg(F.min(F.struct("doc", "line")).alias("first"), F.count("*").alias("n"))
    first = staged(first.where("n > 1").select("root", "first"), "firsts")
    return (
        rooted.join(first, "root")
        .where(F.struct("doc", "line") != F.col("first"))
        .groupBy("doc")
        .agg(F.array_sort(F.collect_set("line")).alias("lost"))
    )


def dedup(df: DataFrame, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``df`` with ``n_lines``, ``n_lost`` and ``kept_text``: the text without its lost lines (null stays null)."""
    clash = {"n_lines", "n_lost", "kept_text", "line_lost", "line_doc"} & set(df.columns)
    if clash:
        raise ValueError(f"input has the columns {sorted(clash)}")
    lost = lost_lines(df, percent, text, key).select(F.col("doc").alias("line_doc"), F.col("lost").alias("line_lost"))
    split = F.split(F.col(text), "\n", -1)
    kept = F.filter(split, lambda x, i: ~F.array_contains("line_lost", i))
    return df.join(lost, df[key].cast("long") == lost["line_doc"], "left").select(
        *(df[c] for c in df.columns),
        F.when(F.col(text).isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"),
        F.coalesce(F.when(F.col(text).isNotNull(), F.size("line_lost")), F.lit(0)).cast("long").alias("n_lost"),
        F.when(F.col("line_lost").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
    )


def without_lost(df: DataFrame, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``df`` with their kept text; a row that loses its last line with a word goes."""
    done = dedup(df, percent, text, key)
    rest = done.where((F.col("n_lost") == 0) | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    return rest.select(*(F.col("kept_text").alias(c) if c == text else F.col(c) for c in df.columns))
