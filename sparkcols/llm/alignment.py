"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Both tokenizers' tokens tile the same bytes. ``pandas.merge_asof`` per batch,
keyed by document, finds for each token start the token of the other side that
covers it: of two tokens that overlap, one starts inside the other, so both
directions together give every overlap. Positions at which tokens of both sides
end cut the tokens into groups.

Corpus-wide counts of linked ids are taken from distinct pairs per block of
documents. A block asks for its pairs' counts once, by a join on the pair, and
its documents read them from there: a frequent pair costs a row for each block,
not for each occurrence.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcols.llm.shipping import map_arrow, ship
from sparkcols.llm.textarrays import pieces, ragged, text_buffer
from sparkcols.session import staged

#: bytes of text that are aligned together
BLOCK = 3 << 19
#: words of up to so many characters are remembered, at most so many of them in a worker
SHORT, REMEMBERED = 48, 1 << 19
#: B's id lies in the low bits of a pair
LOW_BITS = 32


class Side(NamedTuple):
    """A tokenizer: how it encodes a list of texts, all tokens' bytes with their start and length by id, and
    whether no token reaches over a blank between two other characters."""

    encode: object
    blob: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    by_word: bool


def side_of(encode, tokens: list[bytes], by_word: bool) -> Side:
    lengths = np.array([len(t) for t in tokens], np.int64)
    return Side(encode, np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(lengths) - lengths, lengths, by_word)


def letters_of_bytes() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it's visible, else one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=4)
def byte_level(file: bytes) -> Side:
    """A byte-level tokenizer from its JSON file; special tokens' strings are plain text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(file.decode())
    tokenizer.encode_special_tokens = True
    letters, names = letters_of_bytes(), tokenizer.get_vocab(with_added_tokens=True)
    tokens = [b""] * (max(names.values()) + 1)
    for name, i in names.items():
        known = all(c in letters for c in name)
        tokens[i] = bytes(letters[c] for c in name) if known else name.encode()
    given = json.loads(file)
    cut = given["pre_tokenizer"] or {}
    by_word = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut["add_prefix_space"] and not given["normalizer"]
    encode = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    return side_of(encode, tokens, bool(by_word))


@lru_cache(maxsize=4)
def piece_level(file: bytes) -> Side:
    """A sentence-piece tokenizer from its model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=file)
    named = [(model.id_to_piece(i), model.is_byte(i)) for i in range(model.get_piece_size())]
    tokens = [bytes([int(p[3:5], 16)]) if byte else p.replace("▁", " ").encode() for p, byte in named]
    by_word = not any("▁" in p.lstrip("▁") for p, _ in named)
    return side_of(lambda texts: model.encode(texts, num_threads=1), tokens, by_word)


class Tokens(NamedTuple):
    """Tokens of a list of texts, one after the other: ids, first and end byte, number of the text."""

    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray


#: a blank beside other white space: what a tokenizer makes of them may depend on both
CROWDED = re.compile(r" \s|\s ")


class Words:
    """Ids that both sides give a word, A after a blank; short words are remembered while the worker lives.

    A text is cut at its blanks where neither side has a token that reaches over
    one; a text with a blank beside other white space or at its end is one word.
    """

    def __init__(self, *sides: Side) -> None:
        self.sides, self.by_word = sides, all(s.by_word for s in sides)
        self.known: dict[str, int] = {}
        self.ids = [np.zeros(0, np.int32) for _ in sides]
        self.many = [np.zeros(0, np.int64) for _ in sides]

    def cut(self, text: str) -> list[str]:
        plain = self.by_word and not text.endswith(" ") and not CROWDED.search(" " + text)
        return text.split(" ") if plain else [text]

    def encoded(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each side the ids of all texts and how many each text has."""
        cuts = [self.cut(t) for t in texts]
        words = list(chain.from_iterable(cuts))
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        fresh = sorted(dict.fromkeys(words[i] for i in new.tolist()), key=lambda w: len(w) > SHORT)
        places = {w: i for i, w in enumerate(fresh, len(self.known))}
        at[new] = [places[words[i]] for i in new.tolist()]
        short = sum(len(w) <= SHORT for w in fresh)
        keep = len(self.known) + min(short, max(0, REMEMBERED - len(self.known)))
        ends = np.concatenate([[0], np.cumsum([len(c) for c in cuts], dtype=np.int64)])
        out = []
        for i, side in enumerate(self.sides):
            lists = side.encode([" " + w for w in fresh] if i == 0 else fresh) if fresh else []
            added = np.fromiter(chain.from_iterable(lists), np.int32)
            ids = np.concatenate([self.ids[i], added])
            many = np.concatenate([self.many[i], np.array([len(x) for x in lists], np.int64)])
            own = many[at]
            total = np.concatenate([[0], np.cumsum(own)])
            out.append((ids[ragged((np.cumsum(many) - many)[at], own)].astype(np.int64), np.diff(total[ends])))
            self.many[i] = many[:keep]
            self.ids[i] = ids[: int(many[:keep].sum())]
        self.known.update((w, i) for w, i in places.items() if i < keep)
        return out


@lru_cache(maxsize=2)
def words_of(file_a: bytes, file_b: bytes) -> Words:
    return Words(byte_level(file_a), piece_level(file_b))


def faithful(side: Side, ids: np.ndarray, many: np.ndarray, wanted: list[bytes]) -> np.ndarray:
    """For each text whether its tokens' bytes are the wanted ones."""
    sizes = side.lengths[ids]
    text = side.blob[ragged(side.starts[ids], sizes)].tobytes()
    ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(many)])].tolist()
    return np.array([text[a:b] == w for a, b, w in zip(ends, ends[1:], wanted)], bool)


def tokens_of(side: Side, ids: np.ndarray, many: np.ndarray) -> Tokens:
    ends = np.cumsum(side.lengths[ids])
    return Tokens(ids, ends - side.lengths[ids], ends, np.repeat(np.arange(len(many)), many))


def covering(own: Tokens, other: Tokens) -> np.ndarray:
    """For each token the place of the other side's token that covers its first byte."""
    left = pd.DataFrame({"at": own.starts, "doc": own.doc})
    right = pd.DataFrame({"at": other.starts, "doc": other.doc, "place": np.arange(len(other.ids))})
    return pd.merge_asof(left, right, on="at", by="doc")["place"].to_numpy(np.int64)


def overlaps(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of tokens that share a byte: both directions, a pair with one start once."""
    of_a, of_b = covering(a, b), covering(b, a)
    new = a.starts[of_b] != b.starts
    return np.concatenate([np.arange(len(a.ids)), of_b[new]]), np.concatenate([of_a, np.flatnonzero(new)])


def common(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which of the ascending values are among the other ascending values."""
    if not len(other):
        return np.zeros(len(own), bool)
    return other[np.minimum(np.searchsorted(other, own), len(other) - 1)] == own


@lru_cache(maxsize=8)
def names(size: int, end: str) -> np.ndarray:
    """The texts of ids 0 .. size - 1, each with an end."""
    return np.array([f"{i}{end}" for i in range(size)], object)


def group_texts(a: Tokens, b: Tokens, last_a: np.ndarray, last_b: np.ndarray, docs: int, sizes: tuple[int, int]) -> list[str]:
    """For each text its groups as ``a1,a2|b1;a3|b2,b3``. ``last_a`` and ``last_b`` mark the tokens that end a group."""
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    ends_a, ends_b = np.flatnonzero(last_a) + 1, np.concatenate([[0], np.flatnonzero(last_b) + 1])
    at_a = np.arange(len(a.ids)) + ends_b[group_a]
    at_b = np.arange(len(b.ids)) + ends_a[group_b]
    parts = np.empty(len(a.ids) + len(b.ids), object)
    parts[at_a] = np.where(last_a, names(sizes[0], "|")[a.ids], names(sizes[0], ",")[a.ids])
    parts[at_b] = np.where(last_b, names(sizes[1], ";")[b.ids], names(sizes[1], ",")[b.ids])
    bounds = np.cumsum(np.bincount(a.doc, minlength=docs) + np.bincount(b.doc, minlength=docs))
    parts, ends = parts.tolist(), [0, *bounds.tolist()]
    return ["".join(parts[i:j])[:-1] for i, j in zip(ends, ends[1:])]


class Aligned(NamedTuple):
    """What a block of texts gives: per text counts and groups, all links as (text, pair of ids)."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[str]
    link_doc: np.ndarray
    link_pair: np.ndarray


def align_block(texts: list[str | None], words: Words) -> Aligned:
    """The alignment of each text, tokenized by A after a blank and by B, which adds the blank itself."""
    rows = [i for i, t in enumerate(texts) if t]
    given = [texts[i] for i in rows]
    side_a, side_b = words.sides
    wanted = [b" " + t.encode() for t in given]
    (ids_a, many_a), (ids_b, many_b) = words.encoded(given)
    good = faithful(side_a, ids_a, many_a, wanted) & faithful(side_b, ids_b, many_b, wanted)
    ids_a, ids_b = ids_a[np.repeat(good, many_a)], ids_b[np.repeat(good, many_b)]
    rows, many_a, many_b = np.array(rows, np.int64)[good], many_a[good], many_b[good]
    a, b = tokens_of(side_a, ids_a, many_a), tokens_of(side_b, ids_b, many_b)
    of_a, of_b = overlaps(a, b)
    last_a, last_b = common(a.ends, b.ends), common(b.ends, a.ends)
    told = group_texts(a, b, last_a, last_b, len(rows), (len(side_a.lengths), len(side_b.lengths)))
    groups = [""] * len(texts)
    for i, text in zip(rows.tolist(), told):
        groups[i] = text

    def spread(counts: np.ndarray) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        out[rows] = counts
        return out

    per_doc = lambda doc: spread(np.bincount(doc, minlength=len(rows)))
    return Aligned(
        spread(many_a), spread(many_b), per_doc(a.doc[last_a]), per_doc(a.doc[of_a]), groups,
        rows[a.doc[of_a]] if len(rows) else of_a, (a.ids[of_a] << LOW_BITS) | b.ids[of_b],
    )


def held_files(df: DataFrame, path_a: str, path_b: str):
    """Both vocabulary files, read on the driver and broadcast: their size is fixed."""
    files = []
    for path in (path_a, path_b):
        with open(path, "rb") as file:
            files.append(file.read())
    return df.sparkSession.sparkContext.broadcast(tuple(files))


def align(df: DataFrame, path_a: str, path_b: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Key, ``n_a``, ``n_b``, ``n_groups``, ``n_links`` and the ``groups`` themselves as text, for every row.

    Texts that are null or empty, or that either tokenizer doesn't give back
    byte for byte, have no tokens. Rows are read one by one: repeated rows give
    repeated results, other columns are not looked at.
    """
    held = held_files(df, path_a, path_b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(*held.value)
        for batch in batches:
            _, offsets = text_buffer(batch.column(1))
            for first, last in pieces(offsets, BLOCK):
                part = batch.slice(first, last - first)
                done = align_block(part.column(1).to_pylist(), words)
                columns = [*map(pa.array, done[:4]), pa.array(done.groups, pa.string())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *columns], ["k", "n_a", "n_b", "n_groups", "n_links", "groups"]
                )

    kind = df.schema[key].dataType.simpleString()
    schema = f"k {kind}, n_a long, n_b long, n_groups long, n_links long, groups string"
    return map_arrow(df.select(F.col(key), F.col(text)), run, schema).withColumnRenamed("k", key)


def ints(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """Lists of numbers from one array each."""
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def linked_blocks(df: DataFrame, path_a: str, path_b: str, text: str, key: str) -> DataFrame:
    """Rows of documents and, with a null ``n_a``, a row for each block with its distinct ``pairs`` and their ``times``.

    A document names its pairs by their ``slots`` in its block's list.
    """
    held = held_files(df, path_a, path_b)
    kind = df.schema[key].dataType.simpleString()
    schema = (
        f"block long, k {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "slots array<int>, times array<int>, pairs array<long>"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words = words_of(*held.value)
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            _, offsets = text_buffer(batch.column(1))
            for first, last in pieces(offsets, BLOCK):
                part = batch.slice(first, last - first)
                docs = len(part)
                done = align_block(part.column(1).to_pylist(), words)
                pairs, slot, times = np.unique(done.link_pair, return_inverse=True, return_counts=True)
                own, many = np.unique(done.link_doc * len(pairs) + slot, return_counts=True)
                cuts = np.searchsorted(own, np.arange(1, docs) * len(pairs)) if len(pairs) else np.zeros(docs - 1, np.int64)
                slots = np.split(own % max(len(pairs), 1), cuts) if docs else []
                hashes = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in done.groups]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(docs, block)), part.column(0), *map(pa.array, done[:4]), pa.array(hashes, pa.string()),
                        ints(slots, pa.int32()), ints(np.split(many, cuts) if docs else [], pa.int32()),
                        pa.nulls(docs, pa.list_(pa.int64())),
                    ],
                    NAMES,
                )
                one = lambda t: pa.nulls(1, t)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block]), one(part.schema.field(0).type), *(one(pa.int64()) for _ in range(4)), one(pa.string()),
                        one(pa.list_(pa.int32())), ints([times], pa.int32()), ints([pairs], pa.int64()),
                    ],
                    NAMES,
                )
                block += 1

    return map_arrow(df.select(F.col(key), F.col(text)), run, schema)


NAMES = ["block", "k", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "slots", "times", "pairs"]


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, n, best): links of every pair of ids in the corpus, and whether no pair of its B id has more."""
    counts = blocks.where("pairs is not null").select(F.inline(F.arrays_zip("pairs", "times")))
    counts = staged(counts.groupBy(F.col("pairs").alias("pair")).agg(F.sum(F.col("times").cast("long")).alias("n")), "counts")
    b_id = F.col("pair").bitwiseAND(F.lit((1 << LOW_BITS) - 1)).alias("b")
    # one row for each entry of B's vocabulary at most
    most = counts.groupBy(b_id).agg(F.max("n").alias("most"))
    told = counts.withColumn("b", b_id).join(F.broadcast(most), "b")
    return told.select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def score(df: DataFrame, path_a: str, path_b: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``df``: key, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``.

    A link's count is how many links of all texts join the same two ids;
    ``n_best`` are the links whose count is the highest of their B id, and
    ``count_sum`` is the sum over a row's links. Rows without tokens (see
    ``align``) have zeros and an empty digest; repeated rows count each time.
    """
    blocks = staged(linked_blocks(df, path_a, path_b, text, key), "aligned")
    counts = staged(pair_counts(blocks), "pair_counts")
    asked = blocks.where("pairs is not null").select("block", F.posexplode("pairs").alias("slot", "pair"))
    told = asked.join(counts, "pair").select(F.col("block").alias("of"), "slot", "n", "best")
    docs = blocks.where("n_a is not null").drop("pairs")
    kind = df.schema[key].dataType.simpleString()
    schema = (
        f"k {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    )

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names_out = ["k", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        n, best = (np.zeros(len(right) + 1, np.int64) for _ in range(2))
        slot = right["slot"].to_numpy()
        n[slot], best[slot] = right["n"].to_numpy(), right["best"].to_numpy().astype(np.int64)
        own = left["slots"].combine_chunks()
        many = own.value_lengths().to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(left)), many)
        slots = own.flatten().to_numpy(zero_copy_only=False)
        times = left["times"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        total, good = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
        np.add.at(total, doc, times * n[slots])
        np.add.at(good, doc, times * best[slots])
        plain = [left[c] for c in names_out[:5]]
        return pa.table([*plain, pa.array(good), pa.array(total), left["groups_sha256"]], names_out)

    ship(df.sparkSession)
    done = docs.groupBy("block").cogroup(told.groupBy("of")).applyInArrow(run, schema)
    return done.withColumnRenamed("k", key)
