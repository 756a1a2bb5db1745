"""Quality classifier: ordinal cumulative-link regression on hashed words.

All grades share one weight for each hashed word; ordered thresholds cut the
score into grades: P(grade > j) = sigmoid(score - threshold_j). The expected
grade is the sum of these tail probabilities. A word counts by its share of the
text; words that tell the lowest grade from the others in the fitting sample
count once more, in full however long the text is. The cut below which a text
is not kept is set on rated rows that the weights have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcols.llm.shipping import map_arrow
from sparkcols.llm.textarrays import lower_ascii, pieces, span_hashes, text_buffer, word_spans

#: hashed words, grades 0 .. GRADES - 1, and the bound of the fitting sample in rated documents
BITS, GRADES, SAMPLE = 18, 3, 10000
STEPS, RATE, DECAY = 200, 0.5, 1e-4
#: least likelihood ratio of a telling word, the most its share elsewhere may be, decay of its weight
TELLING, ELSEWHERE, STRONG_DECAY = 25.0, 0.1, 1e-3
#: one rated row in so many is held out for the cut, which may cost this share of its better rows
HELD_OUT, LOSS = 4, 0.005


class Model(NamedTuple):
    """Weights of word shares, thresholds, weights of telling words (zero for all others), and the cut of P(grade > 0)."""

    weights: np.ndarray
    thresholds: np.ndarray
    strong: np.ndarray
    cut: float


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its hashed words and their weights: 1 + log of the count, scaled to length 1.

    Words are runs of a to z (either case) and of bytes beyond ASCII. One more
    feature holds the share of space-separated words with other characters, and
    one the share of repeated words. Texts without any word have no features.
    """
    data, offsets = text_buffer(column)
    for a, b in pieces(offsets):
        part, at = lower_ascii(data[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a]
        letter = ((part >= 97) & (part <= 122)) | (part >= 128)
        starts, ends, text = word_spans(part, at)
        letters = np.concatenate([[0], np.cumsum(letter)])
        pure = letters[ends] - letters[starts] == ends - starts
        bounds = np.searchsorted(text, np.arange(b - a + 1))
        only = np.where(letter, part, np.uint8(32))
        starts, ends, text = word_spans(only, at)
        hashed = (span_hashes(only, starts, ends) >> np.uint64(64 - BITS)).astype(np.int64)
        inner = np.searchsorted(text, np.arange(b - a + 1))
        for k in range(b - a):
            (i, j), (m, n) = bounds[k : k + 2].tolist(), inner[k : k + 2].tolist()
            if i == j:
                yield np.zeros(0, np.int64), np.zeros(0)
                continue
            words, counts = np.unique(hashed[m:n], return_counts=True)
            values = 1 + np.log(counts)
            values = values / max(np.sqrt((values**2).sum()), 1)
            yield (
                np.append(words, [1 << BITS, (1 << BITS) + 1]),
                np.append(values, [1 - pure[i:j].mean(), 1 - len(words) / max(n - m, 1)]),
            )


def tails(scores: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade > j) for every score and threshold."""
    return 1 / (1 + np.exp(-np.clip(scores[:, None] - thresholds[None, :], -40, 40)))


def sample(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A bounded sample of rated texts: (key, grade, text), whole texts of the ``SAMPLE`` keys of smallest hash.

    The grade is 0 for toxic, 1 for clean but poor, 2 for clean and good text.
    Rows with a null rating or key are not used; a repeated key takes its lowest
    grade and, if its texts differ, the one of smallest hash.
    """
    grade = F.when(F.col("toxic") == 1, 0).otherwise(F.col("quality") + 1)
    rated = labels.where("toxic is not null and quality is not null").groupBy(key).agg(F.min(grade).cast("int").alias("grade"))
    chosen = rated.where(F.col(key).isNotNull()).orderBy(F.xxhash64(key), key).limit(SAMPLE)
    found = docs.select(F.col(key), F.col(text).alias("text")).join(F.broadcast(chosen), key)
    once = F.min_by("text", F.struct(F.xxhash64("text"), F.col("text").isNull()))
    return found.groupBy(key).agg(F.min("grade").alias("grade"), once.alias("text"))


def sample_features(rows: DataFrame, key: str = "doc_id") -> pa.Table:
    """Key hash, grade, words and values of the sample, worked out in tasks: texts don't reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(features(batch.column(2)))
            at = np.concatenate([[0], np.cumsum([len(w) for w, _ in found])]).astype(np.int32)
            words = np.concatenate([w for w, _ in found] or [np.zeros(0)]).astype(np.int32)
            values = np.concatenate([v for _, v in found] or [np.zeros(0)]).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(at, words), pa.ListArray.from_arrays(at, values)],
                ["mark", "grade", "words", "values"],
            )

    marked = rows.select(F.xxhash64(key).alias("mark"), "grade", "text")
    return map_arrow(marked, run, "mark long, grade int, words array<int>, values array<float>").toArrow().sort_by("mark")


def telling(words: np.ndarray, row: np.ndarray, lowest: np.ndarray) -> np.ndarray:
    """Log odds of the words that the rows of the lowest grade hold far more often than others, zero for all other words."""
    size = (1 << BITS) + 2
    own, other = lowest.sum(), (~lowest).sum()
    if not own or not other:
        return np.zeros(size)
    inside = lowest[row]
    a, b = (np.bincount(words[m], minlength=size).astype(float) for m in (inside, ~inside))
    share = own / (own + other)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * (
            np.where(a > 0, a * np.log(a / ((a + b) * share)), 0) + np.where(b > 0, b * np.log(b / ((a + b) * (1 - share))), 0)
        )
    chosen = (ratio > TELLING) & (b / other < ELSEWHERE * a / own)
    chosen[-2:] = False
    return np.where(chosen, np.log((a + 0.5) / (own + 1) * (other + 1) / (b + 0.5)), 0)


def best_cut(p: np.ndarray, lowest: np.ndarray) -> float:
    """The least cut that stops as many rows of the lowest grade as one costing at most ``LOSS`` of the others can.

    Half, where there are no held-out rows of both kinds.
    """
    better = np.sort(p[~lowest])
    if not len(better) or not lowest.any():
        return 0.5
    top = better[int(LOSS * len(better))]
    stopped = p[lowest & (p < top)]
    if not len(stopped):
        return float(min(top, 0.5))
    last = stopped.max()
    return float((last + better[np.searchsorted(better, last, "right")]) / 2)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", grades: int = GRADES) -> Model:
    """Weights and thresholds by full gradient steps on the sample, in numpy on the driver.

    Only the features of the sample, at most SAMPLE rows of distinct hashed
    words, are read there; their order is fixed by the key's hash, so the same
    rows give the same model. Without rated rows all weights are zero.
    """
    rows = sample_features(sample(docs, labels, text, key), key)
    size = (1 << BITS) + 2
    thresholds = np.linspace(-1, 1, grades - 1) if grades > 2 else np.zeros(1)
    if not rows.num_rows:
        return Model(np.zeros(size), thresholds, np.zeros(size), 0.5)
    rows = rows.combine_chunks()
    grade = rows.column("grade").to_numpy()
    held = rows.column("mark").to_numpy() % HELD_OUT == 0
    held &= not held.all()
    lists = rows.column("words").chunk(0)
    ends = np.asarray(lists.offsets, np.int64)
    words = np.asarray(lists.values, np.int64)
    values = np.asarray(rows.column("values").chunk(0).values, np.float64)
    row = np.repeat(np.arange(len(grade)), np.diff(ends))
    used = ~held[row]
    place = np.cumsum(~held) - 1  # the held-out rows are left out of the odds
    odds = telling(words[used], place[row[used]], grade[~held] == 0)
    strong = -odds / 2
    marked = np.flatnonzero(odds[words] > 0)
    above = (grade[:, None] > np.arange(grades - 1)[None, :]).astype(float)
    # rare grades count as much as frequent ones
    share = np.bincount(grade[~held], minlength=grades)
    each = (~held).sum() / (np.maximum(share, 1) * (share > 0).sum())
    each = np.where(held, 0, each[grade]) / (~held).sum()
    weights = np.zeros(size)
    pace, pace_s, pace_t = np.full(size, 1e-8), np.full(size, 1e-8), np.full(grades - 1, 1e-8)

    def scored() -> np.ndarray:
        total = np.bincount(row, weights[words] * values, len(grade))
        return total + np.bincount(row[marked], strong[words[marked]], len(grade))

    for _ in range(STEPS):
        error = (tails(scored(), thresholds) - above) * each[:, None]
        slope = np.bincount(words, (error.sum(1))[row] * values, size) + DECAY * weights
        slope_s = np.bincount(words[marked], error.sum(1)[row[marked]], size) + STRONG_DECAY * (strong + odds / 2)
        slope_t = -error.sum(0)
        pace += slope**2
        pace_s += slope_s**2
        pace_t += slope_t**2
        weights -= RATE * slope / np.sqrt(pace)
        strong -= np.where(odds > 0, 0.1 * RATE * slope_s / np.sqrt(pace_s), 0)
        thresholds = np.sort(thresholds - RATE * slope_t / np.sqrt(pace_t))
    p = tails(scored(), thresholds)[:, 0]
    return Model(weights, thresholds, strong, best_cut(p[held], grade[held] == 0))


def score(df: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``df``: the key, ``expected_grade``, the tails ``p_1`` ..., and ``kept``: P(grade > 0) reaches the model's cut.

    Whole texts are read. Null and empty texts have no features and score 0. A
    text at the cut is kept. Repeated rows give repeated results; other columns
    are not looked at, whatever their names.
    """
    held = df.sparkSession.sparkContext.broadcast(model)
    cuts = len(model.thresholds)
    names = [f"p_{j + 1}" for j in range(cuts)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, thresholds, strong, _ = held.value
        for batch in batches:
            scores = np.array([float((weights[f] * v).sum() + strong[f].sum()) for f, v in features(batch.column(1))])
            tail = tails(scores, thresholds).reshape(-1, cuts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tail.sum(1)), *(pa.array(tail[:, j].copy()) for j in range(cuts))],
                ["k", "expected_grade", *names],
            )

    kind = df.schema[key].dataType.simpleString()
    schema = f"k {kind}, expected_grade double, " + ", ".join(f"{n} double" for n in names)
    rows = map_arrow(df.select(F.col(key), F.col(text)), run, schema)
    return rows.withColumn("kept", F.col("p_1") >= F.lit(model.cut)).withColumnRenamed("k", key)
