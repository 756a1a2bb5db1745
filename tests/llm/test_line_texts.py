import random

import numpy as np
import pyarrow as pa

from sparkcols.llm import line_dedup
from sparkcols.llm.grouping import shared
from sparkcols.llm.textarrays import span_hashes


def shingles(line):
    return {line[i : i + 8] for i in range(max(1, len(line.encode()) - 7))}


def test_alike_equals_sets():
    """Lines of one piece and of several, next to the bound too."""
    draw = random.Random(3)
    pairs = []
    for n in [8, 9, 20, 40, 300, 300, 5000, 200_000]:
        for _ in range(6):
            one = "".join(draw.choices("abcdefgh ", k=n)).strip()
            one = " ".join(one.split()) or "a"
            two = list(one)
            for _ in range(draw.randrange(0, max(2, n // 70))):
                two[draw.randrange(len(two))] = "z"
            pairs.append((one, "".join(two).strip() or "z"))
    want = [100 * len(x & y) >= 80 * len(x | y) for x, y in ((shingles(a), shingles(b)) for a, b in pairs)]
    got = line_dedup.alike(pa.array([a for a, _ in pairs]), pa.array([b for _, b in pairs]), 80)
    assert got.tolist() == want and len(set(want)) == 2


def test_line_texts_are_normal_forms(spark):
    """Stored as text: what pairs are compared by is no larger than the line."""
    texts = ["  One \t LINE here \n\nß other, line\r\n", None, "", "one line here\nthird line é"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    lines = line_dedup.lines_of(docs).persist()
    got = line_dedup.line_texts(docs, lines, lines.select("id").distinct(), 3).collect()
    assert sorted(r.line for r in got) == ["one line here", "third line é", "ß other, line"]
    for r in got:
        data = np.frombuffer(r.line.encode(), np.uint8)
        assert span_hashes(data, np.array([0]), np.array([len(data)])).view(np.int64)[0] == r.id
    items = {r.id: set(r.items) for r in line_dedup.line_items(spark.createDataFrame(got)).collect()}
    assert {r.id: len(shingles(r.line)) for r in got if r.line.isascii()}.items() <= {k: len(v) for k, v in items.items()}.items()
    lines.unpersist()


def test_copies_of_one_line_are_no_candidates(spark):
    docs = spark.createDataFrame([(i, "the same line of some words in all") for i in range(9)], "doc long, text string")
    posts = line_dedup.postings(line_dedup.lines_of(docs))
    assert posts.count() >= line_dedup.BANDS and shared(posts).isEmpty()
