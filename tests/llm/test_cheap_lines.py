import random

import numpy as np
import pyarrow as pa

from sparkcols.llm import line_dedup


def test_unlike_lines_are_told_without_a_sort(monkeypatch):
    """Only the shingles of like lines are sorted and intersected."""
    draw = random.Random(8)
    lines = ["".join(draw.choices("abcdefghij ", k=300)).strip() for _ in range(200)]
    copies = [x[:280] + "other" for x in lines[:10]]
    seen = []
    whole = np.intersect1d

    def counted(x, y, **more):
        seen.append(len(x) + len(y))
        return whole(x, y, **more)

    monkeypatch.setattr(np, "intersect1d", counted)
    got = line_dedup.alike(pa.array(lines), pa.array([*copies, *lines[11:], lines[0]]), 80)
    assert got.tolist() == [True] * 10 + [False] * 190
    assert 0 < sum(seen) < 12 * 600


def test_hashes_of_lines_of_all_lengths():
    """Short, blank and empty lines between others, at the end of a text and of the buffer."""
    draw = random.Random(9)
    texts = ["\n".join("".join(draw.choices("ab ", k=draw.randrange(0, 14))) for _ in range(draw.randrange(0, 6))) for _ in range(300)]
    for a, text, number, whole, has, bounds, hashes, flat, starts, stops in line_dedup.line_shingles(pa.array(texts)):
        for i in range(len(whole)):
            line = flat[starts[i] : stops[i]].tobytes()
            sets = {line[j : j + 8] for j in range(max(1, len(line) - 7))} if line else set()
            own = hashes[bounds[i] : bounds[i + 1]]
            assert len(own) == (max(1, len(line) - 7) if line else 0) and len(set(own.tolist())) == len(sets)
        sizes = [len(set(hashes[i:j].tolist())) for i, j in zip(bounds[:-1], bounds[1:])]
        assert line_dedup.distinct_of(hashes, bounds).tolist() == sizes
