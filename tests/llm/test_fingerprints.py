"""Sketches against whole shingle sets, neighbours against a sorted list."""

import hashlib
import re

import numpy as np
import pytest

from sparkcols.llm import fingerprints as fp, plans
from sparkcols.llm.textarrays import shingle_sets

SCHEMA = "doc_id long, text string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def jaccard(x, y):
    return len(x & y) / len(x | y) if x | y else 1.0


def by_hand(rows):
    """doc_id, n_chars, edited digest and exact resemblances; ties by nothing but the text have equal ones."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for i, (key, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        near = (jaccard(shingles(text), shingles(edited)), jaccard(shingles(text), shingles(following)))
        out.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), *near))
    return out


def told(df, **options):
    done = fp.neighbours(df, **options).collect()
    return [(r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in done]


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_neighbours(spark, monkeypatch, parts):
    monkeypatch.setattr(fp, "parts_for", lambda df: parts)
    monkeypatch.setattr(fp, "pieces", lambda offsets: [(i, min(i + 3, len(offsets) - 1)) for i in range(0, len(offsets) - 1, 3)])
    draw = np.random.default_rng(parts)
    texts = [" ".join(draw.choice(["a", "B", "ç", "dd", "e"], draw.integers(0, 40))) for _ in range(60)]
    rows = [(int(k), t) for k, t in zip(draw.permutation(500)[:60], texts)]
    rows[3], rows[4], rows[5] = (rows[3][0], None), (rows[4][0], ""), (rows[5][0], " \n\t")
    got = told(spark.createDataFrame(rows, SCHEMA).repartition(7))
    assert sorted(got) == sorted(by_hand(rows))


def test_estimates_of_long_texts(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    wanted = {r[0]: r for r in by_hand(rows)}
    done = plans.op12_fingerprints(spark, sf_dir).collect()
    assert len(done) == len(rows)
    for r in done:
        key, n, digest, near_edited, near_next = wanted[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, digest)
        assert abs(r.near_edited - near_edited) < 0.2 and abs(r.near_next - near_next) < 0.2
    errors = [r.near_edited - wanted[r.doc_id][3] for r in done]
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.045


@pytest.mark.parametrize("rows", [[], [(1, "a b c")], [(None, "a"), (None, "a"), (None, None)]])
def test_few_rows(spark, rows):
    assert sorted(told(spark.createDataFrame(rows, SCHEMA)), key=repr) == sorted(by_hand(rows), key=repr)


def test_equal_keys_repeats_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(fp, "parts_for", lambda df: 3)
    rows = [(7, "x y z")] * 30 + [(9, "u v"), (3, "w"), (None, "n"), (None, "n")]
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], SCHEMA + ", part int, fingerprint string")
    assert sorted(told(df), key=repr) == sorted(by_hand(rows), key=repr)


def test_sketches_merge_and_estimate():
    texts = [" ".join(f"w{i}" for i in range(a, b)) for a, b in ((0, 3000), (1000, 4000), (0, 60), (20, 60))]
    a, b, c, d = fp.sketches(texts)
    whole = next(shingle_sets(__import__("pyarrow").array([" ".join(texts[:2])]), 5))
    assert abs(fp.shingle_count(fp.merged(a, b)) / 3996 - 1) < 0.3 and len(whole) > 3990
    assert (fp.merged(fp.merged(a, c), b) == fp.merged(a, fp.merged(b, c))).all()
    assert abs(fp.resemblance(a, b) - 1996 / 3996) < 0.15 and abs(fp.containment(a, b) - 1996 / 2996) < 0.2
    assert fp.resemblance(c, d) == 36 / 56 and fp.containment(d, c) == 1.0 and fp.shingle_count(c) == 56
    assert fp.resemblance(a[:0], a[:0]) == 1 and fp.resemblance(a, a[:0]) == 0 and fp.containment(a[:0], a) == 1
    assert (fp.read(fp.written(a)) == a).all()


def test_merge_by_group(spark):
    texts = [("g", " ".join(f"w{i}" for i in range(k * 10, k * 10 + 40))) for k in range(30)] + [(None, "a b c"), (None, None), ("e", "")]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "doc_id long, grp string, text string")
    done = fp.fingerprint(df).join(df.select("doc_id", "grp"), "doc_id")
    got = {r.grp: r.fingerprint for r in fp.merge_by(done, "grp").collect()}
    for name in ("g", None, "e"):
        sets = [next(shingle_sets(__import__("pyarrow").array([t], "string"), 5)) for g, t in texts if g == name]
        assert got[name] == fp.written(np.unique(np.concatenate(sets))[: fp.SIZE])
