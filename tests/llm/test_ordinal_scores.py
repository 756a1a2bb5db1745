"""Ordinal quality: scores by a plain loop, whole texts in the fit, held-out accuracy, odd rows."""

import math
import os
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkcols.llm import ordinal_quality
from sparkcols.llm.textarrays import span_hashes

BIG = "/root/testdata/sf0.1"


def word_hash(word):
    data = np.frombuffer(word.encode(), np.uint8)
    return int(span_hashes(data, np.array([0]), np.array([len(data)]))[0]) >> (64 - ordinal_quality.BITS)


def plain_score(text, model):
    words = re.findall(r"[a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    spaced = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    if not spaced:
        return 0.0
    counts = {}
    for w in words:
        counts[word_hash(w)] = counts.get(word_hash(w), 0) + 1
    norm = max(math.sqrt(sum((1 + math.log(c)) ** 2 for c in counts.values())), 1)
    total = sum(model.weights[h] * (1 + math.log(c)) / norm + model.strong[h] for h, c in counts.items())
    odd = sum(bool(re.search(r"[\x00-\x60\x7b-\x7f]", re.sub("[A-Z]", "a", w))) for w in spaced) / len(spaced)
    return total + model.weights[-2] * odd + model.weights[-1] * (1 - len(counts) / max(len(words), 1))


def test_scores_equal_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    size = (1 << ordinal_quality.BITS) + 2
    strong = np.where(rng.random(size) < 0.3, rng.normal(size=size), 0)
    strong[-2:] = 0
    model = ordinal_quality.Model(rng.normal(size=size), np.array([-0.5, 0.7]), strong, 0.4)
    texts = ["Some words, some MORE words!", "été 123 ### x", "123 456", "", None, " \n ", "a\x0bb c-d " * 5000, "İ K"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(0, texts[0], 1)], "doc_id long, text string, p_1 int")
    got = ordinal_quality.score(df, model).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        p = [1 / (1 + math.exp(t - plain_score(texts[r.doc_id], model))) for t in model.thresholds]
        assert r.p_1 == pytest.approx(p[0]) and r.p_2 == pytest.approx(p[1]) and r.expected_grade == pytest.approx(sum(p))
        assert r.kept == (r.p_1 >= 0.4)


def test_the_fit_sees_ends_of_long_texts(spark):
    rows = [(i, "plain word " * 4000 + ("vile" if i % 3 == 0 else "kind")) for i in range(120)]
    docs = spark.createDataFrame(rows + rows[:10], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(90)] + [(0, 1, 0)], "doc_id long, quality int, toxic int")
    model = ordinal_quality.fit(docs, labels)
    assert model.strong[word_hash("vile")] < 0
    assert all(r.kept == (r.doc_id % 3 > 0) for r in ordinal_quality.score(docs, model).where("doc_id >= 90").collect())


def test_repeated_keys_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "c d"), (1, None), (2, "e")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert [(r.doc_id, r.grade) for r in ordinal_quality.sample(docs, labels).collect()] == [(1, 1)]
    model = ordinal_quality.fit(docs.limit(0), labels)
    assert not model.weights.any() and ordinal_quality.score(docs.limit(0), model).count() == 0


def test_cut():
    p = np.array([0.1, 0.2, 0.3, 0.6, 0.7, 0.9])
    low = np.array([True, True, False, True, False, False])
    assert ordinal_quality.best_cut(p, low) == pytest.approx(0.25)
    assert ordinal_quality.best_cut(p, low & False) == 0.5
    words, values = next(ordinal_quality.features(pa.array(["x x y"])))
    assert len(words) == 4 and values[-1] == pytest.approx(1 / 3)


@pytest.mark.skipif(not os.path.isdir(BIG), reason="needs the larger tables")
def test_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{BIG}/{n}.parquet") for n in ("documents", "labels"))
    third = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 0
    model = ordinal_quality.fit(docs, labels.where(~third))
    seen = ordinal_quality.score(docs, model).join(labels.where(third), "doc_id").groupBy("toxic").agg(
        F.avg((~F.col("kept")).cast("int")).alias("stopped")
    )
    stopped = {r.toxic: r.stopped for r in seen.collect()}
    assert stopped[1] >= 0.7 and stopped[0] <= 0.015
