import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkcols.llm import near_vectors


def ranked(spark, vectors, every=20, copies=1):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] * copies
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in near_vectors.search(df, F.col("vec_id") % every == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    return got


@pytest.mark.parametrize("kind", ["one long", "log-normal"])
def test_lengths_do_not_cost_neighbours(spark, kind):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "one long":
        x[1] *= 100
    else:
        x *= rng.lognormal(size=(4000, 1))
    x = x.astype(np.float32)
    got = ranked(spark, x)
    assert len(got) == 200 and all(len(v) == 20 for v in got.values())
    hits = 0
    for q, found in got.items():
        score = x.astype(float) @ x[q].astype(float)
        score[q] = -np.inf
        hits += len(set(np.argsort(-score)[:20]) & set(found))
    assert hits >= 0.9 * 4000


def test_few_rows_and_repeated_rows_give_all(spark):
    x = np.random.default_rng(6).normal(size=(21, 64)).astype(np.float32)
    for copies in (1, 25):
        got = ranked(spark, x, 20, copies)
        assert {q: sorted(v) for q, v in got.items()} == {q: [i for i in range(21) if i != q] for q in (0, 20)}
