import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkcols.llm import grouping, ngram_join


@pytest.mark.parametrize("percent", [80, 90])
def test_similar_sets_share_a_block(percent):
    """Also sets of few items, and pairs whose sizes lie in neighbouring classes."""
    draw = np.random.default_rng(percent)
    for size in [*range(1, 80), *range(110, 140), 255, 256, 257, 600, 1023, 1024]:
        for _ in range(8):
            one = np.unique(draw.integers(0, 1 << 64, size, dtype=np.uint64, endpoint=False))
            apart = ngram_join.most_apart(2 * len(one), percent)
            gone = int(draw.integers(0, apart + 1))
            other = draw.permutation(one)[: max(1, len(one) - gone)]
            more = draw.integers(0, 1 << 64, max(0, int(draw.integers(0, apart + 1)) - gone), dtype=np.uint64)
            other = np.unique(np.concatenate([other, more]))
            both = len(np.intersect1d(one, other))
            if 100 * both >= percent * (len(one) + len(other) - both):
                a, b = ngram_join.block_keys(one, percent), ngram_join.block_keys(other, percent)
                assert len(np.intersect1d(a, b)), (size, gone, len(other))


def test_frequent_shingles_make_no_candidates(spark):
    """400 unlike texts of 12 words: every shingle is in many of them, but of 79,800 pairs few share a block."""
    draw = random.Random(7)
    rows = [(i, " ".join(draw.choices([f"w{j}" for j in range(12)], k=300))) for i in range(400)]
    docs = spark.createDataFrame(rows, "id long, text string")
    posts = ngram_join.postings(docs, docs.select("id"), 3, 90)
    assert posts.select("id").distinct().count() == 400
    assert grouping.all_pairs(grouping.with_roots(grouping.shared(posts), None), 90).count() < 400


def test_shared_keys_come_once(spark):
    rows = [(1, 5, 9, 1), (1, 5, 9, 1), (2, 5, 9, 1), (2, 6, 9, 1), (2, 5, 9, 1), (3, None, 9, 1), (4, 7, 9, 1)]
    got = grouping.shared(spark.createDataFrame(rows, "key long, id long, size long, need int"))
    assert sorted(got.select("key", "id").collect()) == [(2, 5), (2, 6)]


def test_leader_is_what_copies_were_made_of(spark):
    """Item 50 shares all of its ten keys, every copy lacks some of them."""
    rows = [(k, 50) for k in range(10)] + [(k, i) for i in range(8) for k in range(10) if k not in (i, i + 1)]
    posts = spark.createDataFrame(rows, "key long, id long").withColumn("size", F.lit(9)).withColumn("need", F.lit(1))
    assert {r.lead.id for r in grouping.keys_apart(posts, None, 0).collect()} == {50}
