import numpy as np
from pyspark.sql import functions as F

from sparkcols.llm import grouping, line_dedup, ngram_join


def near_copies(n):
    """Lines of 60 words: copies that keep 40 words of the first one each, every tenth of them with a near copy of itself."""
    words = [f"word{i:02d}" for i in range(60)]
    lines = [" ".join(words)]
    for i in range(n):
        own = [w if (j * 7 + i) % 3 else f"own{i}x{j}" for j, w in enumerate(words)]
        lines.append(" ".join(own))
        if i % 10 == 0:
            lines.append(" ".join([*own[:-2], f"other{i}"]))
    return lines


def shingles(line):
    return {line[i : i + 8] for i in range(max(1, len(line) - 7))}


def test_parities_never_rule_out_a_link():
    draw = np.random.default_rng(4)
    sets = []
    for _ in range(60):
        base = draw.integers(0, 1 << 63, int(draw.integers(1, 3000)), dtype=np.uint64)
        swaps = base.copy()
        many = int(len(base) * draw.uniform(0, 0.25))
        swaps[:many] = draw.integers(0, 1 << 63, many, dtype=np.uint64)
        sets += [np.unique(base), np.unique(swaps)]
    rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    words = grouping.parities(rows, np.concatenate(sets), len(sets)).view(np.uint64)
    apart = 0
    for i in range(0, len(sets), 2):
        x, y = sets[i], sets[i + 1]
        turned = int(np.bitwise_count(words[i] ^ words[i + 1]).sum())
        assert turned <= len(np.setxor1d(x, y))
        if 180 * turned > 20 * (len(x) + len(y)):
            both = len(np.intersect1d(x, y))
            assert 100 * both < 80 * (len(x) + len(y) - both)
            apart += 1
    assert apart > 5


def test_pairs_of_a_large_group_are_told_apart_where_they_are_made(spark):
    """300 lines under one key that are like none but their own copy: no other pair leaves the join."""
    lines = near_copies(300)
    texts = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    sizes = spark.createDataFrame([(i, len(shingles(x))) for i, x in enumerate(lines)], "id long, size long")
    rest = sizes.select(F.lit(1).alias("key"), "id", "size", F.lit(1).alias("need"), F.col("id").alias("root"))
    pairs = grouping.all_pairs(rest, 80, line_dedup.line_parities(texts)).collect()
    sets = [shingles(x) for x in lines]
    want = {(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert {(r.b, r.a) for r in pairs} >= want and len(want) >= 30
    assert len(pairs) < 2 * len(want) < grouping.all_pairs(rest, 80).count() / 100


def test_lines_of_a_large_group_keep_their_links(spark):
    """Through the operator, with all keys pairwise and with finer keys for those of many items."""
    lines = near_copies(120)
    sets = [shingles(x) for x in lines]
    linked = {a for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    held = grouping.PAIRWISE_PARITY
    try:
        for most in (held, 4):
            grouping.PAIRWISE_PARITY = most
            assert {r.doc for r in line_dedup.lost_lines(docs).collect()} == linked
    finally:
        grouping.PAIRWISE_PARITY = held


def test_pairs_of_many_unlike_documents_are_told_apart(spark):
    """300 documents that share 80 of 100 words: under one key no pair of them leaves the join but near copies do."""
    common = [f"common{i}" for i in range(80)]
    texts = [" ".join([*common, *(f"own{i}x{j}" for j in range(20))]) for i in range(300)]
    texts.append(texts[0] + " more")
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    held = ngram_join.sets(docs, docs.select("id"), 4, 3, 90)
    rest = held.select(F.lit(1).alias("key"), "id", "size", F.lit(1).alias("need"), F.col("id").alias("root"))
    pairs = grouping.all_pairs(rest, 90, ngram_join.set_parities(held)).collect()
    assert [tuple(r) for r in pairs] == [(0, 300)] and grouping.all_pairs(rest, 90).count() == 301 * 300 // 2
