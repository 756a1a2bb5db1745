from pyspark.sql import functions as F

from sparkcols.llm import grouping
from sparkcols.llm.grouping import linked, refined, sample_bound


def unlike_sets(n):
    """Sets that share 60 of 100 items with all others; every tenth one also has a near copy of itself."""
    sets = {}
    for i in range(n):
        own = list(range(1000 + 100 * i, 1040 + 100 * i))
        sets[i] = list(range(60)) + own
        if i % 10 == 0:
            sets[n + i] = list(range(60)) + own[:35] + [-1 - i]
    return sets


def tables(spark, sets, key="long"):
    rows = [(i, len(x), x) for i, x in sets.items()]
    held = spark.createDataFrame(rows, "id long, size long, items array<long>")
    held = held.select("id", "size", F.transform("items", lambda x: F.xxhash64(x)).alias("items"))
    # samples hold the hashes below the bound, as unsigned numbers
    held = held.withColumn("part", F.filter("items", lambda x: (x >= 0) & (x < F.lit(sample_bound(80)))))
    posts = held.select(F.lit(7).cast("long").alias("key"), "id", "size", F.lit(1).alias("need"))
    return posts, held.select("id", "size", "part", "items")


def by_brute_force(sets):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            x, y = set(sets[a]), set(sets[b])
            if a < b and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: find(i) for i in sets}


def test_one_key_of_many_unlike_items(spark):
    """Links that no leader finds come from finer keys; unlike sets share none of these."""
    sets = unlike_sets(200)
    posts, held = tables(spark, sets)
    got = linked(posts, lambda ids, parts: held.join(ids, "id", "left_semi").repartition(parts, "id"), 80)
    roots = {r.id: r.root for r in got.collect()}
    want = by_brute_force(sets)
    assert {i: roots.get(i, i) for i in sets} == want and len(set(want.values())) == 200


def test_finer_keys_are_few(spark):
    """10,000 unlike items under one key: the finer postings name only the items of near copies."""
    sets = unlike_sets(10_000)
    posts, held = tables(spark, sets)
    apart = grouping.keys_apart(posts, None, 0)
    fine = refined(posts, None, apart, held, 80)
    sizes = [r["count"] for r in fine.groupBy("key").count().collect()]
    assert sizes and max(sizes) == 2 and fine.select("id").distinct().count() == 2_000


def test_keys_of_few_items_are_left_as_they_are(spark):
    posts, held = tables(spark, unlike_sets(20))
    assert refined(posts, None, grouping.keys_apart(posts, None, 0), held, 80).isEmpty()
