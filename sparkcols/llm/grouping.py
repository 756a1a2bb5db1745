"""Groups of linked items: candidates from shared keys, exact Jaccard checks, distributed union-find."""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkcols.session import free_shuffles, parts_for, release, staged, staged_buckets

#: rounds in which every item is compared with one leader of each of its keys, before the rest is compared pairwise
LEADER_ROUNDS = 1
#: items of a key that are compared pairwise then; keys with more get finer keys
PAIRWISE = 64
#: the same where parities tell most pairs apart within the join
PAIRWISE_PARITY = 2048
#: keys with more items first compare all with about so many leaders, before what is still apart is compared pairwise
CROWD, LEADERS = 256, 16
#: 64-bit words of a parity: 3,072 bits tell sets of up to about fifteen hundred items apart; with more words the
#: method that Spark makes of the join would be too large for the JVM to compile
WORDS = 48


def union_find(links: DataFrame) -> DataFrame:
    """``id``, ``root`` of every item of the links (a, b): the smallest item that it reaches.

    Alternates hooking all larger neighbours to the smallest one with hooking
    all smaller neighbours to it, until every link leads to a root. Each round
    is written to the shared folder, and the round before it deleted; only
    whether one is left to do reaches the driver.
    """
    edges = staged(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        below, above = F.count_if(F.col("v") < F.col("u")), F.count_if(F.col("v") > F.col("u"))
        # written, so that the join with a hub's many links has two plain exchanges, which adaptive execution can split
        least = both.groupBy("u").agg(
            F.least(F.min("v"), F.first("u")).alias("m"), ((below > 1) | ((below > 0) & (above > 0))).alias("open")
        )
        least = staged(least, "least")
        if least.where("open").isEmpty():  # every item is a root or has one link, to a root
            release(least)
            break
        least_of = least.select("u", "m")
        large = both.where("v > u").join(least_of, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        hooked = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, edges = edges, staged(hooked.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "hooks")
        del both, large, small, hooked, least_of
        release(last, least)
    roots = edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
    roots = staged(roots.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()), "roots")
    release(edges)
    return roots


def sample_bound(percent: int) -> int:
    """Hashes below it, as unsigned numbers, make a set's sample: the least power of two of all hashes that tells apart sets
    with nothing in common. If a share s of two equally large sets differs, their similarity is (1 - s) / (1 + s) at most."""
    bits = 1
    while (1 - 2.0 ** -(bits + 1)) / (1 + 2.0 ** -(bits + 1)) < percent / 100:
        bits += 1
    return 1 << (64 - bits)


def likely(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that their sets' samples don't rule out. Exact: what is missing in a sample is missing in the set."""
    side = lambda end, part, size: sets.select(F.col("id").alias(end), F.col("part").alias(part), F.col("size").alias(size))
    found = pairs.join(side("a", "x", "m"), "a").join(side("b", "y", "n"), "b")
    both = F.size(F.array_intersect("x", "y"))
    most = F.least(F.col("m") - F.size("x") + both, F.col("n") - F.size("y") + both)
    return found.where(100 * most >= percent * (F.col("m") + F.col("n") - most)).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their sets.

    ``sets`` is bucketed by id: pairs move to the sets, first to samples of them,
    then what is left to the whole ones.
    """
    rest = staged(likely(pairs, sets, percent), "likely")
    left = sets.select(F.col("id").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    found = rest.join(left, "a").join(right, "b").where(100 * both >= percent * (F.size("x") + F.size("y") - both))
    done = staged(found.select("a", "b"), "found")
    release(rest)
    return done


def parities(rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """``WORDS`` words for each of n sets: in each bit whether an odd number of the set's items falls on it. ``hashes``
    are the items, of the set in ``rows`` each; only their leading bits count."""
    bits = 64 * WORDS
    at = ((hashes >> np.uint64(32)) * np.uint64(bits) >> np.uint64(32)).astype(np.int64)
    odd = (np.bincount(rows.astype(np.int64) * bits + at, minlength=n * bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).reshape(n, WORDS)


def with_words(rest: DataFrame, parity: DataFrame) -> DataFrame:
    """The postings with the parity (id, parity) of each item as columns, which a join's condition reads without a loop."""
    words = (F.coalesce(F.col("parity")[i], F.lit(0)).alias(f"word{i}") for i in range(WORDS))
    return rest.join(parity.select("id", *words), "id")


def parities_near(x: str, y: str, percent: int) -> Column:
    """Whether two sets can be similar enough by their parities. Exact: each item that only one of them holds
    turns one bit, so as many items differ as bits do, or more."""
    words = ((f"{x}.word{i}", f"{y}.word{i}") for i in range(WORDS))
    turned = reduce(add, (F.bit_count(F.col(a).bitwiseXOR(F.col(b))) for a, b in words))
    return (100 + percent) * turned <= (100 - percent) * (F.col(f"{x}.size") + F.col(f"{y}.size"))


def shared(postings: DataFrame) -> DataFrame:
    """The postings of keys with two items or more, each one once; moved once, by key."""
    of_key = Window.partitionBy("key")
    ends = postings.withColumn("lo", F.min("id").over(of_key)).withColumn("hi", F.max("id").over(of_key))
    return ends.where("lo < hi").drop("lo", "hi").dropDuplicates(["key", "id"])


def linked(
    postings: DataFrame, sets_of, percent: int, verify=verified, items_of=lambda sets: sets, parity_of=None
) -> DataFrame:
    """``id``, ``root`` of all items that have a link; others are not listed.

    ``postings`` (key, id, size, need) lists under which keys an item is found;
    two items are candidates if they share at least the smaller ``need`` of
    theirs. ``sets_of(ids, parts)`` gives (id, size, part, items) of a table of
    ids, dealt by id into so many partitions; ``part`` has the items below
    ``sample_bound``. It may give another form of the sets, if ``verify`` compares
    pairs of that form and ``items_of`` makes (id, items) of it. If ``parity_of``
    makes (id, parity) of it, pairs are ruled out by these where they are made.

    A group of n near copies has n * n / 2 candidate pairs but needs n - 1
    links. So each key first compares its items with one leader, and pairs that
    are connected by then are left out: they can't change the result. What is
    still apart after some rounds is compared pairwise in keys of few items; in
    those of many, finer keys (``refined``) take the place of the key. An item that
    no leader is like may be like many of the leader's copies, so keys of more than
    ``CROWD`` items first compare all with about ``LEADERS`` items: one such link
    is enough, and leaves out all its pairs with the rest. No pair is verified twice.
    """
    posts = staged(shared(postings), "postings")
    free_shuffles(posts.sparkSession)
    parts = parts_for(posts)
    sets = staged_buckets(sets_of(posts.select("id").distinct(), parts), "sets", "id", parts)
    most = PAIRWISE_PARITY if parity_of else PAIRWISE
    found, tried, roots, fine, parity = [], [], None, None, None
    for turn in range(LEADER_ROUNDS):
        apart = staged(keys_apart(posts, roots, turn), "apart")
        if not apart.isEmpty():
            roots = add_links(leader_pairs(posts, roots, apart, percent), sets, percent, verify, tried, found, roots)
        release(apart)
    apart = staged(keys_apart(posts, roots, 0), "apart")  # with the leaders of the first round
    if not apart.where(F.col("n") > most).isEmpty():
        fine = staged(refined(posts, roots, apart, sets, percent, items_of, most), "refined")
        finer = staged(keys_apart(fine, roots, LEADER_ROUNDS), "apart")
        roots = add_links(leader_pairs(fine, roots, finer, percent), sets, percent, verify, tried, found, roots)
        release(finer)
    if not apart.isEmpty():
        few = posts.join(apart.where(F.col("n") <= most).select("key"), "key", "left_semi")
        rest = few if fine is None else few.unionByName(fine)
        if parity_of:
            parity = staged(parity_of(sets.join(rest.select("id").distinct(), "id", "left_semi")), "parity")
        if fine is not None or not apart.where(F.col("n") > CROWD).isEmpty():
            crowd = staged(crowded(rest, roots), "crowded")
            if not crowd.isEmpty():
                first = all_pairs(with_roots(rest, roots), percent, parity, crowd)
                roots = add_links(first, sets, percent, verify, tried, found, roots)
            release(crowd)
        roots = add_links(all_pairs(with_roots(rest, roots), percent, parity), sets, percent, verify, tried, found, roots)
    if roots is None:
        roots = posts.select("id", F.col("id").alias("root")).where("false")
        roots = staged(roots, "roots")
    release(apart, posts, sets, fine, parity, *found, *tried)
    return roots


def add_links(pairs, sets, percent, verify, tried, found, roots) -> DataFrame | None:
    """The roots after these pairs are verified, but for those tried before; both lists grow."""
    pairs = staged(untried(pairs, tried), "pairs")
    tried.append(pairs)
    links = verify(pairs, sets, percent)
    if links.isEmpty():
        release(links)
        return roots
    found.append(links)
    free_shuffles(sets.sparkSession)
    grown = union_find(reduce(DataFrame.unionByName, found))
    release(roots)
    return grown


def with_roots(posts: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The postings with the ``root`` of each item: the item itself before it has a link."""
    if roots is None:
        return posts.withColumn("root", F.col("id"))
    return posts.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))


def keys_apart(posts: DataFrame, roots: DataFrame | None, turn: int) -> DataFrame:
    """(key, n, lead): the keys whose items aren't connected yet, the number of their items and one of them.

    First that's the item with most keys in common with others: what a group was copied from
    shares all its keys, a copy only those that its changes left, so most copies are linked to it.
    """
    items = with_roots(posts, roots)
    order = [F.xxhash64("id", F.lit(turn)).alias("h")]
    if not turn:
        items = items.join(posts.groupBy("id").agg((-F.count("*")).alias("common")), "id")
        order = [F.col("common"), *order]
    lead = F.min(F.struct(*order, "id", "size", "root")).alias("lead")
    ends = [F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"), lead]
    return items.groupBy("key").agg(*ends).where("lo <> hi").select("key", "n", "lead")


def leader_pairs(posts: DataFrame, roots: DataFrame | None, apart: DataFrame, percent: int) -> DataFrame:
    """(a, b): every item with the leader of each of its keys, if they aren't connected yet."""
    near = (F.col("root") != F.col("lead.root")) & close(F.col("size"), F.col("lead.size"), percent)
    found = with_roots(posts, roots).join(apart, "key").where(near)
    return found.select(F.least("id", "lead.id").alias("a"), F.greatest("id", "lead.id").alias("b")).distinct()


def crowded(posts: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(key, n): the keys of more than ``CROWD`` items that aren't connected yet, and the number of their items."""
    ends = [F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")]
    keys = with_roots(posts, roots).groupBy("key").agg(*ends)
    return keys.where((F.col("lo") < F.col("hi")) & (F.col("n") > CROWD)).select("key", "n")


def all_pairs(rest: DataFrame, percent: int, parity: DataFrame | None = None, crowd: DataFrame | None = None) -> DataFrame:
    """(a, b): the items of each key that aren't connected yet, pairwise, if they share as many keys as they need
    and their parities, if given, don't rule them out. With ``crowd`` (key, n) only the items of its keys, each with
    about ``LEADERS`` of its key: as many rows a key as it has items, times that at most."""
    if parity is not None:
        rest = with_words(rest, parity)
    x, y = rest.alias("x"), rest.alias("y")
    other = F.col("x.id") < F.col("y.id")
    if crowd is not None:
        # by hashes of both, so that an item is a leader in some of its keys only
        y = rest.join(crowd, "key").where(F.pmod(F.xxhash64("id", "key"), F.col("n")) < LEADERS).drop("n").alias("y")
        other = F.col("x.id") != F.col("y.id")
    same = (F.col("x.key") == F.col("y.key")) & other & (F.col("x.root") != F.col("y.root"))
    near = close(F.col("x.size"), F.col("y.size"), percent)
    if parity is not None:
        near &= parities_near("x", "y", percent)
    a, b = F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")
    return (
        x.join(y, same & near)
        .groupBy(a, b)
        .agg(F.count("*").alias("n"), F.min(F.least("x.need", "y.need")).alias("need"))
        .where("n >= need")
        .select("a", "b")
    )


def untried(pairs: DataFrame, tried: list[DataFrame]) -> DataFrame:
    """The pairs that no round has verified yet."""
    return pairs.join(reduce(DataFrame.unionByName, tried), ["a", "b"], "left_anti") if tried else pairs


def refined(
    posts: DataFrame,
    roots: DataFrame | None,
    apart: DataFrame,
    sets: DataFrame,
    percent: int,
    items_of=lambda sets: sets,
    most: int = PAIRWISE,
) -> DataFrame:
    """Finer postings (key, id, size, need) for keys with more than ``most`` items.

    Keys with one leader are one group. In it an item stands for the set D of
    what it holds beyond the leader or lacks of it. Similar items differ in k at
    most, and so do their Ds: the least common element of two Ds, in any order
    that is the same for both, is one of the first k + 1. Here those come first
    that fewest Ds of the group hold, so that unlike items rarely share one, nor
    do copies that were changed in different places. It's exact: the leader has
    been compared with all, so of two items that aren't connected one is further
    from it than k, and their Ds have at least one element in common, or the more
    (``least``) the larger they are; the first |D| - least + 1 are enough then.
    """
    keys = apart.where(F.col("n") > most).select("key", "lead")
    place = [F.col("lead.id").alias("group"), (F.col("root") == F.col("lead.root")).alias("near")]
    large = with_roots(posts, roots).join(keys, "key").select(*place, "id", "size").dropDuplicates(["group", "id"])
    ids = large.select("id").unionByName(large.select(F.col("group").alias("id"))).distinct()
    items = items_of(sets.join(ids, "id", "left_semi")).select("id", "items")
    leads = items.select(F.col("id").alias("group"), F.col("items").alias("of_lead"))
    both = large.join(items, "id").join(leads.join(large.select("group").distinct(), "group", "left_semi"), "group")
    differ = F.concat(F.array_except("items", "of_lead"), F.array_except("of_lead", "items"))
    own, lead, many = F.size("items"), F.size("of_lead"), F.size("differ")
    share = (100 - percent) / (100 + percent)
    least = F.when(F.col("near"), many + share * (lead - own)).otherwise(F.greatest(F.lit(1), many - share * (lead + own))) / 2
    least = F.greatest(F.lit(1), F.ceil(least - 1e-6))
    apart_at_most = F.floor(share * (own + F.floor(own * 100 / percent + 1e-6)) + 1e-6)
    width = F.least(apart_at_most, many - least) + 1
    held = both.withColumn("differ", differ).select("group", "id", "size", many.alias("n"), width.alias("width"), F.explode("differ").alias("item"))
    often = held.groupBy("group", "item").agg(F.count("*").alias("often")).where("often > 1")
    first = F.sort_array(F.collect_list(F.struct("often", "item")))
    # elements of one D only come before all others, but make no pair: they need only be counted
    ranked = held.join(often, ["group", "item"]).groupBy("group", "id", "size", "n", "width").agg(first.alias("ranked"))
    taken = F.slice("ranked", F.lit(1), F.greatest(F.col("width") - (F.col("n") - F.size("ranked")), F.lit(0)).cast("int"))
    return ranked.select("group", "id", "size", F.explode(taken).alias("at")).select(
        F.xxhash64("group", "at.item").alias("key"), "id", "size", F.lit(1).alias("need")
    )


def close(a, b, percent: int):
    """Whether sets of these sizes can be similar enough."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)
