"""Merkle dataset manifest: binary hash trees per group under one root, with proofs by pointer jumping.

The leaves of a group stand in the order of their key. Trees are built in
blocks of 2**BLOCK_LEVELS nodes, so that a table of 10**11 rows needs four
groupings. Every node of a tree first holds one segment: its sibling on the way
to its parent. A self-join appends the segment of the ancestor that a node's
segment leads to, which doubles the distance; nodes that no later round starts
from are left out, so few but leaves are moved. A join's key is a block of
neighbouring nodes, and an ancestor is repeated for each block below it: no key
ever holds more than 2**PLACE_BITS rows, however many leaves an ancestor has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcols.operators.joins import lookup_join
from sparkcols.operators.ordering import with_row_number
from sparkcols.session import release, staged

#: levels of a tree that one grouping builds, and bits of a node's place within a join key
BLOCK_LEVELS, PLACE_BITS = 10, 12
#: a segment's entry: on which side the sibling stands (none: the node was alone), then its 32 bytes
LEFT, RIGHT, ALONE, ENTRY = b"L", b"R", b"-", 33


def hashed(*parts: Column) -> Column:
    """Lowercase hex sha256 of the concatenated texts."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value of a leaf: ``-`` if null, else its number of UTF-8 bytes, ``:``, the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(df: DataFrame, fields: list[str], **changed: Column) -> Column:
    """The digest of a row's fields, some of them replaced."""
    return hashed(*(field(changed.get(c, F.col(c))) for c in fields))


def height(leaves: Column) -> Column:
    """How often so many nodes are halved, rounding up, until one is left."""
    # the number of binary digits of leaves - 1; exact, unlike a logarithm
    return F.when(leaves <= 1, 0).otherwise(F.length(F.bin(leaves - 1))).cast("int")


def entry(row: Column, place: Column) -> Column:
    """The segment of the node at a place of its level."""
    sibling = lambda at: F.unhex(F.get(row, at))
    return (
        F.when(place % 2 == 1, F.concat(F.lit(LEFT), sibling(place - 1)))
        .when(place + 1 < F.size(row), F.concat(F.lit(RIGHT), sibling(place + 1)))
        .otherwise(F.lit(ALONE + bytes(32)))
    )


def blocks_of(nodes: DataFrame, base: int) -> DataFrame:
    """One row for each block of nodes of level ``base``: its ``top`` and the segments of all ``nodes`` below that.

    ``nodes`` is (tree, height, idx, digest). A block's levels end at its tree's root.
    """

    def above(row: Column) -> Column:
        last = F.floor((F.size(row) - 1) / 2).cast("int")
        return F.transform(
            F.sequence(F.lit(0), last), lambda i: hashed(F.get(row, 2 * i), F.coalesce(F.get(row, 2 * i + 1), F.lit("")))
        )

    grouped = nodes.groupBy("tree", "height", F.shiftright("idx", BLOCK_LEVELS).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("items")
    )
    steps = F.least(F.lit(BLOCK_LEVELS), F.col("height") - base)
    turns = F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))
    levels = F.aggregate(
        turns,
        F.array(F.transform("items", lambda x: x["digest"])),
        lambda levels, _: F.concat(levels, F.array(above(F.element_at(levels, -1)))),
    )

    def segments(levels: Column) -> Column:
        of_level = lambda row, level: F.transform(
            row, lambda _, place: F.struct(level.alias("level"), place.alias("place"), entry(row, place).alias("segment"))
        )
        below = F.flatten(F.transform(F.slice(levels, 1, F.size(levels) - 1), of_level))
        return F.struct(F.element_at(F.element_at(levels, -1), 1).alias("top"), below.alias("nodes"))

    # named by a lambda, the levels are built once, however the optimizer joins projections
    built = F.transform(F.array(levels), segments)[0]
    return grouped.select("tree", "height", "block", F.lit(base).alias("base"), F.inline(F.array(built)))


def build(nodes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """Staged blocks of all levels, and (tree, digest) of all roots. ``most`` is the greatest height."""
    found, roots, base = [], [], 0
    while True:
        found.append(staged(blocks_of(nodes, base), "blocks"))
        tops = found[-1].select("tree", "height", F.col("block").alias("idx"), F.col("top").alias("digest"))
        base += BLOCK_LEVELS
        roots.append(tops.where(F.col("height") <= base).select("tree", "digest"))
        if most <= base:
            return found, reduce(DataFrame.unionByName, roots)
        nodes = tops.where(F.col("height") > base)


def first_segments(blocks: list[DataFrame]) -> DataFrame:
    """(tree, level, idx, segment): every node below its tree's root with the way to its parent."""
    rows = reduce(DataFrame.unionByName, blocks).select("tree", "block", "base", F.inline("nodes"))
    idx = F.expr("shiftleft(block, cast(%d - level as int)) + place" % BLOCK_LEVELS)
    return rows.select("tree", (F.col("base") + F.col("level")).cast("int").alias("level"), idx.alias("idx"), "segment")


def to_root(nodes: DataFrame, most: int) -> DataFrame:
    """(tree, idx, segment): every leaf with its whole way, by pointer jumping over staged tables."""
    distance, held = 1, None
    while distance < most:
        turn = F.col("level") % (2 * distance)
        far = max(0, distance - PLACE_BITS)
        blocks = F.expr(f"sequence(shiftleft(idx, {far}), shiftleft(idx + 1, {far}) - 1)") if far else F.array("idx")
        ancestors = nodes.where(turn == distance).select(
            "tree", (F.col("level") - distance).alias("level"), F.explode(blocks).alias("block"), F.col("segment").alias("rest")
        )
        starts = nodes.where(turn == 0).withColumn("block", F.shiftright("idx", min(distance, PLACE_BITS)))
        joined = starts.join(ancestors, ["tree", "level", "block"], "left")
        way = F.when(F.col("rest").isNull(), F.col("segment")).otherwise(F.concat("segment", "rest"))
        nodes = staged(joined.select("tree", "level", "idx", way.alias("segment")), "ways")
        release(held)
        held, distance = nodes, 2 * distance
    return nodes.where("level = 0").select("tree", "idx", "segment")


def entries(segment: Column) -> Column:
    """Positions 0, 1, ... of a segment's entries."""
    many = F.floor(F.length(segment) / ENTRY).cast("int")
    return F.when(many > 0, F.sequence(F.lit(0), many - 1)).otherwise(F.array().cast("array<int>"))


def side(segment: Column, i: Column) -> Column:
    return F.substring(segment, i * ENTRY + 1, F.lit(1))


def sibling(segment: Column, i: Column) -> Column:
    return F.lower(F.hex(F.substring(segment, i * ENTRY + 2, F.lit(ENTRY - 1))))


def folded(start: Column, segment: Column) -> Column:
    """The root that a leaf's digest leads to with the siblings of a segment."""
    return F.aggregate(
        entries(segment),
        start,
        lambda at, i: F.when(side(segment, i) == F.lit(LEFT), hashed(sibling(segment, i), at))
        .when(side(segment, i) == F.lit(RIGHT), hashed(at, sibling(segment, i)))
        .otherwise(hashed(at)),
    )


def siblings(segment: Column) -> Column:
    """The digests of a segment as one text, level by level."""
    of = lambda i: F.when(side(segment, i) == F.lit(ALONE), F.lit("")).otherwise(sibling(segment, i))
    return F.array_join(F.transform(entries(segment), of), "")


def manifest(df: DataFrame, leaf_digest: Column, group: str = "lang", key: str = "doc_id", **kept: Column) -> DataFrame:
    """One row per row of ``df``: key, ``leaf``, ``subroot``, ``root``, ``proof`` and the columns of ``kept``.

    Groups stand in the byte order of their names, null first; in a group, leaves
    stand by key (null first), then by digest. Equal rows are leaves of their
    own. ``proof`` is the way to the root as entries of 33 bytes (see ``folded``
    and ``siblings``); a table with one leaf has an empty one. An empty table
    gives no rows. Other columns are not looked at; only digests are shuffled.
    """
    rows = staged(
        df.select(
            F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("group"),
            F.col(key).alias("key"),
            leaf_digest.alias("leaf"),
            F.monotonically_increasing_id().alias("tie"),
            F.struct(F.lit(0).alias("_"), *(c.alias(n) for n, c in kept.items())).alias("kept"),
        ),
        "leaves",
    )
    ranked = with_row_number(rows, ["group", "key", "leaf", "tie"], "place")
    groups = staged(ranked.groupBy("group").agg(F.min("place").alias("first"), F.count("*").alias("leaves")), "groups")
    trees = staged(with_row_number(groups, ["group"], "tree").withColumn("height", height(F.col("leaves"))), "trees")
    placed = staged(
        lookup_join(ranked, trees.select("group", "first", "tree", "height"), "group", "inner").select(
            "tree", "height", (F.col("place") - F.col("first")).alias("idx"), "key", "leaf", "kept"
        ),
        "placed",
    )
    release(rows, groups)
    size = trees.agg(F.max("height"), F.count("*")).first()
    most, many = size[0] or 0, size[1]

    blocks, subroots = build(placed.select("tree", "height", "idx", F.col("leaf").alias("digest")), most)
    subroots = staged(subroots, "subroots")
    upper_height = max(0, many - 1).bit_length()
    upper, root = build(
        subroots.select(
            F.lit(0).cast("long").alias("tree"), F.lit(upper_height).alias("height"), (F.col("tree") - 1).alias("idx"), "digest"
        ),
        upper_height,
    )
    root = root.select("digest").first()
    ways = to_root(first_segments(blocks), most)
    tops = to_root(first_segments(upper), upper_height).select((F.col("idx") + 1).alias("tree"), F.col("segment").alias("top_way"))
    tops = staged(subroots.withColumnRenamed("digest", "subroot").join(tops, "tree", "left"), "tops")
    inside = placed.join(ways, ["tree", "idx"], "left")
    way = F.concat(*(F.coalesce(c, F.lit(b"")) for c in ("segment", "top_way")))
    return lookup_join(inside, tops, "tree", "inner").select(
        F.col("key").alias(key),
        "leaf",
        "subroot",
        F.lit(root[0] if root else None).cast("string").alias("root"),
        way.alias("proof"),
        *(F.col("kept")[n].alias(n) for n in kept),
    )


def checked(proofs: DataFrame, found: Column, key: str = "doc_id") -> DataFrame:
    """The registered query's columns: every proof folded from the leaf ``found``, null for the leaf itself."""
    done = proofs.select(
        key, "leaf", "subroot", "root",
        F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"),
        folded(F.coalesce(found, F.col("leaf")), F.col("proof")).alias("folded_root"),
    )
    return done.withColumn("verified", F.col("folded_root") == F.col("root"))


def manifest_sql(table: str = "documents") -> str:
    """SQL twin of the registered query; it makes the checksum's table of bytes by eight bit steps each."""
    field_sql = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR) END"
    digest = lambda n: "sha256(" + " || ".join(field_sql(x) for x in ("doc_id", "source", "lang", n, "text")) + ")"
    codes = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: xor(c >> 8, list_extract(t, CAST((xor(c, b) & 255) + 1 AS BIGINT)))), 4294967295)"
    one = "list_reduce([{}, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"""
    WITH RECURSIVE crc_table AS (SELECT list({one.format('i')} ORDER BY i) AS t FROM range(256) AS r(i)),
    leaves AS (SELECT doc_id, coalesce('=' || lang, '') AS grp, {digest('n_chars')} AS leaf,
        CASE WHEN {crc} % 7 = 0 THEN {digest('(n_chars + 1)')} END AS changed FROM {table}, crc_table),
    placed AS (SELECT *, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY grp) AS m FROM leaves
        WINDOW w AS (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf)),
    nodes AS (SELECT grp, 0 AS level, idx, m, leaf AS d FROM placed
        UNION ALL SELECT grp, level + 1, idx // 2, (m + 1) // 2, sha256(string_agg(d, '' ORDER BY idx)) FROM nodes WHERE m > 1
        GROUP BY grp, level, idx // 2, m),
    tops AS (SELECT grp, d AS subroot, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS m FROM nodes WHERE m = 1),
    upper AS (SELECT 0 AS level, idx, m, subroot AS d FROM tops
        UNION ALL SELECT level + 1, idx // 2, (m + 1) // 2, sha256(string_agg(d, '' ORDER BY idx)) FROM upper WHERE m > 1
        GROUP BY level, idx // 2, m),
    ways AS (SELECT p.doc_id, p.leaf, p.idx AS leaf_idx, p.grp, n.level, p.idx >> n.level AS idx, s.d AS sibling
        FROM placed p JOIN (SELECT DISTINCT grp, level FROM nodes WHERE m > 1) n ON n.grp = p.grp
        LEFT JOIN nodes s ON s.grp = p.grp AND s.level = n.level AND s.idx = xor(p.idx >> n.level, 1)
        UNION ALL SELECT p.doc_id, p.leaf, p.idx AS leaf_idx, p.grp, 1000 + n.level, t.idx >> n.level, s.d
        FROM placed p JOIN tops t ON t.grp = p.grp JOIN (SELECT DISTINCT level FROM upper WHERE m > 1) n ON true
        LEFT JOIN upper s ON s.level = n.level AND s.idx = xor(t.idx >> n.level, 1)),
    lists AS (SELECT grp, leaf_idx, list({{'odd': idx & 1, 's': coalesce(sibling, '')}} ORDER BY level) AS way FROM ways GROUP BY grp, leaf_idx)
    SELECT p.doc_id, p.leaf, t.subroot, r.d AS root,
      sha256(coalesce(array_to_string(list_transform(way, lambda x: x.s), ''), '')) AS proof_sha256,
      list_reduce(list_prepend({{'odd': 0, 's': coalesce(p.changed, p.leaf)}}, coalesce(way, [])),
        lambda a, x: {{'odd': 0, 's': CASE WHEN x.odd = 1 THEN sha256(x.s || a.s) ELSE sha256(a.s || x.s) END}}).s AS folded_root,
      folded_root = root AS verified
    FROM placed p JOIN tops t USING (grp) CROSS JOIN (SELECT d FROM upper WHERE m = 1) r
    LEFT JOIN lists l ON l.grp = p.grp AND l.leaf_idx = p.idx"""
