"""The manifest against trees built by hand."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from sparkcols.llm import merkle, plans

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in FIELDS))


def tree(digests):
    """Root, and for each leaf its levels as (left sibling, right sibling)."""
    ways, places, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        for i, p in enumerate(places):
            ways[i].append((level[p - 1] if p % 2 else "", level[p + 1] if p % 2 == 0 and p + 1 < len(level) else ""))
        level = [h(*level[i : i + 2]) for i in range(0, len(level), 2)]
        places = [p // 2 for p in places]
    return level[0], ways


def by_hand(rows):
    if not rows:
        return []
    groups = {}
    for r in rows:
        groups.setdefault("" if r["lang"] is None else "=" + r["lang"], []).append(r)
    names, out, subroots, inside = sorted(groups, key=str.encode), [], [], []
    for name in names:
        own = sorted(groups[name], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        root, ways = tree([leaf_of(r) for r in own])
        subroots.append(root)
        inside.append(list(zip(own, ways)))
    root, upper = tree(subroots)
    for subroot, own, top in zip(subroots, inside, upper):
        for row, way in own:
            at = dict(row)
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0 and row["n_chars"] is not None:
                at["n_chars"] += 1
            folded = leaf_of(at)
            for left, right in way + top:
                folded = h(left, folded, right)
            proof = h(*(x + y for x, y in way + top))
            out.append((row["doc_id"], leaf_of(row), subroot, root, proof, folded, folded == root))
    return sorted(out, key=repr)


def check(spark, rows):
    df = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], SCHEMA)
    more = F.coalesce(F.try_add(F.col("n_chars"), F.lit(1)), F.col("n_chars"))
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, merkle.leaf(df, FIELDS, n_chars=more))
    # columns whose names the operator uses itself
    clash = df.withColumns({c: F.lit(1) for c in ("group", "key", "place", "tree", "_part", "_place", "leaves", "kept")})
    done = merkle.checked(merkle.manifest(clash, merkle.leaf(df, FIELDS), found=tampered), F.col("found"))
    assert sorted((tuple(r) for r in done.collect()), key=repr) == by_hand(rows)


def row(i, lang="en", text="t", n=3, source="s"):
    return {"doc_id": i, "text": text, "lang": lang, "source": source, "n_chars": n}


@pytest.mark.parametrize("many", [1, 2, 3, 8, 9, 33])
def test_one_group(spark, many):
    check(spark, [row(i * 3) for i in range(many)])


def test_many_groups_nulls_ties_and_repeats(spark):
    rows = [row(i, ["en", None, "", "é", "z", "en"][i % 6], text=[None, "", "añb" * 9, "x\ny"][i % 4], n=[None, i][i % 2]) for i in range(61)]
    rows += [row(5, "en"), row(5, "en"), row(5, "en", "other"), row(None, "en"), row(None, None), row(None, None)]
    rows += [row(100 + i, "en", source=None) for i in range(70)]  # one group with most rows
    check(spark, rows)


def test_small_blocks_and_far_ancestors(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", 2)
    monkeypatch.setattr(merkle, "PLACE_BITS", 1)
    check(spark, [row(i, "en" if i % 3 else f"l{i}") for i in range(120)])


def test_empty_table(spark):
    check(spark, [])


def test_query(spark, sf_dir):
    rows = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    done = plans.op11_merkle_manifest(spark, sf_dir)
    assert sorted((tuple(r) for r in done.collect()), key=repr) == by_hand(rows)


def test_query_equals_sql(spark, sf_dir):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS FROM '{sf_dir}/documents.parquet'")
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    wanted = c.execute(f"SELECT {', '.join(columns)} FROM ({merkle.manifest_sql()})").fetchall()
    done = plans.op11_merkle_manifest(spark, sf_dir).select(*columns)
    assert sorted(map(tuple, done.collect())) == sorted(wanted)
