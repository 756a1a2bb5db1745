"""Dictionary encoding and joins, each on the broadcast path and on the shuffle path."""

import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from sparkcols.operators import columns as cols, dictionary, joins, storage
from sparkcols.sources.tables import named_table


@pytest.fixture(scope="module")
def words(spark):
    """A third of the rows hold one word, a tenth hold none."""
    word = (
        F.when(F.col("id") % 10 == 9, None)
        .when(F.col("id") % 3 == 0, F.lit("hot"))
        .otherwise(F.concat(F.lit("w"), (F.col("id") % 700).cast("string")))
    )
    return spark.range(6_000).select("id", word.alias("word"))


def same(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


@pytest.fixture(scope="module", params=[64 * 1024**2, 0], ids=["broadcast", "shuffle"])
def limit(request):
    return request.param


def test_encode_then_decode_is_the_input(words, limit):
    codes, entries = dictionary.dict_encode(words, "word", limit)
    assert codes.columns == ["id", "code"] and dict(codes.dtypes)["code"] == "int"
    assert same(dictionary.dict_decode(codes, entries, limit), words)


def test_codes_are_dense_and_keep_the_order(words):
    rows = dictionary.build_dictionary(words, "word").orderBy("code").collect()
    assert [r.code for r in rows] == list(range(1, len(rows) + 1))
    assert [r.word for r in rows] == sorted(r.word for r in rows)


def test_filter_on_the_dictionary_equals_the_plain_filter(words, limit):
    codes, entries = dictionary.dict_encode(words, "word", limit)
    for predicate in (F.col("word").like("w%_1"), F.col("word") == "hot", F.col("word").isin("w1", "none")):
        for ranges in (1000, 256, 7, 1):
            kept = dictionary.dict_filter(codes, entries, predicate, limit, ranges)
            assert same(kept.select("id"), words.where(predicate).select("id"))


def test_group_on_codes_equals_group_on_values(words):
    counts = dictionary.dict_group_count(*dictionary.dict_encode(words, "word"))
    assert same(counts, words.groupBy("word").agg(F.count("*").alias("n")))


def test_empty_and_all_null_columns(spark, limit):
    for rows in ([], [(1, None)]):
        df = spark.createDataFrame(rows, "id long, word string")
        codes, entries = dictionary.dict_encode(df, "word", limit)
        assert entries.count() == 0
        assert same(dictionary.dict_decode(codes, entries, limit), df)


def test_no_hot_key_at_all(spark, limit):
    df = spark.range(500).select("id", F.concat(F.lit("w"), F.col("id").cast("string")).alias("word"))
    codes, entries = dictionary.dict_encode(df, "word", limit)
    assert entries.count() == 500
    assert same(dictionary.dict_decode(codes, entries, limit), df)


def test_keys_of_two_columns(spark, limit):
    df = spark.range(900).select("id", (F.col("id") % 3).alias("a"), F.when(F.col("id") % 7 != 0, F.col("id") % 2).alias("b"))
    lookup = df.dropna().groupBy("a", "b").agg(F.max("id").alias("last")).where("a < 2")
    for how in ("left", "inner"):
        assert same(joins.lookup_join(df, lookup, ["a", "b"], how, limit).select("id", "last"),
                    df.join(lookup, ["a", "b"], how).select("id", "last"))


def test_the_name_code_is_reserved(spark):
    with pytest.raises(ValueError):
        dictionary.dict_encode(spark.createDataFrame([("a", 1)], "word string, code int"), "word")


def test_lookup_join_equals_a_plain_join(words, limit):
    lookup = words.where("word IS NOT NULL AND word <> 'w5'").groupBy("word").agg(F.max("id").alias("last"))
    for how in ("left", "inner"):
        assert same(joins.lookup_join(words, lookup, "word", how, limit).select("id", "word", "last"),
                    words.join(lookup, "word", how).select("id", "word", "last"))
    semi = joins.lookup_join(words, lookup.select("word"), "word", "left_semi", limit)
    assert same(semi.select("id"), words.join(lookup, "word", "left_semi").select("id"))


def test_rows_of_a_hot_key_are_dealt_over_tasks(spark, words):
    """A third of the rows share a key: only its lookup row is repeated, and no task gets all of its rows."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lookup = words.where("word IS NOT NULL").groupBy("word").agg(F.max("id").alias("last"))
        pieces = joins._pieces(joins.key_counts(words, ["word"]), ["word"], 100).collect()
        hot = words.where("word = 'hot'").count()
        assert [r["_pieces"] for r in pieces] == [-(-hot // 100)]
        for how in ("left", "inner", "left_semi"):
            plain = words.join(lookup, "word", how)
            found = joins.salted_join(words, lookup, ["word"], how, hot_rows=100)
            assert same(found.select(*plain.columns), plain)
        joined = joins.salted_join(words, lookup, ["word"], "left", hot_rows=100)
        plan = plan_of(joined)
        assert "SortMergeJoin" in plan or "ShuffledHashJoin" in plan
        parts = joined.groupBy(F.spark_partition_id().alias("p"), "word").count().collect()
        for word, rows in (("hot", hot), (None, 600)):
            sizes = [r["count"] for r in parts if r.word == word]
            assert len(sizes) == 8 and max(sizes) < rows / 3
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_salted_join_takes_repeated_rows_and_any_type(spark):
    df = spark.createDataFrame([(1,)] * 500 + [(2,)] * 3 + [(None,)] * 40, "k int").repartition(9)
    lookup = spark.createDataFrame([(1, b"x"), (3, b"y")], "k int, v binary")
    for how in ("left", "inner"):
        assert same(joins.salted_join(df, lookup, ["k"], how, hot_rows=10), df.join(lookup, "k", how))
    with pytest.raises(ValueError):
        joins.lookup_join(df.withColumn("_salt", F.lit(1)), lookup, "k", limit=0)


def test_pair_count_with_repeats_and_nulls(spark, limit):
    a = spark.createDataFrame([(k,) for k in [1, 1, 1, 2, None, 4]], "k long")
    b = spark.createDataFrame([(k,) for k in [1, 1, 2, None, 3]], "k long")
    assert joins.join_count(a, b, "k", "k", limit).first().n == 7
    assert joins.join_count(a.where("k = 4"), b, "k", "k", limit).first().n == 0


def test_pair_count_of_a_key_hot_on_both_sides(spark, limit):
    """A billion pairs of one key are counted, not made."""
    a = spark.range(300_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    b = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    assert joins.join_count(a, b, "k", "k", limit).first().n == 100_000 * 10_000 + 20_000


def test_large_join_counts_before_it_joins(spark, sf_dir):
    fact, lookup = named_table(spark, sf_dir, "lineitem"), named_table(spark, sf_dir, "orders")
    plan = plan_of(joins.join_count(fact, lookup, "l_orderkey", "o_orderkey", limit=0))
    assert plan.count("HashAggregate") > 4
    small = plan_of(joins.join_count(fact, lookup, "l_orderkey", "o_orderkey"))
    assert "BroadcastHashJoin" in small and "hashpartitioning(l_orderkey" not in small
    assert "hashpartitioning" not in small  # the lookup's counts are written before


def test_broadcast_bound_is_measured(spark):
    df = spark.range(1000).select(F.repeat(F.lit("x"), 1000).alias("s"))
    assert joins.fits_broadcast(df, 1_100_000)
    assert not joins.fits_broadcast(df, 900_000)
    assert not joins.fits_broadcast(df, 20_000)
    assert not joins.fits_broadcast(spark.range(3).select(F.array("id").alias("a")))
    assert joins.fits_broadcast(df.limit(0))


def test_encoding_report(spark, words):
    row = storage.encoding_report(words, "word").first()
    plain = [r.word for r in words.where("word IS NOT NULL").collect()]
    assert row.plain == sum(map(len, plain))
    assert row.codes == 4 * len(plain)
    assert row.dict == sum(map(len, set(plain)))


def test_like_on_the_dictionary_reaches_the_scan_as_codes(spark, words, tmp_path):
    codes, entries = dictionary.dict_encode(words, "word")
    codes.write.parquet(str(tmp_path / "codes"))
    stored = spark.read.schema(codes.schema).parquet(str(tmp_path / "codes"))
    few = dictionary.dict_filter(stored, entries, F.col("word").like("w_1"), ranges=1000)
    pushed = plan_of(few).split("PushedFilters: ")[1].split("\n")[0]
    assert "GreaterThanOrEqual(code," in pushed and "LessThanOrEqual(code," in pushed and "Join" not in plan_of(few)
    many = dictionary.dict_filter(stored, entries, F.col("word").like("%_1"), ranges=3)
    assert "GreaterThanOrEqual(code," in plan_of(many) and "Join type: LeftSemi" in plan_of(many)
    assert same(cols.count_like(words, "word", "%_1"), many.agg(F.count("*").alias("n")))
    run = dictionary.dict_filter(stored, entries, F.col("word").like("w1%"), ranges=1000)
    assert plan_of(run).split("PushedFilters: ")[1].split("\n")[0].count("GreaterThanOrEqual(code,") == 1


def test_ranges_of_codes(spark):
    codes = spark.createDataFrame([(c,) for c in [1, 2, 3, 7, 9, 10, 40]], "code int")
    assert dictionary.code_ranges(codes, 40, 40) == [(1, 3, True), (7, 7, True), (9, 10, True), (40, 40, True)]
    assert dictionary.code_ranges(codes, 40, 1) == [(1, 40, False)]
    assert dictionary.code_ranges(codes.limit(0), 0) == []


def test_products_beyond_a_long(spark):
    """Two keys with five billion rows a side: the pairs don't fit 64 bits. The counts stand for rows."""
    big = 5_000_000_000
    df = spark.createDataFrame([("a", big), ("b", big)], "key string, rows long")
    product = F.col("rows").cast("decimal(19,0)") * F.col("rows").cast("decimal(19,0)")
    assert df.agg(F.sum(product.cast("decimal(38,0)")).alias("n")).first().n == 2 * big * big > 2**63
    small = joins.join_count(df, df, "key", "key", limit=0)
    assert dict(small.dtypes) == {"n": "decimal(38,0)"} and small.first().n == 2
