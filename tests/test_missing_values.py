"""Missing values, reused paths and odd folders."""

from pyspark.sql import functions as F

from sparkcols import schemas
from sparkcols.operators import compare, dictionary, storage
from sparkcols.sources import sinks


def test_dictionary_predicates_see_null_rows(spark):
    words = spark.createDataFrame([("a",), ("b",), (None,), ("a",), (None,)], "word string")
    codes, entries = dictionary.dict_encode(words, "word")
    renamed = codes.withColumnRenamed("word", "code") if "word" in codes.columns else codes
    for predicate in (F.col("word").isNull(), F.coalesce("word", F.lit("a")) == "a", F.col("word") == "a", F.lit(True)):
        for ranges in (1000, 1):
            kept = dictionary.dict_filter(renamed, entries, predicate, ranges=ranges)
            assert kept.count() == words.where(predicate).count()


def test_warm_up_is_one_row_and_missing_keys_stay(spark):
    rows = [
        ("x", None, 1, 9.0), ("x", None, 2, 2.0), ("x", None, None, 4.0),
        ("y", "v", 1, 5.0), ("y", "v", 1, 7.0), ("y", "v", 2, None),
        ("z", "v", 1, 1.0),
    ]
    runs = spark.createDataFrame(rows, "op string, variant string, run int, seconds double")
    for scale in (None, 2):
        got = {(r.op, r.variant): r.t for r in compare.mean_after_warmup(runs, scale).collect()}
        assert got == {("x", None): 3.0, ("y", "v"): 7.0}


def test_a_table_created_again_on_its_path_is_empty(spark, tmp_path):
    schema, path = schemas.KEYED_VALUES["long"], str(tmp_path / "again")
    for _ in range(2):
        table = sinks.create_table(spark, "created_again", schema, path)
        assert spark.table("created_again").count() == 0
        sinks.append(spark.range(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in schema)), "created_again")
        assert table.columns == schema.names
    sinks.drop_table(spark, "created_again")


def test_every_data_file_counts(spark, tmp_path):
    spark.range(10).write.orc(str(tmp_path / "x" / "data" / "a"))
    spark.range(10).write.parquet(str(tmp_path / "data" / "a"))
    (tmp_path / "none").mkdir()
    folders = {"orc": tmp_path / "x" / "data" / "a", "parquet": tmp_path / "data" / "a", "none": tmp_path / "none"}
    got = {r.table: r.bytes for r in storage.stored_bytes(spark, {k: str(v) for k, v in folders.items()}).collect()}
    want = {
        k: sum(p.stat().st_size for p in v.iterdir() if not p.name.startswith(("_", "."))) for k, v in folders.items()
    }
    assert got == want and got["orc"] > 0
