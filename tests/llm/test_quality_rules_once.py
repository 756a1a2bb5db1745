"""A text is split once, also where its judgement is filtered."""

import time

from pyspark.sql import functions as F

from conftest import plan_of
from sparkcols.llm import quality_rules


def test_filters_judge_no_text_again(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for done in (quality_rules.judge(docs), quality_rules.keep_good(docs), quality_rules.judge(docs).where("kept")):
        assert plan_of(done).count("split(") <= 2
    kept = {r.doc_id for r in quality_rules.judge(docs).where("kept").collect()}
    assert {r.doc_id for r in quality_rules.keep_good(docs).collect()} == kept
    assert quality_rules.keep_good(docs).columns == docs.columns


def test_a_long_text_takes_no_longer_to_keep(spark):
    words = F.transform(F.sequence(F.lit(1), F.lit(60_000)), lambda i: F.concat(F.lit("w"), F.xxhash64(i).cast("string")))
    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.array_join(words, " ").alias("text")).repartition(1)

    def seconds(f):
        began = time.time()
        f(docs).write.format("noop").mode("overwrite").save()
        return time.time() - began

    seconds(quality_rules.judge), seconds(quality_rules.keep_good)
    assert seconds(quality_rules.keep_good) < seconds(quality_rules.judge) + 2


def test_odd_rows_and_clashing_names(spark):
    rows = [(1, None), (1, None), (2, ""), (3, "a b"), (None, "the " * 30)]
    docs = spark.createDataFrame([(*r, 1, True) for r in rows], "doc_id long, text string, n_words int, kept boolean")
    got = sorted((tuple(r) for r in quality_rules.judge(docs).select("doc_id", "n_words", "base_failed", "kept").collect()), key=repr)
    assert got == sorted([(1, 0, True, False), (1, 0, True, False), (2, 0, True, False), (3, 2, True, False), (None, 30, True, False)], key=repr)
    assert quality_rules.keep_good(docs).columns == docs.columns and quality_rules.keep_good(docs).count() == 0
