"""Suites on generated tables: python bench_scale.py ROWS [RUNS]

Prints the comparison reports of the three suites: column operations on a
stored and on a cached table, text queries on plain and on dictionary-encoded
values, key queries on integer, UUID and text IDs. The measurements are kept as
a table and the reports come from the library's own report operators.
"""

from __future__ import annotations

import sys
import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkcols import schemas
from sparkcols.functions import scalars
from sparkcols.operators import aggregates as agg, columns as cols, compare, dictionary, ids, joins
from sparkcols.operators import ordering as order, storage
from sparkcols.session import build_session, new_table_path, staged
from sparkcols.sources import generators, layout
from sparkcols.sources.sinks import sink_noop

FILES = 16
IN_LIST = ["button_click", "link_hover", "form_submit", "modal_open", "grid_resize"]


class Clock:
    """Collects one measurement row per run."""

    def __init__(self, runs: int) -> None:
        self.runs = runs
        self.rows: list[tuple] = []

    def run(self, op: str, variant: str, build, once: bool = False) -> None:
        for i in range(1 if once else self.runs + 1):
            start = time.perf_counter()
            result = build()
            if isinstance(result, DataFrame):
                sink_noop(result)
            # a single run has no warm-up, so it takes the place of a second one
            self.rows.append((op, variant, i, time.perf_counter() - start, 0))
        if once:
            self.rows.append((op, variant, 1, self.rows[-1][3], 0))


def sales_suite(spark: SparkSession, clock: Clock, rows: int) -> dict[str, str]:
    paths = {variant: new_table_path(spark, variant) for variant in ("stored", "by_category", "by_subcategory")}
    source = staged(generators.gen_uniform(spark, rows), "source")
    clock.run("ingest", "stored", lambda: layout.sorted_layout(source, ["id"], paths["stored"], FILES), True)
    df = spark.read.schema(schemas.SALES).parquet(paths["stored"])

    def covering_copies():
        keys = ["category", "subcategory"]
        layout.covering_projection(df, keys, ["amount"], paths["by_category"], FILES)
        layout.covering_projection(df, keys[1:], ["amount"], paths["by_subcategory"], FILES)

    clock.run("ingest", "covering", covering_copies, True)
    narrow = spark.read.schema("category string, subcategory string, amount double").parquet(paths["by_category"])
    narrower = spark.read.schema("subcategory string, amount double").parquet(paths["by_subcategory"])
    for variant in ("stored", "cached", "covering"):
        by_category, by_subcategory = (narrow, narrower) if variant == "covering" else (df, df)
        if variant == "cached":
            df.cache().count()
        if variant != "covering":
            clock.run("column sum", variant, lambda: agg.col_sum(df, "amount"))
            clock.run("column multiply", variant, lambda: cols.col_multiply(df, "amount", "quantity"))
            clock.run("filter", variant, lambda: cols.filter_gt(df, "amount", 500.0))
            clock.run("sort", variant, lambda: order.sort_desc(df, "amount", "id"))
        clock.run("count distinct", variant, lambda: agg.count_distinct(by_category, "category"))
        clock.run("count distinct, by groups", variant, lambda: agg.count_groups(by_category, "category"))
        clock.run("group sum", variant, lambda: agg.group_sum(by_category, "category", "amount"))
        clock.run("group sum, exact", variant, lambda: agg.group_sum(by_category, "category", "amount", 2))
        clock.run("group count", variant, lambda: agg.group_count(by_category, "category"))
        clock.run("group multi", variant, lambda: agg.group_multi(by_category, "category", "amount"))
        clock.run("group multi-key", variant, lambda: agg.group_sum(by_category, ["category", "subcategory"], "amount"))
        clock.run("group high-card", variant, lambda: agg.group_sum(by_subcategory, "subcategory", "amount"))
        if variant == "cached":
            df.unpersist()
    return paths


def text_suite(spark: SparkSession, clock: Clock, rows: int, k: int) -> dict[str, str]:
    plain_path, coded_path = new_table_path(spark, f"plain{k}"), new_table_path(spark, f"coded{k}")
    events = generators.gen_events(spark, rows, k)
    clock.run("insert", f"plain_{k}", lambda: layout.sorted_layout(events, ["id"], plain_path, FILES), True)
    plain = spark.read.schema(schemas.TYPED_EVENTS).parquet(plain_path)
    codes, entries = dictionary.dict_encode(plain, "event_type")
    clock.run("insert", f"coded_{k}", lambda: layout.sorted_layout(codes, ["id"], coded_path, FILES), True)
    codes = spark.read.schema(codes.schema).parquet(coded_path)
    word = F.col("event_type")

    def matching(predicate):
        return agg.row_count(dictionary.dict_filter(codes, entries, predicate))

    runs = {
        "count+filter": (lambda: cols.count_eq(plain, "event_type", "button_click"), lambda: matching(word == "button_click")),
        "group by": (lambda: agg.group_count(plain, "event_type"), lambda: dictionary.dict_group_count(codes, entries)),
        "distinct": (lambda: agg.distinct_values(plain, "event_type"),
                     lambda: dictionary.dict_decode(agg.distinct_values(codes, "code"), entries)),
        "count distinct": (lambda: agg.count_distinct(plain, "event_type"), lambda: agg.count_distinct(codes, "code")),
        "in (5)": (lambda: cols.count_in(plain, "event_type", IN_LIST), lambda: matching(word.isin(IN_LIST))),
        "order by": (lambda: order.top_asc(plain, "event_type", 100),
                     lambda: dictionary.dict_decode(order.top_asc(codes, "code", 100), entries)),
        "like": (lambda: cols.count_like(plain, "event_type", "%_click"), lambda: matching(word.like("%_click"))),
    }
    for op, (on_text, on_codes) in runs.items():
        clock.run(op, f"plain_{k}", on_text)
        clock.run(op, f"coded_{k}", on_codes)
    return {f"plain_{k}": plain_path, f"coded_{k}": coded_path}


def id_suite(spark: SparkSession, clock: Clock, rows: int) -> dict[str, str]:
    start = F.timestamp_millis(F.floor(F.col("id") / 50) + 1_700_000_000_000)
    base = staged(generators.gen_values(spark, rows).withColumn("ts", start), "values")
    sources = {
        "long": lambda: ids.timed_id(base, "ts", F.col("id") % 8, "id").select(F.col("sid").alias("id"), "value"),
        "uuid": lambda: base.select(scalars.uuid_v7("ts", "id").alias("id"), "value"),
        "text": lambda: base.select(scalars.id_text(scalars.uuid_v7("ts", "id")).alias("id"), "value"),
    }
    paths = {}
    for kind, source in sources.items():
        path = paths[kind] = new_table_path(spark, kind)
        clock.run("insert", kind, lambda: layout.sorted_layout(source(), ["id"], path, FILES), True)
        df = spark.read.schema(schemas.KEYED_VALUES[kind]).parquet(path)
        lookup = staged(ids.sample_keys(df, "id", rows // 100), "lookup")
        found = [r["id"] for r in ids.anchor_keys(df, "id").orderBy("id").collect()]
        clock.run("point lookup", kind, lambda: cols.point_lookup(df, "id", found[0]))
        clock.run("range scan", kind, lambda: cols.range_count(df, "id", found[0], found[-1]))
        clock.run("order by", kind, lambda: order.top_desc(df, "id", 100))
        clock.run("offset limit", kind, lambda: order.page(df, "id", 100, 10_000))
        clock.run("in (5)", kind, lambda: cols.multi_lookup(df, "id", found))
        clock.run("group by value", kind, lambda: agg.group_count(df, "value"))
        clock.run("join", kind, lambda: joins.join_count(df, lookup, "id", "id"))
        clock.run("join, both counted", kind, lambda: joins.join_count(df, lookup, "id", "id", limit=0))
    return paths


def report(spark: SparkSession, title: str, clock: Clock, variants: list[str], paths: dict[str, str]) -> None:
    runs = spark.createDataFrame(clock.rows, schemas.MEASUREMENTS)
    means = staged(compare.mean_after_warmup(runs), "means")
    texts = means.withColumn("t", scalars.readable_time("t"))
    wide = compare.comparison_pivot(texts, variants).join(compare.fastest(means), "op").orderBy("op")
    print(f"\n{title}\n\n| op | {' | '.join(variants)} | fastest |\n|{' --- |' * (len(variants) + 2)}")
    for row in wide.collect():
        best = row["fastest"] + (f" ~x{row['ratio']:.1f}" if row["ratio"] else "")
        print(f"| {row['op']} | {' | '.join(row[v] or '–' for v in variants)} | {best} |")
    if paths:
        for row in storage.stored_bytes(spark, paths).orderBy("table").collect():
            print(f"\n{row['table']}: {row['readable']} stored")


def main() -> None:
    rows = int(sys.argv[1]) if len(sys.argv) > 1 else 1_000_000
    runs = int(sys.argv[2]) if len(sys.argv) > 2 else 3
    spark = build_session(
        "bench-scale", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="16g",
        spark__ui__enabled="false", spark__python__sql__dataFrameDebugging__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    sales, text, keys = Clock(runs), Clock(runs), Clock(runs)
    paths = sales_suite(spark, sales, rows)
    report(spark, f"Columns, {rows:,} rows", sales, ["stored", "cached", "covering"], paths)
    paths = {**text_suite(spark, text, rows, 10), **text_suite(spark, text, rows, 1000)}
    report(spark, f"Text, {rows:,} rows", text, ["plain_10", "coded_10", "plain_1000", "coded_1000"], paths)
    paths = id_suite(spark, keys, rows)
    report(spark, f"Keys, {rows:,} rows", keys, ["long", "uuid", "text"], paths)
    spark.stop()


if __name__ == "__main__":
    main()
