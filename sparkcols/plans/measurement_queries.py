"""Comparison reports, with the events read as measurements of five operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkcols.functions import scalars
from sparkcols.operators import compare
from sparkcols.plans.registry import query
from sparkcols.sources.tables import named_table

VARIANTS = ["click", "view", "purchase", "signup", "error", "absent"]
BYTES_SQL = "(event_id % 1000) * 4000 - 100000"
RUNS_SQL = f"""SELECT 'op_' || CAST(user_id % 5 AS VARCHAR) AS op, event_type AS variant, event_id AS run,
    value AS seconds, {BYTES_SQL} AS bytes FROM events"""
MEANS_SQL = f"""SELECT op, variant, CAST(sum(CAST(seconds AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS t
    FROM (SELECT *, row_number() OVER (PARTITION BY op, variant ORDER BY run) AS rn FROM ({RUNS_SQL}))
    WHERE rn > 1 GROUP BY op, variant"""
SIZES_SQL = "(event_id % 100000) * (event_id % 100000) * (event_id % 100000)"
SECONDS_SQL = "value * ([1e-9, 1e-6, 1e-3, 1.0, 100.0])[event_id % 5 + 1]"


def _wide(source: str, value: str) -> str:
    columns = ", ".join(f"{value} FILTER (variant = '{v}') AS {v}" for v in VARIANTS)
    return f"SELECT op, {columns} FROM ({source}) GROUP BY op"


def readable_bytes_sql(n: str) -> str:
    units = ["B", "KB", "MB", "GB", "TB"]
    cases = " ".join(
        f"WHEN {n} < {1024.0 ** (i + 1):.1f} THEN printf('%.1f {u}', {n} / {1024.0**i:.1f})" for i, u in enumerate(units)
    )
    return f"CASE WHEN {n} IS NULL THEN NULL {cases} ELSE printf('%.1f PB', {n} / {1024.0**5:.1f}) END"


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named_table(spark, sf_dir, "events").select(
        F.concat(F.lit("op_"), (F.col("user_id") % 5).cast("string")).alias("op"),
        F.col("event_type").alias("variant"),
        F.col("event_id").alias("run"),
        F.col("value").alias("seconds"),
        ((F.col("event_id") % 1000) * 4000 - 100000).alias("bytes"),
    )


def means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.mean_after_warmup(measurements(spark, sf_dir), scale=2)


@query(MEANS_SQL)
def mean_after_warmup(spark, sf_dir):
    return means(spark, sf_dir)


@query(_wide(MEANS_SQL, "max(t)"))
def comparison_pivot(spark, sf_dir):
    return compare.comparison_pivot(means(spark, sf_dir), VARIANTS)


@query(
    f"""SELECT op, arg_min(variant, (t, variant)) AS fastest,
    CASE WHEN min(t) > 0 AND min(t) < max(t) THEN round(max(t) / min(t), 1) END AS ratio
    FROM ({MEANS_SQL}) GROUP BY op"""
)
def fastest(spark, sf_dir):
    return compare.fastest(means(spark, sf_dir))


@query(
    f"""SELECT op, round(click / view, 1) AS click_to_view, round(purchase / view, 1) AS purchase_to_view,
    round(absent / view, 1) AS absent_to_view FROM ({_wide(MEANS_SQL, "max(t)")})"""
)
def ratio_to(spark, sf_dir):
    return compare.ratio_to(means(spark, sf_dir), "view", ["click", "purchase", "absent"])


@query(
    "SELECT op, "
    + ", ".join(f"{readable_bytes_sql(v)} AS {v}" for v in VARIANTS)
    + f" FROM ({_wide(RUNS_SQL, 'max(greatest(bytes, 0))')})"
)
def memory_pivot(spark, sf_dir):
    return compare.memory_pivot(measurements(spark, sf_dir), VARIANTS)


@query(f"SELECT event_id, {readable_bytes_sql(f'({SIZES_SQL})')} AS size FROM events")
def readable_bytes(spark, sf_dir):
    base = F.col("event_id") % 100000
    return named_table(spark, sf_dir, "events").select(
        "event_id", scalars.readable_bytes(base * base * base).alias("size")
    )


@query(
    f"""SELECT event_id, CASE WHEN s >= 3600 THEN printf('%.2f hour', s / 3600)
    WHEN s >= 60 THEN printf('%.2f min', s / 60) WHEN s >= 1 THEN printf('%.2f sec', s)
    WHEN s >= 1e-3 THEN printf('%.2f ms', s * 1e3) WHEN s >= 1e-6 THEN printf('%.2f us', s * 1e6)
    ELSE printf('%.2f ns', s * 1e9) END AS duration FROM (SELECT event_id, {SECONDS_SQL} AS s FROM events)"""
)
def readable_time(spark, sf_dir):
    factor = F.element_at(F.lit([1e-9, 1e-6, 1e-3, 1.0, 100.0]), (F.col("event_id") % 5 + 1).cast("int"))
    return named_table(spark, sf_dir, "events").select(
        "event_id", scalars.readable_time(F.col("value") * factor).alias("duration")
    )


@query("SELECT event_id, CASE WHEN user_id > 0 THEN value / user_id ELSE 'inf'::DOUBLE END AS ratio FROM events")
def safe_ratio(spark, sf_dir):
    """An event without a user has no positive divisor either, as in SQL's ELSE."""
    return named_table(spark, sf_dir, "events").select(
        "event_id", scalars.safe_ratio("value", "user_id", missing=float("inf")).alias("ratio")
    )
