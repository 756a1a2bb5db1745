"""Comparison reports over a table of measurements (op, variant, run, seconds, bytes)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sparkcols.functions.scalars import readable_bytes, safe_ratio
from sparkcols.operators.aggregates import total_of

KEYS = ["op", "variant"]


def mean_after_warmup(m: DataFrame, scale: int | None = None) -> DataFrame:
    """Mean seconds per (op, variant) without the first run, as column ``t``.

    The warm-up is the one row with the lowest run number of its group: a
    missing number comes last, and of equal ones the least time is taken. One
    pass keeps sum, count and that row per group, so no group is ever held or
    sorted in one task. Missing times don't count; a group with one row only
    has no mean and is left out. Without ``scale`` the warm-up is subtracted
    from a sum of doubles, which costs digits when it dwarfs all other runs.
    """
    ends = m.groupBy(*KEYS).agg(
        total_of("seconds", scale).alias("total"),
        F.count("seconds").alias("timed"),
        F.count("*").alias("n"),
        F.min(F.struct(F.col("run").isNull(), "run", F.col("seconds").isNull(), "seconds"))["seconds"].alias("first"),
    )
    rest = F.col("total") - F.coalesce("first", F.lit(0.0))
    if scale is not None:
        rest = F.rint(rest * F.lit(10.0**scale)) / F.lit(10.0**scale)
    others = F.col("timed") - F.when(F.col("first").isNotNull(), 1).otherwise(0)
    return ends.where("n > 1").select(*KEYS, F.when(others > 0, rest / others).alias("t"))


def comparison_pivot(means: DataFrame, variants: list[str]) -> DataFrame:
    """One row per op, one column per variant; a missing measurement is NULL."""
    return means.groupBy("op").pivot("variant", variants).agg(F.first("t"))


def fastest(means: DataFrame) -> DataFrame:
    """Fastest variant per op and how many times slower the slowest one is.

    The ratio is NULL when there is nothing to compare: a fastest time of zero,
    or all variants equally fast. Equal times go to the first name. Missing times
    don't compete; without any time the fastest is NULL.
    """
    ends = means.groupBy("op").agg(
        F.min_by("variant", F.when(F.col("t").isNotNull(), F.struct("t", "variant"))).alias("fastest"),
        F.min("t").alias("best"),
        F.max("t").alias("worst"),
    )
    differ = (F.col("best") > 0) & (F.col("best") < F.col("worst"))
    return ends.select("op", "fastest", F.when(differ, F.round(F.col("worst") / F.col("best"), 1)).alias("ratio"))


def ratio_to(means: DataFrame, baseline: str, others: list[str]) -> DataFrame:
    """Time of each other variant relative to the baseline's, to one decimal."""
    wide = comparison_pivot(means, [baseline, *others])
    return wide.select(
        "op",
        *[F.round(safe_ratio(F.col(v), F.col(baseline)), 1).alias(f"{v}_to_{baseline}") for v in others],
    )


def peak_bytes(m: DataFrame) -> DataFrame:
    """Highest memory growth per (op, variant); a negative delta counts as none, a missing one stays missing."""
    grown = F.when(F.col("bytes").isNotNull(), F.greatest(F.col("bytes"), F.lit(0)))
    return m.groupBy(*KEYS).agg(F.max(grown).alias("peak"))


def memory_pivot(m: DataFrame, variants: list[str]) -> DataFrame:
    """Readable peak bytes: one row per op, one column per variant."""
    texts = peak_bytes(m).withColumn("peak", readable_bytes("peak"))
    return texts.groupBy("op").pivot("variant", variants).agg(F.first("peak"))
