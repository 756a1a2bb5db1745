"""Explicit dictionary encoding of a text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sparkcols.operators.joins import BROADCAST_BYTES, fits_broadcast, key_counts, lookup_join
from sparkcols.operators.ordering import free_of, with_row_number
from sparkcols.session import staged

#: ranges of codes that a predicate pushes to the scan, at most
CODE_RANGES = 256


def _ranked(df: DataFrame, column: str, limit: int, code_type: str) -> tuple[DataFrame, bool]:
    """(``code``, ``column``, ``_rows``) of every value, and whether that is within ``limit`` bytes by measure."""
    free_of(df, "code", "_rows")
    values = staged(key_counts(df, [column]), "values")
    ranked = with_row_number(values, [column], "code")
    return ranked.select(F.col("code").cast(code_type).alias("code"), column, "_rows"), fits_broadcast(values, limit)


def build_dictionary(df: DataFrame, column: str, limit: int = BROADCAST_BYTES, code_type: str = "int") -> DataFrame:
    """Table of (``code``, ``column``), codes dense from 1 in the order of the values.

    More values than ``code_type`` holds stop the job. Only distinct values are
    ranked, by range partitions, so any number of them works.
    """
    return _ranked(df, column, limit, code_type)[0].select("code", column)


def dict_encode(df: DataFrame, column: str, limit: int = BROADCAST_BYTES,
                code_type: str = "int") -> tuple[DataFrame, DataFrame]:
    """The rows with ``column`` replaced by ``code``, and the dictionary. NULL stays NULL.

    The counts that come with the values tell the join which of them are hot.
    """
    ranked, small = _ranked(df, column, limit, code_type)
    dictionary = ranked.select("code", column)
    coded = lookup_join(df, dictionary, column, "left", limit, small, ranked.select(column, "_rows"))
    return coded.select(*[F.col("code") if c == column else F.col(c) for c in df.columns]), dictionary


def dict_decode(codes: DataFrame, dictionary: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The rows with ``code`` replaced by its value."""
    (value,) = [c for c in dictionary.columns if c != "code"]
    rows = lookup_join(codes, dictionary, "code", "left", limit)
    return rows.select(*[F.col(value) if c == "code" else F.col(c) for c in codes.columns])


def code_ranges(matching: DataFrame, entries: int, ranges: int = CODE_RANGES) -> list[tuple[int, int, bool]]:
    """Ascending (first, last, whole) ranges that hold all matching codes; ``whole`` if every code in it matches.

    The codes 1 .. ``entries`` are cut into at most ``ranges`` even stretches and
    each gives the least and greatest match and their number; stretches without
    a gap between them are joined. So what reaches the driver has a fixed size.
    """
    width = -(-max(entries, 1) // ranges)
    stretch = F.floor((F.col("code") - 1) / width)
    rows = matching.groupBy(stretch.alias("s")).agg(F.min("code").alias("lo"), F.max("code").alias("hi"), F.count("*").alias("n"))
    out: list[tuple[int, int, bool]] = []
    for lo, hi, n in sorted((r["lo"], r["hi"], r["n"]) for r in rows.collect()):
        whole = n == hi - lo + 1
        if out and out[-1][1] + 1 == lo and out[-1][2] and whole:
            out[-1] = (out[-1][0], hi, True)
        else:
            out.append((lo, hi, whole))
    return out


def dict_filter(codes: DataFrame, dictionary: DataFrame, predicate: Column, limit: int = BROADCAST_BYTES,
                ranges: int = CODE_RANGES) -> DataFrame:
    """Coded rows whose value meets ``predicate``, which is evaluated once per dictionary entry.

    The matching codes reach the scan as ranges, for any number of matches. Up
    to ``ranges`` entries the ranges are exact; where one holds a code that
    doesn't match, the rows in the ranges are also joined with the matches.
    """
    matching = dictionary.where(predicate).select("code")
    entries = dictionary.agg(F.max("code")).first()[0] or 0
    # NULL has no entry, so the predicate is asked once for it
    nothing = codes.sparkSession.range(1).select(*(F.lit(None).cast(t).alias(c) for c, t in dictionary.dtypes))
    takes_null = nothing.where(predicate).count() > 0
    found = code_ranges(matching, entries, ranges)
    code, kind = F.col("code"), codes.schema["code"].dataType
    listed = F.lit(False)
    for lo, hi, _ in found:
        listed = listed | ((code >= F.lit(lo).cast(kind)) & (code <= F.lit(hi).cast(kind)))
    kept = codes.where(listed)
    if not all(whole for *_, whole in found):
        kept = lookup_join(kept, matching, "code", "left_semi", limit).select(*codes.columns)
        return kept.unionByName(codes.where(code.isNull())) if takes_null else kept
    return codes.where(listed | code.isNull()) if takes_null else kept


def dict_group_count(codes: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Row count per value: grouped on the code, decoded after, one row per group."""
    (value,) = [c for c in dictionary.columns if c != "code"]
    counts = codes.groupBy("code").agg(F.count("*").alias("n"))
    return counts.join(dictionary, "code", "left").select(value, "n")
