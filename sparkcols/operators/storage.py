"""Storage footprint: stored bytes, logical bytes and the gain of a dictionary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sparkcols.functions.scalars import readable_bytes, safe_ratio

CODE_BYTES = 4

# Logical width in bytes of the fixed-width types.
WIDTHS = {
    "tinyint": 1, "boolean": 1, "smallint": 2, "int": 4, "float": 4, "date": 4,
    "bigint": 8, "double": 8, "timestamp": 8, "timestamp_ntz": 8,
}


def _bytes_of(field: T.StructField) -> Column:
    column = F.col(field.name)
    kind = field.dataType.simpleString()
    if kind in ("string", "binary"):
        return F.coalesce(F.sum(F.octet_length(column)), F.lit(0))
    if isinstance(field.dataType, T.DecimalType):
        return F.count(column) * F.lit(8 if field.dataType.precision <= 18 else 16)
    if kind in WIDTHS:
        return F.count(column) * F.lit(WIDTHS[kind])
    raise TypeError(f"{field.name}: no logical size for {kind}")


def has_logical_size(df: DataFrame) -> bool:
    """True when all columns are of flat types, whose size is a matter of counting."""
    return all(
        isinstance(f.dataType, (T.StringType, T.BinaryType, T.DecimalType)) or f.dataType.simpleString() in WIDTHS
        for f in df.schema
    )


def logical_bytes(df: DataFrame) -> DataFrame:
    """Uncompressed bytes per column, one row per column; NULL takes none."""
    sizes = df.agg(*[_bytes_of(f).cast("long").alias(f.name) for f in df.schema])
    entries = [F.struct(F.lit(c).alias("column"), F.col(c).alias("bytes")) for c in df.columns]
    return sizes.select(F.inline(F.array(*entries)))


def table_size(df: DataFrame) -> DataFrame:
    """Rows and uncompressed bytes of the whole table, in one pass."""
    total = sum((_bytes_of(f) for f in df.schema), F.lit(0))
    return df.agg(F.count("*").alias("rows"), total.cast("long").alias("bytes"))


def stored_bytes(spark: SparkSession, folders: dict[str, str], pattern: str = "*") -> DataFrame:
    """Compressed bytes per table from file sizes; no file content is read.

    Every data file counts whose name matches ``pattern``; names that begin
    with ``_`` or ``.`` are no data. An empty folder has 0 bytes, and a folder
    inside another one counts for both.
    """
    reader = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    )
    sizes = [
        reader.load(folder)
        .agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
        .select(F.lit(name).alias("table"), "bytes")
        for name, folder in folders.items()
    ]
    return reduce(DataFrame.unionByName, sizes).withColumn("readable", readable_bytes("bytes"))


def table_report(spark: SparkSession, tables: dict[str, tuple[str, DataFrame]], pattern: str = "*") -> DataFrame:
    """Rows, stored and logical bytes of each table, as numbers and readable, with their ratio.

    ``tables`` gives a folder and the rows stored in it for each name.
    """
    sizes = [
        table_size(rows).select(F.lit(name).alias("table"), "rows", F.coalesce("bytes", F.lit(0)).alias("logical"))
        for name, (_, rows) in tables.items()
    ]
    stored = stored_bytes(spark, {name: folder for name, (folder, _) in tables.items()}, pattern)
    # one row per table on both sides
    both = reduce(DataFrame.unionByName, sizes).join(F.broadcast(stored), "table")
    return both.select(
        "table", "rows", F.col("bytes").alias("stored"), "logical",
        F.col("readable").alias("stored_text"), readable_bytes("logical").alias("logical_text"),
        safe_ratio(F.col("logical").cast("double"), F.col("bytes").cast("double")).alias("gain"),
    )


def encoding_report(df: DataFrame, column: str) -> DataFrame:
    """Bytes of a text column as plain values and as codes plus a dictionary.

    The rows are first counted per value, so only one row per distinct value
    and task is shuffled.
    """
    values = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("rows"))
    width = F.octet_length(column).cast("long")
    return values.agg(
        F.coalesce(F.sum(width * F.col("rows")), F.lit(0)).alias("plain"),
        F.coalesce(F.sum("rows") * CODE_BYTES, F.lit(0)).alias("codes"),
        F.coalesce(F.sum(width), F.lit(0)).alias("dict"),
    )
