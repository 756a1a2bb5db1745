"""From documents to token ids: quality rules, line dedup, near duplicates, mixing, byte-level BPE.

Each stage is written to the shared folder and read back by the next one. Null
and empty texts fail the quality rules; empty tables give empty tables. Repeated
rows are near copies of each other: line dedup takes rows with one key for one
document, the near-duplicate stage keeps them all, as they share their key. Only
the columns of documents are carried; extra columns are left behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcols.llm import byte_bpe, line_dedup, mixing, ngram_join, quality_rules
from sparkcols.session import staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
DIGESTS = ["n_tokens", "ids_sha256", "decoded_sha256"]
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs.select(*COLUMNS))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.without_lost(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with their ``mix_slot``: files keep no order, so the place in the schedule is a column."""
    return mixing.schedule(docs.select(*COLUMNS), each=True).select(*COLUMNS, "mix_slot")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``mix_slot`` and token digests; training reads them by slot, then md5 of the key, then key."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    placed = docs.select(F.struct("doc_id", "mix_slot").alias("place"), "text")
    coded = byte_bpe.encode(placed, path, public_tokenizers.PATTERN, key="place")
    return byte_bpe.digest(byte_bpe.decode(coded, path), key="place").select("place.*", *DIGESTS)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("mixing", mix),
    ("byte_bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
