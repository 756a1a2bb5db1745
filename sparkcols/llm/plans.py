"""The registered queries of this subpackage, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcols.llm import (
    alignment,
    byte_bpe,
    fingerprints,
    html_text,
    license_scan,
    line_dedup,
    merkle,
    mixing,
    near_vectors,
    ngram_join,
    ordinal_quality,
    quality_rules,
    secrets,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("any")), F.col("doc_id"))
    return license_scan.scan(docs.withColumn("path", path))


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return ordinal_quality.score(docs, ordinal_quality.fit(docs, labels))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = byte_bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return byte_bpe.digest(byte_bpe.decode(coded, path))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = mixing.schedule(table(spark, sf_dir, "documents"), each=True)
    return done.select("doc_id", "mix_stream", "mix_block", "mix_slot")


def op5_mixing_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources without a weight in one stream."""
    return mixing.schedule(table(spark, sf_dir, "documents")).select("doc_id", "mix_stream", "mix_block", "mix_slot")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(table(spark, sf_dir, "documents"), width=3, percent=90)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_lost", F.md5(F.coalesce("kept_text", F.lit(""))).alias("kept_md5"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    more = F.coalesce(F.try_add(F.col("n_chars"), F.lit(1)), F.col("n_chars"))
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, merkle.leaf(docs, fields, n_chars=more))
    return merkle.checked(merkle.manifest(docs, merkle.leaf(docs, fields), found=tampered), F.col("found"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.neighbours(table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.score(table(spark, sf_dir, "documents"), *files)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_near_vectors, op3_ordinal_quality, op4_byte_bpe, op5_mixing, op5_mixing_common, op6_secrets,
        op7_ngram_join, op8_quality_rules, op9_html_text, op10_line_dedup,
        op11_merkle_manifest, op12_fingerprints, op13_alignment, pipeline,
    )
} | {"op5_mixing_each": op5_mixing}
SQL = {
    "op5_mixing": mixing.schedule_sql(each=True),
    "op5_mixing_each": mixing.schedule_sql(each=True),
    "op5_mixing_common": mixing.schedule_sql(),
    "op11_merkle_manifest": merkle.manifest_sql(),
}
