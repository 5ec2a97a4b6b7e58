"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, byte_bpe, decontam, hard_negatives, language, licenses, line_dedup, near_dup, quality, suffix_dedup, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable) -> Callable:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


@query("op3_token_files")
def op3_token_files(spark: SparkSession, d: str) -> DataFrame:
    from .token_files import encode_and_read

    return encode_and_read(documents(spark, d), "byte_bpe_50k.json", end_id=0)


@query("op10_best_fit_packing")
def op10_best_fit_packing(spark: SparkSession, d: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(documents(spark, d), vocab_name="byte_bpe_50k.json", capacity=1024, end_id=2)


@query("op2_line_dedup", line_dedup.SQL)
def op2_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    return line_dedup.line_digests(documents(spark, d), min_docs=10)


@query("op5_line_quality", quality.SQL)
def op5_line_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.line_quality(documents(spark, d), min_words=20, max_repeat=30, min_kept=0.5).drop("cleaned")


@query("op1_language_id")
def op1_language_id(spark: SparkSession, d: str) -> DataFrame:
    return language.learn_and_predict(documents(spark, d))


@query("op6_toxicity_chain")
def op6_toxicity_chain(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.classify(documents(spark, d), spark.read.parquet(f"{d}/labels.parquet"))


@query("op7_minhash_near_dup")
def op7_minhash_near_dup(spark: SparkSession, d: str) -> DataFrame:
    return near_dup.near_duplicates(documents(spark, d)).drop("row")


@query("op9_latent_decontamination")
def op9_latent_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontam.contaminated(documents(spark, d), spark.read.parquet(f"{d}/benchmark.parquet"))


@query("op4_suffix_dedup")
def op4_suffix_dedup(spark: SparkSession, d: str) -> DataFrame:
    return suffix_dedup.repeat_digests(documents(spark, d))


@query("op8_license_scan")
def op8_license_scan(spark: SparkSession, d: str) -> DataFrame:
    return licenses.scan(documents(spark, d))


@query("op13_byte_bpe")
def op13_byte_bpe(spark: SparkSession, d: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.token_digests(documents(spark, d), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op11_token_alignment")
def op11_token_alignment(spark: SparkSession, d: str) -> DataFrame:
    import public_tokenizers

    return alignment.align(documents(spark, d), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op12_hard_negatives", hard_negatives.SQL)
def op12_hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    return hard_negatives.mine(spark.read.parquet(f"{d}/embeddings.parquet"))
