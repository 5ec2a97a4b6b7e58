"""The corpus pipeline: documents in, packed training sequences out.

Each stage works on all that the one before it kept and returns documents with the columns they came
with, whatever these are; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tankline.llm.common import boxed
from tankline.llm.decontam import searches
from tankline.llm.language import fit, language_of
from tankline.llm.line_dedup import line_drops, without_lines
from tankline.llm.near_dup import one_of_each
from tankline.llm.packing import pack_documents
from tankline.sources.scratch import fresh_dir

#: a text whose best language scores less is rejected; only texts of a word or two come near
LEAST_SCORE = 0.1


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: NULL or without a letter, or with no language that fits.

    The model is fitted on the documents that have a ``lang``; where none has, only letters count.
    """
    model = fit(docs)
    found = language_of(docs["text"], model)
    if model is None:
        return docs.filter(F.coalesce(docs["text"].rlike(r"\p{L}"), F.lit(False)))
    return docs.filter((found["lang"] != "und") & (found["score"] >= LEAST_SCORE))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the lines found in ten documents or more; ``n_chars``, where there is one, follows the text."""
    drops = line_drops(docs, min_docs=10)
    both = boxed(docs).join(drops.withColumnRenamed("row_id", "row"), "row", "left")
    text = without_lines(F.col("doc.text"), F.col("drop"))
    changed = F.col("doc").withField("text", text)
    if "n_chars" in docs.columns:
        changed = changed.withField("n_chars", F.when(F.col("drop").isNull(), F.col("doc.n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType))
    return both.select(changed.alias("doc")).select("doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the least id."""
    kept = boxed(docs).join(one_of_each(docs), "row", "left_semi")
    return kept.dropDuplicates(["row"]).select("doc.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold an item of ``benchmark``."""
    out = docs
    for held in searches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")):
        out = out.filter(F.size(held) == 0)
    return out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed best-fit into sequences of 1024."""
    return pack_documents(docs, vocab_name="byte_bpe_50k.json", capacity=1024, end_id=2)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        path = fresh_dir(spark, name)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
