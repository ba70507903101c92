"""The corpus pipeline: each stage reads what the one before it kept, as Parquet in the shared folder."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm.common import materialise
from quillframe.llm.decontaminate import drop_leaks
from quillframe.llm.minhash_dedup import keep_first_of_each
from quillframe.llm.packing import pack
from quillframe.llm.quality_rules import keep_good
from quillframe.llm.suffix_dedup import cut_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, those with a null or empty text too; repeated rows are judged each."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five-word shingles, similarity 0.8. Rows that share the smallest
    id stay together; documents without words stay."""
    return keep_first_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that a document with a smaller id has too are cut; a character cut in two goes whole. Empty
    texts go, null ones stay; ``n_chars`` follows the text; other columns pass unchanged."""
    cut = cut_repeats(docs).where("text is null or text <> ''")
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage near a benchmark item go; null texts hold none."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed in sequences of 1024 tokens in the sources' proportions; a null text is its end id alone."""
    return pack(docs, vocabulary=public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontaminate", decontaminate), ("packing", packing)]

#: Hash signatures, byte substrings and byte-pair encoding have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
