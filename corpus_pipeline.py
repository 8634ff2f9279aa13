"""Corpus preparation in five stages: language, near-duplicates, personal data, mixture, packing.

Each stage takes what its predecessor kept, written as Parquet and read again, and all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaymill.llm.language_id import identify, train
from assaymill.llm.mixing import mixed
from assaymill.llm.near_dedup import near_duplicates
from assaymill.llm.packing import pack
from assaymill.llm.pseudonyms import pseudonymize
from assaymill.llm.queries import DEMO_KEY, tokenizer, weights
from assaymill.storage import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; a missing ``lang`` is filled with it."""
    found = identify(docs, train(docs, F.col("doc_id"))).where(~F.col("rejected"))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, and one of repeated rows."""
    gone = near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").withColumn("_hash", F.xxhash64("text"))
    return left.dropDuplicates(["doc_id", "_hash"]).select(*COLUMNS)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal data."""
    return pseudonymize(docs, DEMO_KEY).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed(docs, weights).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences in windows of 2048."""
    return pack(docs, tokenizer())


STAGES = [("language", language), ("dedup", dedup), ("pii", pii), ("mix", mix), ("pack", packed)]

#: Trained weights, signatures and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs, f"stage-{name}")
    return docs
