"""Registered queries of the numbered operators: thin digests over the operators' own results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaymill.llm import byte_bpe, license_scan, oracles, periodic_runs, quality_classifier, recurrent_lm
from assaymill.llm.conversation_trie import shared_trie
from assaymill.llm.language_id import identify, train
from assaymill.llm.mixing import mixture
from assaymill.llm.near_dedup import near_duplicates
from assaymill.llm.order_minhash import edit_fingerprints
from assaymill.llm.packing import pack
from assaymill.llm.pseudonyms import pseudonymize
from assaymill.llm.quality_rules import quality_rules


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir)).drop("distance")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.quality(docs, model, F.col("source"), F.col("lang"))


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprints(documents(spark, sf_dir))


def tokenizer() -> str:
    """Path of the vocabulary file; it is part of an installed package and never copied."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = recurrent_lm.train(docs.where(~fold(1)), F.col("doc_id"))
    scored = recurrent_lm.log_likelihood(docs, model)
    return scored.select("doc_id", fold(1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer())


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), shingle_words=3, percent=85)


def fold(held: int) -> Column:
    """Whether crc32 of the id's text leaves ``held`` modulo 5; a row without an id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == held, F.lit(False))


def weights(sources: list[str | None]) -> list[float]:
    """3, 1, 2, repeating."""
    return [(3.0, 1.0, 2.0)[i % 3] for i in range(len(sources))]


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(documents(spark, sf_dir), weights).select("doc_id", "size", "source_size", "target", "taken")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs.where(~fold(0) & F.col("doc_id").isNotNull()), F.col("doc_id"))
    found = identify(docs.select("doc_id", "text", fold(0).alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


#: Stands in for a secret that a deployment passes itself.
DEMO_KEY = "assaymill demonstration key"


def op10_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymize(documents(spark, sf_dir).select("doc_id", "text"), DEMO_KEY)
    return out.select("doc_id", "text", F.size("pii_kinds").alias("n_pii"), F.array_join("pii_kinds", ",").alias("kinds"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_license_scan, op3_quality_classifier, op4_order_minhash, op5_lm_scoring, op6_packing, op7_near_dedup, op8_mixing, op9_language_id, op10_pii_pseudonyms, op11_bpe, op12_conversation_trie, op13_periodic_runs)}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": oracles.op1(), "op7_near_dedup": oracles.OP7, "op12_conversation_trie": oracles.OP12}
