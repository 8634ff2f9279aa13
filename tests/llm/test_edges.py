"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names, for every operator."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from assaymill.llm import byte_bpe, language_id, license_scan, mixing, near_dedup, order_minhash, packing, periodic_runs, pseudonyms, quality_classifier, quality_rules, recurrent_lm
from assaymill.llm.queries import tokenizer, weights
from tests.llm.data import frame, rows


def classifier(docs):
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    return quality_classifier.quality(docs, quality_classifier.train(docs, labels), F.col("source"), F.col("lang"))


OPERATORS = {
    "rules": lambda d: quality_rules.quality_rules(d),
    "classifier": classifier,
    "fingerprints": lambda d: order_minhash.edit_fingerprints(d),
    "lm": lambda d: recurrent_lm.log_likelihood(d, recurrent_lm.train(d, F.col("doc_id"))),
    "near": lambda d: near_dedup.near_duplicates(d),
    "mixing": lambda d: mixing.mixture(d, weights),
    "language": lambda d: language_id.identify(d, language_id.train(d, F.col("doc_id"))),
    "pii": lambda d: pseudonyms.pseudonymize(d, "k"),
    "bpe": lambda d: byte_bpe.encode(d, tokenizer().replace("word_bpe_49k", "byte_bpe_50k")),
    "runs": lambda d: periodic_runs.periodic_runs(d),
    "packing": lambda d: packing.pack(d, tokenizer()).where("start = 0"),
}
NOTICE = "Released under the MIT License."


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_its_result(spark, name):
    docs = frame(spark)
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in OPERATORS[name](docs).collect())
    assert got == sorted((r[0] is not None, r[0] or 0) for r in rows())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](frame(spark, [])).collect() == []


def test_empty_table_scans_and_packs_nothing(spark):
    assert license_scan.scan(frame(spark, [])).collect() == []
    assert packing.pack(frame(spark, []), tokenizer()).collect() == []
    assert mixing.mixed(frame(spark, []), weights).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_null_only_table(spark, name):
    docs = frame(spark, [(None,) * 12] * 3)
    assert len(OPERATORS[name](docs).collect()) == 3


def test_license_rows_of_odd_tables(spark):
    odd = [(i, f"x {NOTICE} y" if t else t, *rest) for i, t, *rest in rows()]
    found = license_scan.scan(frame(spark, odd)).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(i for i, t, *_ in odd if t) and {r["license"] for r in found} == {"MIT"}
    assert license_scan.scan(frame(spark, [(None,) * 12] * 3)).collect() == []
    assert [r["doc_id"] for r in license_scan.scan(frame(spark, [(None, NOTICE, *[None] * 10)] * 2)).collect()] == [None, None]


def test_ties_are_settled_alike(spark):
    """Equal spans, equal posteriors, equal values: the same whatever the order of rows."""
    data = [(i, f"{NOTICE} ip 10.0.0.{i % 3} Licensed under CC BY 4.0. {NOTICE}", "en", "a", 1, *[None] * 7) for i in range(30)]
    for f in (license_scan.scan, lambda d: pseudonyms.pseudonymize(d, "k").select("doc_id", "text", "pii_kinds"), lambda d: classifier(d), lambda d: packing.pack(d.coalesce(1).orderBy("doc_id"), tokenizer())):
        a, b = (sorted(map(repr, f(frame(spark, x).coalesce(1)).collect())) for x in (data, data[::-1]))
        assert a == b
    texts = {r["text"].split(" ip ")[1].split()[0] for r in pseudonyms.pseudonymize(frame(spark, data), "k").collect()}
    assert len(texts) == 3


def test_a_very_long_text(spark):
    """Two million words in one row, beside a short one."""
    long = "alpha beta, gamma 12 " * 500_000 + NOTICE
    docs = spark.createDataFrame([(1, long, "en", "a"), (2, "short one", "en", "a")], "doc_id long, text string, lang string, source string")
    assert [(r["doc_id"], r["start_char"]) for r in license_scan.scan(docs).collect()] == [(1, len(long) - len(NOTICE))]
    assert sum(r["length"] for r in packing.pack(docs, tokenizer()).where("doc_id = 1").collect()) > 2_000_000
    near = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs).collect()}
    assert near[1]["n_shingles"] > 4 and near[1]["kept"] and near[2]["kept"]
    scored = {r["doc_id"]: r for r in recurrent_lm.log_likelihood(docs, recurrent_lm.train(docs, F.col("doc_id"))).collect()}
    assert scored[1]["n_tokens"] == 2_000_006


def test_a_very_long_text_in_the_other_operators(spark):
    """400,000 words in one row: counted, fingerprinted, mixed and rewritten to their end."""
    long = "alpha beta, gamma 12 " * 100_000 + "ip 10.1.2.3"
    docs = spark.createDataFrame([(1, long, "en", "a"), (2, "short one", "en", "a")], "doc_id long, text string, lang string, source string")
    rules = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    assert rules[1]["n_words"] == 400_002 and rules[1]["base_failed"] and rules[2]["n_words"] == 2
    prints = {r["doc_id"]: r for r in order_minhash.edit_fingerprints(docs).collect()}
    assert prints[1]["n_chars"] == len(long) and prints[1]["fingerprint"] != prints[2]["fingerprint"]
    assert {r["doc_id"]: r["size"] for r in mixing.mixture(docs, weights).collect()} == {1: 400_002, 2: 2}
    text = pseudonyms.pseudonymize(docs, "k").where("doc_id = 1").first()["text"]
    assert text.startswith(long[:-11]) and text != long


def test_clashing_columns_survive(spark):
    names = ("_unit", "_nth", "_copies", "_found", "size", "copies", "kept")
    docs = frame(spark).select("doc_id", "text", "lang", "source").withColumns({n: F.lit(n) for n in names})
    for out in (mixing.mixed(docs, weights), pseudonyms.pseudonymize(docs, "k"), language_id.identify(docs, language_id.train(docs, F.col("doc_id")))):
        assert all(r[n] == n for r in out.select(*names).collect() for n in names)
