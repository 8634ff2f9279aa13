"""Lookups under skew and tables in the shared folder."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from assaymill import storage


def test_lookup_with_hot_keys_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(storage, "SMALL", 0)
    left = spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.lit(1)).when(F.col("id") % 100 == 1, None).otherwise(F.col("id")).cast("long").alias("k"), "id")
    table = left.where("k is not null and id % 7 <> 0").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    got = {(r["id"], r["top"]) for r in storage.lookup(left, table, ["k"], "n").collect()}
    want = {(r["id"], r["top"]) for r in left.join(table, "k", "left").collect()}
    assert got == want and len(got) == 6000


def test_materialize_uses_the_configured_folder(spark, monkeypatch, tmp_path):
    assert storage.scratch_dir(spark) == (spark.conf.get("spark.checkpoint.dir", None) or storage._local[0]).rstrip("/")
    monkeypatch.setattr(storage, "scratch_dir", lambda _: f"file://{tmp_path}")
    assert storage.materialize(spark.range(5), "five").count() == 5 and len(list(tmp_path.iterdir())) == 1


@pytest.mark.parametrize("small", [0, 10_000])
def test_inner_lookup(spark, monkeypatch, small):
    monkeypatch.setattr(storage, "SMALL", small)
    left = spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.lit(1)).when(F.col("id") % 100 == 1, None).otherwise(F.col("id") % 900).cast("long").alias("k"), "id")
    table = left.where("k is not null and k % 7 <> 0").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    got = sorted((r["id"], r["k"], r["top"]) for r in storage.lookup(left, table, ["k"], "n", inner=True).collect())
    assert got == sorted((r["id"], r["k"], r["top"]) for r in left.join(table, "k").collect())


def test_local_folder_without_a_configured_one():
    def session(master):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: master if key == "spark.master" else default))

    assert storage.scratch_dir(session("local[4]")) == storage.scratch_dir(session("local[4]")) and storage.scratch_dir(session("local[4]")).startswith("file:///")
    with pytest.raises(ValueError):
        storage.scratch_dir(session("spark://host:7077"))
