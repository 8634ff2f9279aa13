"""Vectors, training data, masks and folds: values by hand, and plans without products of samples and features."""

import pytest
from pyspark.sql import functions as F

from assaymill.operators import contrasts as co
from assaymill.operators import folds as fo
from assaymill.operators import models as mo
from assaymill.operators import negbin as nb
from assaymill.operators import normalise as nm
from assaymill.operators import prepare as pr


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame([(1, "a", 2.0), (1, "c", -1.0), (2, "b", 4.0), (2, "z", 9.0), (3, "z", 1.0)], "sample_id long, feature_id string, value double")


def test_vectors_need_no_grid(cells):
    got = mo.vectors(cells, ["c", "a", "b"])
    assert {r["sample_id"]: r["features"].toArray().tolist() for r in got.collect()} == {1: [-1.0, 2.0, 0.0], 2: [0.0, 0.0, 4.0], 3: [0.0, 0.0, 0.0]}
    assert not any(x in plan(got) for x in ("NestedLoop", "Cartesian"))
    assert [r["features"].size for r in mo.vectors(cells, []).collect()] == [0, 0, 0]


def test_estimators_read_what_was_written(spark, cells):
    """Each pass would make the vectors anew."""
    seen = []

    class Estimator:
        def fit(self, data):
            seen.append(data)

    labels = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "sample_id long, label string")
    mo.Pipeline([], Estimator(), ["a", "b"]).fit(cells, labels)
    assert "Scan parquet" in plan(seen[0]) and "Exchange" not in plan(seen[0])
    assert sorted((*r["features"].toArray(), r["label"]) for r in seen[0].collect()) == [(0.0, 0.0, 0.0), (0.0, 4.0, 1.0), (2.0, 0.0, 0.0)]


def test_elimination_writes_vectors_once(spark, monkeypatch):
    n = [0]
    real = mo.materialize
    monkeypatch.setattr(mo, "materialize", lambda df, name: (n.__setitem__(0, n[0] + (name == "training")), real(df, name))[1])
    dense = spark.range(200).select(F.col("id").alias("sample_id"), F.explode(F.array(*map(F.lit, "abcdefgh"))).alias("feature_id"))
    dense = dense.withColumn("value", F.when(F.col("feature_id") == "e", F.col("sample_id") % 2).otherwise(F.hash("sample_id", "feature_id") % 7).cast("double"))
    labels = spark.range(200).select(F.col("id").alias("sample_id"), (F.col("id") % 2).cast("string").alias("label"))
    left = co.eliminate(dense, labels, list("abcdefgh"), 2)
    assert len(left) == 2 and left[0] == "e" and n[0] == 1


@pytest.mark.parametrize("how,want", [("binary", [1.0, 1.0, 0.0, 1.0]), ("mean", [1.5, 1.5, 0.0, 3.0]), ("median", [1.5, 1.5, 0.0, 3.0])])
def test_ranges_are_met_by_feature_alone(spark, how, want):
    cells = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0), (3, "a", 7.0), (1, "b", 3.0)], "sample_id long, feature_id string, value double")
    ranges = spark.createDataFrame([("a", 0.0, 2.0), ("a", 2.0, 3.0), ("a", 8.0, 9.0), ("b", 3.0, 3.0)], "feature_id string, lo double, hi double")
    got = pr.in_ranges(cells, ranges, how)
    assert [r["value"] for r in got.orderBy("feature_id", "sample_id").collect()] == want
    assert "sample_id" not in "".join(x for x in plan(got).splitlines() if "hashpartitioning" in x)


def test_folds_multiply_inside_rows(spark):
    """No shuffle takes a row per fold, sample and feature, and copies of a table give what the table gives."""
    n = 60
    dense = spark.range(n).select(F.col("id").alias("sample_id"), F.explode(F.array(*map(F.lit, "abcd"))).alias("feature_id"))
    dense = dense.withColumn("value", ((F.col("sample_id") % 3) * F.when(F.col("feature_id") == "b", 5).otherwise(0) + F.pmod(F.hash("sample_id", "feature_id"), F.lit(4))).cast("double"))
    labels = spark.range(n - 2).select(F.col("id").alias("sample_id"), F.concat(F.lit("c"), F.col("id") % 3).alias("label"))
    folds = spark.range(n).select(F.col("id").alias("sample_id"), F.floor(F.col("id") / 3).cast("int").alias("fold")).withColumn("fold", F.col("fold") % 4)
    data = fo.undersampled()(fo.scaled(fo.folded(dense, labels, folds, 4)))
    assert "Exchange hashpartitioning" not in plan(data.values)
    counts = {(r["fold"], r["label"]): r["count"] for r in data.labels.groupBy("fold", "label").count().collect()}
    assert all(len({c for (f, _), c in counts.items() if f == fold}) == 1 for fold in range(4)) and len(counts) == 12
    assert data.values.where("NOT _train").count() == 4 * n
    pred = fo.cross_validate(dense, labels, folds, 4, [fo.undersampled(), fo.scaled, fo.selected(1)])
    rows = pred.collect()
    assert len(rows) == n - 2 and all(r["truth"] == r["prediction"] for r in rows)


def test_pairs_are_read_from_one_array(spark, cells):
    """One shuffle of cells, none of a row per sample and pair."""
    samples = spark.createDataFrame([(1,), (2,), (4,)], "sample_id long")
    pairs = spark.createDataFrame([("a", "c"), ("c", "b"), ("b", "none"), ("none", "c")], "x string, y string")
    got = nm.encode_pairs(cells, samples, pairs)
    held = {1: {"a": 2, "c": -1}, 2: {"b": 4}, 4: {}}
    want = {(s, x, y): int(v.get(x, 0) > v.get(y, 0)) for s, v in held.items() for x, y in [("a", "c"), ("c", "b"), ("b", "none"), ("none", "c")]}
    assert {(r["sample_id"], r["x"], r["y"]): r["value"] for r in got.collect()} == want and got.count() == 12
    assert not any("sample_id" in line and ("x#" in line or "y#" in line) for line in plan(got).splitlines() if "hashpartitioning" in line)


def test_mapping_is_dealt_to_many_tasks(spark, monkeypatch):
    """Few bytes, but each value is halved down many times: small tables must not end in one task."""
    monkeypatch.setattr(nb, "TASK_VALUES", 10)
    obs = spark.range(200).select(F.col("id").alias("sample_id"), F.concat(F.lit("b"), F.col("id") % 2).alias("batch"))
    cells = spark.range(200).select(F.col("id").alias("sample_id"), F.explode(F.array(F.lit("f"), F.lit("g"))).alias("feature_id"))
    cells = cells.withColumn("value", (1 + F.pmod(F.hash("sample_id", "feature_id"), F.lit(30))).cast("double"))
    model = nb.fit(cells, obs, "batch")
    got, n = model.mapping(), model.counts.count()
    tasks = {r["p"] for r in got.select(F.spark_partition_id().alias("p")).collect()}
    assert n > 50 and len(tasks) > n // 20 and got.count() == n
