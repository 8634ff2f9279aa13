"""Small published values and operators without a registered query."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaymill.functions.expressions import bucket_biotype, bucket_project
from assaymill.operators import contrasts as co
from assaymill.operators import evaluation as ev
from assaymill.operators import gram as gr
from assaymill.operators import hierarchy as hi
from assaymill.operators import models as mo
from assaymill.operators import negbin as nb
from assaymill.operators import normalise as nm
from assaymill.operators import prepare as pr
from assaymill.operators import sampling as sp
from assaymill.operators import statistics as st
from assaymill.operators import summaries as sm
from assaymill.sources import counts as src

V = F.col


def cells(spark, data):
    return spark.createDataFrame([(s, f, float(v)) for s, row in data.items() for f, v in row.items()], "sample_id string, feature_id string, value double")


def values(df, key="feature_id"):
    return {r[key]: r["value"] for r in df.collect()}


def grid(spark, samples, features):
    return spark.createDataFrame([(x,) for x in samples], "sample_id string"), spark.createDataFrame([(x, 1000.0) for x in features], "feature_id string, length double")


def test_clr(spark):
    for data in ({"a": 0, "b": 1, "c": 3}, {"b": 1, "c": 3}):  # a zero may be absent
        out = values(nm.clr(cells(spark, {"s": data}), *grid(spark, ["s"], "abc")))
        assert [out[k] for k in "abc"] == pytest.approx([-math.log(2), 0, math.log(2)])


def test_rows_are_independent(spark):
    """A transform of one sample is that sample's part of the transform of all."""
    rng = random.Random(2)
    data = {f"s{i}": {f: rng.randrange(1, 50) for f in "abcdef" if rng.random() < 0.6 or f == "a"} for i in range(6)} | {"none": {}}
    samples, features = grid(spark, data, "abcdef")
    transforms = {
        "clr": lambda c, s: nm.clr(c, s, features), "clr_subset": lambda c, s: nm.clr(c, s, features, subset=features.where("feature_id < 'd'")), "scaled": lambda c, s: nm.clr_scaled(c, s, features, s.withColumn("scale", F.lit(3.0))),
        "robust": lambda c, s: nm.robust_clr(nm.densify(c, s, features)), "alr": lambda c, s: nm.alr(nm.impute_plus_one(nm.densify(c, s, features)), "a"), "fpkm": lambda c, s: nm.fpkm(c, features), "tpm": lambda c, s: nm.tpm(c, features),
        "log": lambda c, s: nm.normalize_total_log1p(c), "ranks": lambda c, s: nm.into_ranks(nm.densify(c, s, features)), "multi": lambda c, s: nm.impute_multi_replace(nm.densify(c, s, features)),
    }
    every = cells(spark, data)
    for name, f in transforms.items():
        whole = {(r["sample_id"], r["feature_id"]): r["value"] for r in f(every, samples).collect()}
        for one in ("s0", "s4", "none"):
            alone = {(r["sample_id"], r["feature_id"]): r["value"] for r in f(every.where(F.col("sample_id") == one), samples.where(F.col("sample_id") == one)).collect()}
            assert alone == pytest.approx({k: v for k, v in whole.items() if k[0] == one}), (name, one)


def test_tpm_and_fpkm(spark):
    c = cells(spark, {"s": {"a": 10, "b": 20, "c": 5}})
    var = spark.createDataFrame([("a", 1000.0), ("b", 2000.0), ("c", 500.0)], "feature_id string, length double")
    assert set(round(x, 3) for x in values(nm.tpm(c, var)).values()) == {333333.333}
    assert set(round(x, 3) for x in values(nm.fpkm(c, var)).values()) == {285714.286}


def test_auroc(spark):
    d = spark.createDataFrame([(i, "g", v) for i, v in enumerate([1.0, 2.0, 2.0, 3.0, 5.0])], "sample_id int, feature_id string, value double")
    obs = spark.createDataFrame([(i, str(y)) for i, y in enumerate([0, 1, 0, 1, 1])], "sample_id int, label string")
    out = {r["label"]: r["auroc"] for r in st.auroc(d, obs, "label").collect()}
    assert out["1"] == pytest.approx(0.916667, abs=1e-6) and out["0"] == pytest.approx(1 - 0.916667, abs=1e-6)


def test_metrics(spark):
    table = [[5, 1, 0], [2, 3, 1], [0, 1, 7]]
    pred = spark.createDataFrame([(f"{i}{j}{k}", str(i), str(j)) for i, row in enumerate(table) for j, n in enumerate(row) for k in range(n)], "sample_id string, truth string, prediction string")
    m = ev.metrics(ev.confusion(pred)).first()
    want = {"accuracy": 0.75, "balanced_accuracy": 0.736111, "kappa": 0.621212, "mcc": 0.623579, "jaccard": 0.592593, "fowlkes_mallows": 0.598312}
    for k, v in want.items():
        assert m[k] == pytest.approx(v, abs=1e-6)


def test_bh(spark):
    p = spark.createDataFrame(list(enumerate([0.01, 0.04, 0.03, 0.2])), "k int, p double")
    out = [r["bh"] for r in st.adjust(p, "p", "k").orderBy("k").collect()]
    assert out == pytest.approx([0.04, 0.053333, 0.053333, 0.2], abs=1e-6)


def test_proportionality(spark):
    rows = {"0": {f"f{i}": math.log(x) for i, x in enumerate([8, 1, 2, 3])}, "1": {f"f{i}": math.log(x) for i, x in enumerate([4, 5, 6, 7])}}
    out = {(r["x"], r["y"]): r for r in gr.proportionality(cells(spark, rows)).collect()}
    assert out["f0", "f1"]["phi"] == pytest.approx(11.035206, abs=1e-5) and out["f1", "f2"]["phi"] == pytest.approx(0.100739, abs=1e-5)
    assert out["f0", "f1"]["corr"] == pytest.approx(-1) and out["f1", "f2"]["corr"] == pytest.approx(1)


def test_overlaps(spark):
    sets = src.gene_sets(spark, {"a": ["x", "y", "z"], "b": ["y", "z"], "c": ["q"]})
    out = {(r["x"], r["y"]): r["n"] for r in sm.pairwise_overlaps(sets).collect()}
    assert out == {("a", "b"): 2, ("a", "c"): 0, ("b", "c"): 0}


def test_ladder(spark):
    df = spark.createDataFrame([("a",)] * 10 + [("b",)] * 1000, "label string")
    out = {r["label"]: r["target"] for r in sp.spaced_targets(df, "label", 5).collect()}
    assert out == {"a": 32, "b": 1000}


def test_read_counts_and_lists(spark, tmp_path):
    head = "# made by a test\ngene_id\tgene_name\tgene_type\tunstranded\tstranded_first\tstranded_second\ttpm_unstranded\n"
    for n in (1, 2):
        (tmp_path / f"s{n}.tsv").write_text(head + "N_unmapped\t\t\t9\t9\t9\t\n" + f"G1\tg\tprotein_coding\t{n}\t0\t0\t0.5\nG2\th\tlncRNA\t0\t1\t2\t0.5\n")
    got = {(r["file"], r["feature_id"]): r["value"] for r in src.read_count_files(spark, str(tmp_path / "*.tsv")).collect()}
    assert got == {("s1.tsv", "G1"): 1.0, ("s1.tsv", "G2"): 0.0, ("s2.tsv", "G1"): 2.0, ("s2.tsv", "G2"): 0.0}
    (tmp_path / "lists").mkdir()
    (tmp_path / "lists" / "one.txt").write_text("a\nb\n\n")
    assert {tuple(r) for r in src.read_feature_lists(spark, str(tmp_path / "lists")).collect()} == {("one", "a"), ("one", "b")}


def test_results_cache_and_writes(spark, tmp_path):
    for m in ("x", "y"):
        (tmp_path / m).mkdir()
        (tmp_path / m / "misc.csv").write_text("fold,acc,f1\n0,0.5,0.25\n")
    out = src.gather_results(spark, str(tmp_path / "*" / "misc.csv"), "fold int, acc double, f1 double", ["acc", "f1"])
    assert {(r["model"], r["metric"], r["value"]) for r in out.collect()} == {(m, k, v) for m in "xy" for k, v in (("acc", 0.5), ("f1", 0.25))}
    calls = []
    make = lambda i=0: (calls.append(i), spark.range(3))[1]
    path = str(tmp_path / "cache")
    assert src.cached(spark, path, make).count() == src.cached(spark, path, make).count() == 3 and len(calls) == 1
    assert src.cached_rounds(spark, str(tmp_path / "r"), 2, make).count() == 6
    src.write_table(spark.range(3).withColumn("k", V("id") % 2), str(tmp_path / "t"), "csv", ["k"])
    assert spark.read.csv(str(tmp_path / "t"), header=True).count() == 3


def test_harmonise(spark):
    a = spark.createDataFrame([("1", "x", 1), (None, "y", 2), ("1", "z", 3)], "id string, n string, only int")
    b = spark.createDataFrame([("2", "w")], "key string, n string")
    assert sorted(r["id"] for r in src.harmonise([(a, {}), (b, {"key": "id"})], "id").collect()) == ["1", "2"]


def test_small_filters(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", float("inf")), ("c", None)], "k string, value double")
    clean, n = pr.null_infinite(df)
    assert n.first()[0] == 1 and clean.where("value is null").count() == 2
    names = spark.createDataFrame([("a", "A")], "old string, new string")
    assert {r["k"] for r in pr.replace_values(df, "k", names).collect()} == {"A", "b", "c"}
    assert pr.replace_values(df, "k", names, "drop").count() == 1
    with pytest.raises(ValueError):
        pr.replace_values(df, "k", names, "error")
    one = spark.createDataFrame([("TCGA-1", "protein_coding"), ("zz", "lincRNA")], "p string, b string").select(bucket_project(V("p")).alias("p"), bucket_biotype(V("b")).alias("b")).collect()
    assert [tuple(r) for r in one] == [("TCGA", "protein_coding"), ("other", "lncRNA")]


def test_groups_stay_in_a_fold(spark):
    df = spark.createDataFrame([(i % 13, "xy"[i % 2]) for i in range(200)], "g int, label string")
    folds = sp.group_kfold(df, "g", "label", 4).collect()
    assert len(folds) == 13 and {r["fold"] for r in folds} == {0, 1, 2, 3}


def test_cycles_and_votes(spark):
    loop = spark.createDataFrame([("a", "b"), ("b", "a")], "parent string, child string")
    assert hi.acyclic(loop).first()[0] is False
    s1, s2 = (spark.createDataFrame([("s", c, v) for c, v in zip("xy", vs)], "sample_id string, class string, score double") for vs in ((0.9, 0.1), (0.1, 0.9)))
    out = {r["class"]: r["score"] for r in mo.soft_vote([(s1, 3.0), (s2, 1.0)]).collect()}
    assert out["x"] == pytest.approx(0.7)


def test_parameter_grid(spark):
    grid = ev.parameter_grid(spark, {"a": [1, 2], "b": ["x", "y"]}, (V("a") == 2) & (V("b") == "y")).collect()
    assert sorted(r["name"] for r in grid) == ["1_x", "1_y", "2_x"]


def test_spec_pipeline(spark):
    d = cells(spark, {f"s{i}": {"a": i % 2 * 5 + i / 10, "b": 1} for i in range(12)})
    labels = spark.createDataFrame([(f"s{i}", "odd" if i % 2 else "even") for i in range(12)], "sample_id string, label string")
    steps = {"scale": (nm.fit_scaler, nm.apply_scaler)}
    for model in ("logistic", "tree"):
        out = mo.from_spec({"steps": ["scale"], "model": model}, steps, ["a", "b"]).fit(d, labels).predict(d).join(labels, "sample_id")
        assert out.where("prediction = label").count() == 12


def test_hypergeometric(spark):
    p = spark.range(1).select(st.hypergeometric_tail(F.lit(2), F.lit(3), F.lit(4), F.lit(10)).alias("p")).first()["p"]
    assert p == pytest.approx((6 * 6 + 4) / 120)


def test_ranks_by_parts_equal_plain_ranks(spark):
    from assaymill.functions.expressions import hash_rank, value_ranks

    rng = random.Random(3)
    rows = [(i, rng.choice(["x", "y", None]), float(rng.randrange(300)) if rng.random() < 0.9 else None) for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, label string, v double")
    values = sorted(v for *_, v in rows if v is not None)
    got = {r["value"]: (r["rank"], r["n"]) for r in value_ranks(df, "v").collect()}
    assert got == {v: (sum(x < v for x in values) + (values.count(v) + 1) / 2, values.count(v)) for v in set(values)}
    key = lambda i: hashlib.md5(f"7|{i}".encode()).hexdigest()
    for by in ([], ["label"]):
        groups = {}
        for i, label, _ in rows:
            groups.setdefault(label if by else 0, []).append(i)
        want = {i: (k + 1, len(ids)) for ids in groups.values() for k, i in enumerate(sorted(ids, key=key))}
        assert {r["id"]: (r["_r"], r["_n"]) for r in hash_rank(df, "id", 7, by).collect()} == want


def test_near_candidates_recall(spark):
    """Of the truly nearest pairs at least nine in ten are proposed, and far from all pairs."""
    rng = random.Random(5)
    rows = []
    for c in range(30):
        centre = [rng.uniform(0, 100) for _ in range(12)]
        for i in range(8):
            rows += [(f"s{c}-{i}", f"f{j}", x + rng.gauss(0, 1)) for j, x in enumerate(centre)]
    dense = spark.createDataFrame(rows, "sample_id string, feature_id string, value double")
    obs = dense.select("sample_id", F.lit("l").alias("label")).distinct()
    nearest = {tuple(sorted((r["sample_id"], r["other"]))) for r in sp.neighbours(dense, obs, "label", 1).collect()}
    found = {(r["sample_id"], r["other"]) for r in sp.near_candidates(dense, obs, 1).collect()}
    assert len(nearest & found) >= 0.9 * len(nearest) and len(found) < 240 * 239 / 2 / 3


def test_batches_of_one_kind_stay_as_they_are(spark):
    rows = [(f"{b}{i}", "g", float(v)) for b in "ab" for i, v in enumerate([1, 2, 2, 3, 5, 8, 9, 4])]
    obs = spark.createDataFrame([(s, s[0]) for s, *_ in rows], "sample_id string, batch string")
    dense = spark.createDataFrame(rows, "sample_id string, feature_id string, value double")
    for reference in ("a", None):
        out = {r["sample_id"]: r["value"] for r in nb.fit(dense, obs, "batch", reference=reference, to_mean=reference is None).adjust(dense).collect()}
        assert out == {s: v for s, _, v in rows}


def test_association_cutoff_and_inclusion():
    assert co.rho_cutoff(100, 1) == pytest.approx(math.tanh(1.959964 / math.sqrt(97)), abs=1e-6)
    assert co.rho_cutoff(100, 1000) > co.rho_cutoff(100, 1) > co.rho_cutoff(1000, 1)
    score = lambda kept: sum({"a": 3, "b": -1, "c": 2}[g] for g in kept)
    assert mo.inclusion(["a", "b", "c"], score) == ["a", "c"]


def test_named_aggregates_reject_unknown_names(spark):
    with pytest.raises(ValueError):
        sm.aggregate_by_name(spark.range(3), [], "id", ["mean", "mood"])


def test_plage_is_the_leading_singular_vector(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (5, 9)) + np.outer(rng.normal(0, 2, 5), rng.normal(0, 1, 9))
    dense = spark.createDataFrame([(f"s{j}", f"f{i}", float(x[i, j])) for i in range(5) for j in range(9)], "sample_id string, feature_id string, value double")
    sets = spark.createDataFrame([("a", f"f{i}") for i in range(4)] + [("b", "f4")], "set_name string, feature_id string")
    got = {(r["set_name"], r["sample_id"]): r["score"] for r in co.plage(dense, sets).collect()}
    z = (x - x.mean(1, keepdims=True)) / x.std(1, ddof=1, keepdims=True)
    for name, rows in (("a", z[:4]), ("b", z[4:])):
        v = np.linalg.svd(rows, full_matrices=False)[2][0]
        v = v if v @ rows.mean(0) >= 0 else -v
        assert [got[name, f"s{j}"] for j in range(9)] == pytest.approx(v.tolist(), abs=1e-9)


def test_tails(spark):
    zs = [0.0, 0.3, -1.0, 2.5, 5.0, -9.0, 20.0]
    got = [r["p"] for r in spark.createDataFrame([(i, z) for i, z in enumerate(zs)], "i int, z double").withColumn("p", st.two_sided_p(F.col("z"))).orderBy("i").collect()]
    assert got == pytest.approx([math.erfc(abs(z) / math.sqrt(2)) for z in zs], rel=2e-7)
    cases = [(0, 5, 5, 20), (3, 5, 6, 20), (5, 5, 5, 20), (6, 5, 9, 20), (2, 18, 4, 20), (40, 100, 300, 1000), (0, 0, 3, 10)]
    exact = lambda h, d, g, t: sum(math.comb(g, i) * math.comb(t - g, d - i) for i in range(h, min(d, g) + 1)) / math.comb(t, d)
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, h long, d long, g long, t long")
    got = [r["p"] for r in df.withColumn("p", st.hypergeometric_tail(*map(F.col, "hdgt"))).orderBy("i").collect()]
    assert got == pytest.approx([exact(*c) for c in cases], abs=1e-9)
