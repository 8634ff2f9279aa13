"""Tails, orders, block products, moderated tests and batch models against slow or exact readings."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaymill.functions import ordering, tails
from assaymill.operators import folds as fo
from assaymill.operators import gram as gr
from assaymill.operators import moderated as md
from assaymill.operators import negbin as nb
from assaymill.operators import permutation as pm
from assaymill.operators import statistics as st

V = F.col


def t_exact(t, df):
    """Two-sided tail for whole degrees of freedom, by the finite sums over powers of the cosine."""
    a = math.atan2(abs(t), math.sqrt(df))
    c2 = Fraction(df) / (Fraction(df) + Fraction(t) ** 2)
    if df % 2:
        term, s = Fraction(1), Fraction(0)
        for k in range((df - 1) // 2):
            term = term if k == 0 else term * c2 * Fraction(2 * k, 2 * k + 1)
            s += term
        return 1 - 2 / math.pi * (a + (math.sin(a) * math.cos(a) * float(s) if df > 1 else 0))
    term, s = Fraction(1), Fraction(0)
    for k in range(df // 2):
        term = term if k == 0 else term * c2 * Fraction(2 * k - 1, 2 * k)
        s += term
    return 1 - math.sin(a) * float(s)


def chi2_exact(x, df):
    """Upper tail: a finite sum, and the complementary error function for odd degrees."""
    h, out = x / 2, 0.0 if df % 2 == 0 else math.erfc(math.sqrt(x / 2))
    for k in range(df // 2):
        out += math.exp(-h + (k + df % 2 / 2) * math.log(h) - math.lgamma(k + 1 + df % 2 / 2))
    return out


def f_exact(f, d1, d2):
    """Upper tail for even d1, as a finite sum of a beta function's terms."""
    x = d2 / (d2 + d1 * f)
    return sum(math.exp(math.lgamma(d2 / 2 + k) - math.lgamma(d2 / 2) - math.lgamma(k + 1) + d2 / 2 * math.log(x) + k * math.log(1 - x)) for k in range(d1 // 2))


def column(spark, rows, schema, make):
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r["x"] for r in df.select("i", make.alias("x")).orderBy("i").collect()]


def test_tails_against_closed_forms(spark):
    ts = [(t, df) for t in (0.01, 0.7, 2.0, -3.3, 9.0) for df in (1, 2, 3, 8, 31, 400)]
    assert column(spark, ts, "t double, df double", F.exp(tails.ln_t_two_sided(V("t"), V("df")))) == pytest.approx([t_exact(t, df) for t, df in ts], rel=1e-8, abs=1e-13)
    xs = [(x, df) for x in (0.001, 0.9, 4.0, 30.0, 300.0) for df in (1, 2, 5, 24, 301)]
    assert column(spark, xs, "x double, df double", F.exp(tails.ln_chi2_upper(V("x"), V("df")))) == pytest.approx([chi2_exact(x, df) for x, df in xs], rel=1e-8)
    fs = [(f, a, b) for f in (0.05, 1.0, 3.0, 40.0) for a in (2, 6, 40) for b in (1, 5, 77, 5000)]
    assert column(spark, fs, "f double, a double, b double", F.exp(tails.ln_f_upper(V("f"), V("a"), V("b")))) == pytest.approx([f_exact(*x) for x in fs], rel=1e-8)


def test_tails_far_out_and_at_the_edges(spark):
    far = column(spark, [(400.0, 3.0), (1e5, 40.0), (0.0, 5.0)], "t double, df double", tails.ln_t_two_sided(V("t"), V("df")) / math.log(10))
    assert far[0] == pytest.approx(math.log10(4 / (math.pi) * 3**1.5 / 3 / 400.0**3), abs=1e-4) and far[1] < -130 and far[2] == pytest.approx(0, abs=1e-12)
    assert column(spark, [(0.0, 2.0), (4000.0, 2.0)], "x double, df double", tails.ln_chi2_upper(V("x"), V("df"))) == pytest.approx([0.0, -2000.0])


def test_gamma_functions(spark):
    xs = [(x,) for x in (0.03, 0.5, 1.0, 2.5, 10.0, 333.3)]
    assert column(spark, xs, "a double", tails.ln_gamma(V("a"))) == pytest.approx([math.lgamma(x) for x, in xs], abs=1e-10)
    di, tri = column(spark, xs, "a double", tails.digamma(V("a"))), column(spark, xs, "a double", tails.trigamma(V("a")))
    for (x,), d, t in zip(xs, di, tri):
        n = 200_000  # sums to n, and the rest as integrals
        assert d == pytest.approx(math.log(n + x) - 0.5 / (n + x) - math.fsum(1 / (x + k) for k in range(n)), abs=1e-9)
        assert t == pytest.approx(math.fsum(1 / (x + k) ** 2 for k in range(n)) + 1 / (n + x) + 0.5 / (n + x) ** 2, rel=1e-10)
    assert column(spark, [(t,) for t in tri], "a double", tails.inverse_trigamma(V("a"))) == pytest.approx([x for x, in xs], rel=1e-9)


def test_orders_over_parts(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, "a", "a", "a", "b"]), rng.choice([None, 1.0, 2.0, 2.0, rng.random()])) for i in range(400)]
    df = spark.createDataFrame(rows, "i long, g string, v double").repartition(7)
    got = {r["i"]: r for r in ordering.ordered(df, ["v", "i"], ["g"]).collect()}
    ranks = {r["i"]: r["_rank"] for r in ordering.ordered(df, ["v"], ["g"]).collect()}
    key = lambda r: (r[2] is not None, r[2] or 0, r[0])
    for g in (None, "a", "b"):
        mine = sorted((r for r in rows if r[1] == g), key=key)
        for n, r in enumerate(mine):
            assert (got[r[0]]["_nth"], got[r[0]]["_rows"]) == (n + 1, len(mine))
            assert ranks[r[0]] == 1 + sum(key(x)[:2] < key(r)[:2] for x in mine)
    some = spark.createDataFrame([(i, float(i % 7)) for i in range(103)], "i long, v double").repartition(5)
    upto = {r["i"]: (r["_upto"], r["_total"], r["t"]) for r in ordering.running_sum(some, "v", ["i"]).withColumn("t", ordering.tile(10)).collect()}
    assert upto == {i: (sum(k % 7 for k in range(i + 1)), sum(k % 7 for k in range(103)), 1 + (i // 11 if i < 33 else 3 + (i - 33) // 10)) for i in range(103)}


def test_adjusted_p_in_parts(spark):
    rng = random.Random(5)
    rows = [(i, "xy"[i % 2], None if i % 50 == 0 else round(rng.random() ** 3, 3)) for i in range(300)]
    got = {r["i"]: r for r in st.adjust(spark.createDataFrame(rows, "i long, g string, p double").repartition(6), "p", "i", ["g"]).collect()}
    for g in "xy":
        mine = sorted((p, i) for i, h, p in rows if h == g and p is not None)
        n, low, high = len(mine), 1.0, 0.0
        for k in range(n, 0, -1):
            low = min(low, mine[k - 1][0] * n / k)
            assert got[mine[k - 1][1]]["bh"] == pytest.approx(low)
        for k in range(n):
            high = max(high, mine[k][0] * (n - k))
            assert got[mine[k][1]]["holm"] == pytest.approx(min(high, 1))
    assert all(got[i]["bh"] is None for i, _, p in rows if p is None)


def matrix(spark, x, kind="long"):
    return spark.createDataFrame([(i, f"f{j:02d}", float(x[i, j])) for i in range(x.shape[0]) for j in range(x.shape[1]) if x[i, j]], "sample_id long, feature_id string, value double").repartition(3), spark.createDataFrame([(f"f{j:02d}",) for j in range(x.shape[1])], "feature_id string")


def test_products_of_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.poisson(0.7, (60, 11)).astype(float)
    x[:, 4] = 0
    cells, features = matrix(spark, x)
    for block, rows in ((512, 4096), (3, 7)):
        got = {(r["x"], r["y"]): r["product"] for r in gr.gram(cells, features, 60, block, rows).collect()}
        assert got == {(f"f{i:02d}", f"f{j:02d}"): float(x[:, i] @ x[:, j]) for i in range(11) for j in range(i, 11)}
    c = gr.Components(cells, features, 60, 3)
    value = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert [r["variance"] for r in c.variances.orderBy("component").collect()] == pytest.approx(value[:3].tolist())
    scores = np.array([r["score"] for r in c.scores(cells, spark.range(60).withColumnRenamed("id", "sample_id")).where("component = 1").orderBy("sample_id").collect()])
    assert scores.mean() == pytest.approx(0, abs=1e-9) and scores.var(ddof=1) == pytest.approx(value[0])
    with pytest.raises(ValueError):
        gr.Components(cells, spark.range(1025).select(V("id").cast("string").alias("feature_id")), 60, 1)


def test_auroc_of_sparse_and_negative_cells(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-2, 3, (50, 4)).astype(float)
    x[:, 3] = 0
    labels = [("a", "b", None)[i % 3] for i in range(50)]
    cells, features = matrix(spark, x)
    obs = spark.createDataFrame([(i, y) for i, y in enumerate(labels)], "sample_id long, label string")
    got = {(r["feature_id"], r["label"]): r["auroc"] for r in st.auroc(cells, obs, "label", features).collect()}
    for j in range(4):
        for y in ("a", "b", None):
            own, rest = [x[i, j] for i in range(50) if labels[i] == y], [x[i, j] for i in range(50) if labels[i] != y]
            assert got[f"f{j:02d}", y] == pytest.approx(sum((p > q) + (p == q) / 2 for p in own for q in rest) / len(own) / len(rest))


def test_permuted_sums_in_blocks(spark):
    rng = np.random.default_rng(3)
    x = rng.poisson(1.0, (40, 6)).astype(float)
    cells, _ = matrix(spark, x)
    drawn = pm.permuted(spark.range(40).withColumnRenamed("id", "sample_id"), 13, 9)
    inside = {r["sample_id"]: set(r["rounds"]) for r in drawn.collect()}
    assert all(sum(k in v for v in inside.values()) == 13 for k in range(1, 10))
    for block, rows in ((256, 2048), (2, 5)):
        got = {(r["feature_id"], r["round"]): (r["s"], r["q"]) for r in pm.permuted_sums(cells, drawn, 40, 9, block, rows).collect()}
        for j in range(6):
            for k in range(1, 10):
                own = x[[i for i in range(40) if k in inside.get(i, ())], j]
                assert got.get((f"f{j:02d}", k), (0, 0)) == (own.sum(), (own**2).sum())


def test_planted_set_has_the_least_p(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(5, 1, (60, 8))
    x[:30, :3] += 3
    cells, _ = matrix(spark, x)
    obs = spark.createDataFrame([(i, "in" if i < 30 else "out") for i in range(60)], "sample_id long, label string")
    sets = spark.createDataFrame([("planted", f"f{j:02d}") for j in range(3)] + [("other", f"f{j:02d}") for j in range(3, 8)], "set_name string, feature_id string")
    seen, drawn = pm.permuted_t(cells, obs, "label", "in", 199)
    p = {r["set_name"]: r["p"] for r in pm.set_mean_p(seen, drawn, sets).collect()}
    assert p["planted"] == 1 / 200 and p["other"] > 0.05
    top = {r["feature_id"]: r["p_max"] for r in pm.max_t(seen, drawn).collect()}
    assert all(top[f"f{j:02d}"] == 1 / 200 for j in range(3)) and all(top[f"f{j:02d}"] > 0.05 for j in range(3, 8))


def test_moderated_tests(spark):
    """Equal variances leave an endless prior, and t is the plain one with all features' variance."""
    moments = spark.createDataFrame([(f"f{i}", "a", 5, 5, 2.0 + i, 1.0, 4.0, 4.0) for i in range(6)], "feature_id string, label string, n1 long, n2 long, mean1 double, mean2 double, var1 double, var2 double")
    prior = md.variance_prior(md.pooled(moments)).first()
    assert prior["prior_df"] == float("inf")
    scale = math.exp(math.log(4) - (column(spark, [(4.0,)], "a double", tails.digamma(V("a")))[0] - math.log(4)))
    assert prior["prior_variance"] == pytest.approx(scale)
    got = {r["feature_id"]: r for r in md.moderated_t(moments).collect()}
    for i in range(6):
        t = (1.0 + i) / math.sqrt(scale * 2 / 5)
        assert got[f"f{i}"]["t"] == pytest.approx(t) and got[f"f{i}"]["df"] == 48 and got[f"f{i}"]["p"] == pytest.approx(t_exact(t, 48), rel=1e-8)
    least = {r["feature_id"]: r for r in md.moderated_t(moments, 1.0).collect()}
    se = math.sqrt(scale * 2 / 5)
    for i in range(6):
        near, far = i / se, (2 + i) / se
        assert least[f"f{i}"]["p"] == pytest.approx(t_exact(near, 48) / 2 + t_exact(far, 48) / 2, rel=1e-8) and least[f"f{i}"]["t"] == pytest.approx(near)


def cdf(v, mu, r):
    p, out = (r / (r + mu)) ** r, 0.0
    for k in range(int(v) + 1):
        out += p
        p *= (k + r) / (k + 1) * mu / (r + mu)
    return out


def test_distribution_and_quantiles(spark):
    cases = [(v, mu, r) for v in (0, 1, 7, 60) for mu in (0.3, 5.0, 40.0) for r in (0.4, 3.0, 200.0)]
    assert column(spark, cases, "v double, mu double, r double", F.exp(nb.ln_cdf(V("v"), V("mu"), V("r")))) == pytest.approx([cdf(*c) for c in cases], rel=1e-8)
    asked = [(cdf(v, mu, r), mu * 1.7, r) for v, mu, r in cases if cdf(v, mu, r) < 1 - 1e-6]
    want = []
    for p, mu, r in asked:
        want.append(next(k for k in range(100_000) if cdf(k, mu, r) >= p * (1 - 1e-9)))
    assert column(spark, asked, "p double, mu double, r double", nb.quantile(F.ln("p"), V("mu"), V("r"))) == want


def test_batch_model(spark):
    rng = np.random.default_rng(6)
    n, sizes = 60, {"a": 8.0, "b": 2.0}
    batch, group = ["ab"[i % 2] for i in range(n)], ["xy"[i // 2 % 2] for i in range(n)]
    base = np.array([20.0, 60.0, 5.0, 200.0, 30.0])
    mu = base * np.array([[1.0 if b == "a" else 2.0] for b in batch]) * np.array([[1.0 if g == "x" else 1.5] for g in group])
    r = np.array([[sizes[b]] for b in batch])
    x = rng.negative_binomial(r, r / (r + mu)).astype(float)
    x[[i for i in range(n) if batch[i] == "b"], 4] = 0  # absent from a batch: stays as it is
    cells, features = matrix(spark, x)
    obs = spark.createDataFrame([(i, batch[i], group[i]) for i in range(n)], "sample_id long, batch string, grp string")
    model = nb.fit(cells, obs, "batch", "grp")
    assert model.reference == "a" and 4 < model.sizes["a"] < 16 and 1.2 < model.sizes["b"] < 3.5
    means = {(m["feature_id"], m["batch"], m["grp"]): m["mu"] for m in model.means.collect()}
    for j in range(4):  # fitted sums are the data's, by batch and by group
        for names, key in ((batch, 1), (group, 2)):
            for name in set(names):
                fitted = sum(means[f"f{j:02d}", batch[i], group[i]] for i in range(n) if names[i] == name)
                assert fitted == pytest.approx(sum(x[i, j] for i in range(n) if names[i] == name), rel=1e-6)
    for b in "ab":  # no size near the fitted one is likelier
        like = lambda s, b=b: sum(math.lgamma(x[i, j] + s) - math.lgamma(s) + s * math.log(s / (s + m)) + x[i, j] * math.log(m / (s + m)) for i in range(n) if batch[i] == b for j in range(4) for m in [means[f"f{j:02d}", b, group[i]]])
        assert like(model.sizes[b]) >= max(like(model.sizes[b] * 1.02), like(model.sizes[b] / 1.02))
    dense = spark.createDataFrame([(i, f"f{j:02d}", float(x[i, j])) for i in range(n) for j in range(5)], "sample_id long, feature_id string, value double")
    out = {(q["sample_id"], q["feature_id"]): q["value"] for q in model.adjust(dense).collect()}
    factor = {(m["feature_id"], m["batch"]): m["ln_a"] for m in model.means.collect()}
    for i in range(n):
        for j in range(5):
            f, b, old = f"f{j:02d}", batch[i], x[i, j]
            if b == "a" or j == 4:
                assert out[i, f] == old
                continue
            m, gamma = means[f, b, group[i]], factor[f, "b"] - factor[f, "a"]
            new = m * math.exp(-gamma)
            if gamma < nb.CAP:
                new = min(new, max(means[f, "a", g] for g in "xy"))
            p = cdf(old, m, model.sizes["b"])
            assert out[i, f] == (old if p > 1 - 1e-6 else next(k for k in range(10**6) if cdf(k, new, model.sizes["a"]) >= p * (1 - 1e-9)))


def test_designs_that_cannot_be_fitted(spark):
    cells, _ = matrix(spark, np.ones((4, 2)))
    obs = lambda rows: spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "sample_id long, batch string, grp string")
    with pytest.raises(ValueError, match="one sample"):
        nb.fit(cells, obs([("a", "x"), ("a", "x"), ("b", "x"), ("a", "x")]), "batch")
    with pytest.raises(ValueError, match="confounded"):
        nb.fit(cells, obs([("a", "x"), ("a", "x"), ("b", "y"), ("b", "y")]), "batch", "grp")
    with pytest.raises(ValueError, match="no batch"):
        nb.fit(cells, obs([("a", "x"), ("a", "x"), ("b", "x"), ("b", "x")]), "batch", reference="c")


def test_specs_that_are_refused():
    for spec in ({}, {"model": "magic"}, {"model": "centroid", "colour": "red"}, {"model": "centroid", "impute": "guess"}):
        with pytest.raises(ValueError):
            fo.from_spec(spec)


def test_logarithms_of_trimmed_means_tie_as_in_sql(spark):
    """Spark's log2 is a quotient whose last digit differs for some shares; ranks of TMM then tie otherwise than in the SQL."""
    import math

    from assaymill.operators import normalise as nm

    shares = [a / b for a in range(1, 60) for b in range(1, 60)]
    rows = spark.createDataFrame([(x,) for x in shares], "x double").select("x", nm._log2(F.col("x")).alias("y"), F.log2("x").alias("z")).collect()
    assert all(r["y"] == math.log2(r["x"]) for r in rows) and any(r["z"] != r["y"] for r in rows)


def test_draws_of_a_round_are_the_first_by_hash(spark):
    """Samples of one hash part are ordered; none or all of them may be drawn."""
    import hashlib

    samples = spark.range(9000).withColumnRenamed("id", "sample_id")
    for n in (0, 1, 4321, 9000):
        got = {(r["sample_id"], i) for r in pm.permuted(samples, n, 3).collect() for i in r["rounds"]}
        want = {(s, i) for i in (1, 2, 3) for s in sorted(range(9000), key=lambda s: (hashlib.md5(f"0|{i}|{s}".encode()).hexdigest(), s))[:n]}
        assert got == want


def test_draws_write_no_order_of_all_rounds(spark):
    plan = pm.permuted(spark.range(50).withColumnRenamed("id", "sample_id"), 20, 4)._jdf.queryExecution().toString()
    assert "parquet" not in plan.lower()


def test_plans_keep_a_feature_out_of_one_task(spark):
    """No window over all samples of a feature, no frame that is computed anew for each row."""
    from assaymill.operators import contrasts as co
    from assaymill.operators import evaluation as ev
    from assaymill.operators import hierarchy as hi

    dense = spark.createDataFrame([(s, f, float(s * (f == "a") + 1)) for s in range(6) for f in "ab"], "sample_id long, feature_id string, value double")
    sets = spark.createDataFrame([("s", "a"), ("s", "b")], "set_name string, feature_id string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan(hi.mean_z_score(dense, sets)) and "Window" not in plan(co.plage(dense, sets))
    rows = spark.createDataFrame([(i, i / 10) for i in range(5)], "k long, p double")
    assert "min(_bh" in plan(st.adjust(rows, "p", "k")) and "specifiedwindowframe(RowFrame, currentrow$(), unboundedfollowing$())" not in plan(st.adjust(rows, "p", "k"))
    scores = spark.createDataFrame([(1, "x", 0.25), (1, "y", 0.5), (2, "x", 1.0)], "sample_id long, class string, score double")
    pred = spark.createDataFrame([(1, "x", "y"), (2, "x", "x"), (3, "x", "y")], "sample_id long, truth string, prediction string")
    assert [tuple(r) for r in ev.misses(pred, scores, ["x", "y"]).collect()] == [(1, "x", "y", 0.25, 0.5)]
