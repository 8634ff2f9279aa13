"""Comparisons of groups and splits, batch models with a design, and set scores that need linear algebra."""

from __future__ import annotations

from collections.abc import Sequence
from math import tanh

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assaymill.storage import lookup, materialize

V = F.col


def joined_results(a: DataFrame, b: DataFrame, key: str, suffixes: tuple[str, str]) -> DataFrame:
    """Two result tables side by side by gene, their other columns suffixed."""
    mark = lambda df, s: df.select(key, *[V(c).alias(f"{c}_{s}") for c in df.columns if c != key])
    return mark(a, suffixes[0]).join(mark(b, suffixes[1]), key)


def group_means(logs: DataFrame, obs: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """(feature_id, mean_a, mean_b, lfc) of log values in two groups."""
    d = logs.join(obs.select("sample_id", V(group).alias("_g")), "sample_id").groupBy("feature_id")
    out = d.agg(F.avg(F.when(V("_g") == a, V("value"))).alias("mean_a"), F.avg(F.when(V("_g") == b, V("value"))).alias("mean_b"))
    return out.withColumn("lfc", V("mean_a") - V("mean_b"))


def ovr_contrast(logs: DataFrame, obs: DataFrame, label: str) -> DataFrame:
    """(feature_id, label, lfc): mean log of a class less the mean over the other classes' means."""
    m = logs.join(obs.select("sample_id", V(label).alias("label")), "sample_id").groupBy("feature_id", "label").agg(F.avg("value").alias("_m"))
    w = Window.partitionBy("feature_id")
    return m.select("feature_id", "label", (V("_m") - F.try_divide(F.sum("_m").over(w) - V("_m"), F.count("*").over(w) - 1)).alias("lfc"))


def split_shift(dense: DataFrame, obs: DataFrame, label: str, role: str) -> DataFrame:
    """(feature_id, shift): test less train within each label, averaged over labels that have both."""
    m = dense.join(obs.select("sample_id", V(label).alias("_l"), V(role).alias("_r")), "sample_id").groupBy("feature_id", "_l")
    d = m.agg(F.avg(F.when(V("_r") == "test", V("value"))).alias("_t"), F.avg(F.when(V("_r") == "train", V("value"))).alias("_n"))
    return d.where("_t is not null and _n is not null").groupBy("feature_id").agg(F.avg(V("_t") - V("_n")).alias("shift"))


def split_compare(dense: DataFrame, obs: DataFrame, label: str, role: str) -> DataFrame:
    """(feature_id, label, vs_train, vs_all, gap): mean of test less train and less everything; labels with one side only are left out."""
    m = dense.join(obs.select("sample_id", V(label).alias("label"), V(role).alias("_r")), "sample_id").groupBy("feature_id", "label")
    d = m.agg(F.avg(F.when(V("_r") == "test", V("value"))).alias("_t"), F.avg(F.when(V("_r") == "train", V("value"))).alias("_n"), F.avg("value").alias("_a"))
    d = d.where("_t is not null and _n is not null").select("feature_id", "label", (V("_t") - V("_n")).alias("vs_train"), (V("_t") - V("_a")).alias("vs_all"))
    return d.withColumn("gap", F.abs("vs_train") - F.abs("vs_all"))


def set_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Significant sets of two analyses and where each was found."""
    both = a.select(key).distinct().withColumn("_a", F.lit(True)).join(b.select(key).distinct().withColumn("_b", F.lit(True)), key, "full")
    return both.select(key, F.when(V("_a") & V("_b"), "both").when(V("_a"), "first").otherwise("second").alias("found"))


def symmetric(pairs: DataFrame) -> DataFrame:
    """(x, y, n) in both directions."""
    return pairs.select("x", "y", "n").union(pairs.where("x <> y").select("y", "x", "n"))


def reject_ranges(ranges: DataFrame, totals: DataFrame, least: float) -> DataFrame:
    """Ranges (label, n) that hold at least a share of their top label's samples."""
    return ranges.join(totals.select("label", V("n").alias("_t")), "label").where(V("n") >= least * V("_t")).drop("_t")


def informative(ranges: DataFrame) -> DataFrame:
    """Per label the features that have a range of it, and per feature how many ranges it has."""
    return ranges.groupBy("label").agg(F.array_join(F.array_sort(F.collect_set("feature_id")), ",").alias("features"), F.count("*").alias("n_ranges"))


def informative_gini(intervals: DataFrame) -> DataFrame:
    """(feature_id, n_intervals, mean_gini) of a feature's pure intervals."""
    return intervals.groupBy("feature_id").agg(F.count("*").alias("n_intervals"), F.avg("gini").alias("mean_gini"))


def rho_cutoff(n: int, pairs: int, alpha: float = 0.05) -> float:
    """Least association that stands out of ``pairs`` tests, by Fisher's z and Bonferroni."""
    from statistics import NormalDist

    return tanh(NormalDist().inv_cdf(1 - alpha / (2 * max(pairs, 1))) / max(n - 3, 1) ** 0.5)


def remove_design(dense: DataFrame, design: DataFrame, batch: Sequence[str]) -> DataFrame:
    """Values less the fitted part of the batch columns, by least squares on a design.

    ``design`` is (sample_id, term, x) with the intercept among its terms. Only the terms' cross
    products, a square of the number of terms, are solved on the driver; the terms' products with the data
    and the subtraction are joins and sums.
    """
    spark = dense.sparkSession
    a = design.toDF("sample_id", "t", "x")
    cross = {(r["t"], r["u"]): r["s"] for r in a.join(a.toDF("sample_id", "u", "y"), "sample_id").groupBy("t", "u").agg(F.sum(V("x") * V("y")).alias("s")).collect()}
    terms = sorted({t for t, _ in cross})
    inverse = np.linalg.pinv(np.array([[cross.get((t, u), 0.0) for u in terms] for t in terms]))
    table = spark.createDataFrame([(t, u, float(inverse[i, j])) for i, t in enumerate(terms) for j, u in enumerate(terms) if t in batch], "t string, u string, w double")
    xy = dense.join(design.toDF("sample_id", "u", "x"), "sample_id").groupBy("feature_id", "u").agg(F.sum(V("x") * V("value")).alias("_s"))
    beta = xy.join(F.broadcast(table), "u").groupBy("feature_id", "t").agg(F.sum(V("_s") * V("w")).alias("_b"))
    # A row per feature and batch column: joined by the column alone, all samples would meet in one task.
    part = design.where(V("term").isin(*batch)).toDF("sample_id", "t", "x").join(F.broadcast(beta), "t").groupBy("sample_id", "feature_id").agg(F.sum(V("x") * V("_b")).alias("_p"))
    return dense.join(part, ["sample_id", "feature_id"], "left").select("sample_id", "feature_id", (V("value") - F.coalesce("_p", F.lit(0.0))).alias("value"))


def plage(dense: DataFrame, sets: DataFrame) -> DataFrame:
    """(sample_id, set_name, score): first right singular vector of each set's standardised members, its sign that of their mean.

    A set's member-by-member products are sums over samples; only that square, of its members, is one task's. The scores
    are the samples' products with its leading eigenvector, again sums. Sets without spread have no score.
    """
    spread = dense.groupBy("feature_id").agg(F.avg("value").alias("_mean"), F.stddev_samp("value").alias("_sd"), F.count("*").alias("_rows"))
    z = lookup(dense, spread, ["feature_id"], "_rows").select("sample_id", "feature_id", F.coalesce(F.try_divide(V("value") - V("_mean"), V("_sd")), F.lit(0.0)).alias("_z"))
    a = z.join(sets, "feature_id")
    pairs = a.join(a.select("sample_id", "set_name", V("feature_id").alias("other"), V("_z").alias("_y")), ["sample_id", "set_name"])
    square = pairs.groupBy("set_name", "feature_id", "other").agg(F.sum(V("_z") * V("_y")).alias("product"))
    kind = dict(dense.dtypes)["feature_id"]

    def leading(pdf: pd.DataFrame) -> pd.DataFrame:
        g = pdf.pivot_table(index="feature_id", columns="other", values="product").fillna(0.0)
        value, vector = np.linalg.eigh(g.to_numpy())
        u = vector[:, -1] if vector[:, -1].sum() >= 0 else -vector[:, -1]
        rows = pd.DataFrame({"set_name": pdf["set_name"].iloc[0], "feature_id": g.index, "u": u / np.sqrt(max(value[-1], 1e-300))})
        return rows if value[-1] > 1e-12 else rows.iloc[:0]

    loads = square.groupBy("set_name").applyInPandas(leading, f"set_name string, feature_id {kind}, u double")
    return z.join(loads, "feature_id").groupBy("sample_id", "set_name").agg(F.sum(V("_z") * V("u")).alias("score"))


def greedy_parents(children: DataFrame, below: DataFrame, n: int) -> list[str]:
    """Up to ``n`` terms by most children and least depth (term, n_children, level), none inside another; ``below`` is (ancestor, descendant).

    Candidates are read in order in small batches; what is chosen is all that the driver keeps.
    """
    chosen: list[str] = []
    gone = children.select("term").limit(0)
    while len(chosen) < n:
        best = children.join(gone, "term", "left_anti").orderBy(F.desc("n_children"), "level", "term").limit(1).collect()
        if not best:
            break
        term = best[0]["term"]
        chosen.append(term)
        related = below.where(V("ancestor") == term).select(V("descendant").alias("term")).union(below.where(V("descendant") == term).select("ancestor"))
        gone = gone.union(related).union(children.where(V("term") == term).select("term")).distinct()
    return chosen


def clusters(dense: DataFrame, features: Sequence[str], k: int, seed: int = 0) -> DataFrame:
    """(sample_id, cluster) by k-means of Spark ML."""
    from pyspark.ml.clustering import KMeans

    from assaymill.operators.models import vectors

    data = materialize(vectors(dense, features), "vectors")  # read in every pass
    return KMeans(k=k, seed=seed).fit(data).transform(data).select("sample_id", V("prediction").alias("cluster"))


def l1_coefficients(dense: DataFrame, labels: DataFrame, features: Sequence[str], strength: float) -> DataFrame:
    """(class, feature_id, coef) of an L1 multinomial logistic model."""
    from assaymill.operators.models import classifier, label_encode, training

    codes = label_encode(labels, "label")
    data = training(dense, features, labels, codes)
    model = classifier("logistic", regParam=strength, elasticNetParam=1.0, family="multinomial", maxIter=50).fit(data)
    names = {r["code"]: r["value"] for r in codes.collect()}
    matrix = model.coefficientMatrix.toArray()
    return dense.sparkSession.createDataFrame([(names[i], f, float(matrix[i, j])) for i in range(len(matrix)) for j, f in enumerate(features)], "class string, feature_id string, coef double")


def forest_importances(dense: DataFrame, labels: DataFrame, features: Sequence[str], seed: int = 0) -> DataFrame:
    """(feature_id, importance) of a random forest."""
    from assaymill.operators.models import label_encode, training

    found = _importances(training(dense, features, labels, label_encode(labels, "label")), seed)
    return dense.sparkSession.createDataFrame([(f, x) for f, x in zip(features, found, strict=True)], "feature_id string, importance double")


def _importances(data: DataFrame, seed: int = 0) -> list[float]:
    """Of a random forest, feature by feature of the vectors."""
    from assaymill.operators.models import classifier

    return [float(x) for x in classifier("forest", seed=seed, numTrees=20, maxDepth=4).fit(data).featureImportances.toArray()]


def eliminate(dense: DataFrame, labels: DataFrame, features: Sequence[str], keep: int, share: float = 0.5) -> list[str]:
    """Recursive elimination: the least important part of the features goes until ``keep`` are left. Vectors are written once, and each round takes its part of them."""
    from pyspark.ml.feature import VectorSlicer

    from assaymill.operators.models import label_encode, training

    left = list(features)
    if len(left) <= keep:
        return left
    data, place = training(dense, left, labels, label_encode(labels, "label")), {f: i for i, f in enumerate(left)}
    while len(left) > keep:
        some = VectorSlicer(inputCol="_every", outputCol="features", indices=[place[f] for f in left]).transform(data.withColumnRenamed("features", "_every"))
        ranked = sorted(zip(_importances(some.select("features", "label")), left, strict=True), key=lambda x: (-x[0], x[1]))
        left = [f for _, f in ranked][: max(keep, int(len(left) * share))]
    return left


def type_ratios(cells: DataFrame, obs: DataFrame, label: str, group: str, value: str) -> DataFrame:
    """(label, feature_id, inside, outside, ratio, difference): mean of a group's samples beside the other samples of their label; absent cells are 0."""
    tagged = obs.select("sample_id", V(label).alias("label"), F.coalesce(V(group) == value, F.lit(False)).alias("_in"))
    sizes = tagged.groupBy("label").agg(F.count_if("_in").alias("_ni"), F.count_if(~V("_in")).alias("_no"))
    sums = cells.join(tagged, "sample_id").groupBy("label", "feature_id").agg(F.sum(F.when(V("_in"), V("value")).otherwise(0.0)).alias("_si"), F.sum(F.when(V("_in"), 0.0).otherwise(V("value"))).alias("_so"))
    out = sums.join(sizes, "label").select("label", "feature_id", F.try_divide("_si", "_ni").alias("inside"), F.try_divide("_so", "_no").alias("outside"))
    return out.withColumns({"ratio": F.try_divide("inside", "outside"), "difference": V("inside") - V("outside")})
