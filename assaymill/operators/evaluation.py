"""Scores of classifiers and their comparison. Predictions are (sample_id, truth, prediction); scores are (sample_id, class, score)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assaymill.operators.nearest import class_distances, pair_distances

V = F.col


def confusion(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(truth, prediction, n) over the grid of all classes, absent cells as 0."""
    classes = pred.select(V("truth").alias("c")).union(pred.select("prediction")).distinct()
    grid = classes.select(V("c").alias("truth")).crossJoin(F.broadcast(classes.select(V("c").alias("prediction"))))
    if by:
        grid = pred.select(*by).distinct().crossJoin(F.broadcast(grid))
    keys = [*by, "truth", "prediction"]
    return grid.join(pred.groupBy(*keys).agg(F.count("*").alias("n")), keys, "left").fillna(0, ["n"])


def class_report(cm: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(class, support, predicted, hits, precision, recall, f1) from a confusion table."""
    w = lambda c: Window.partitionBy(*by, c)
    d = cm.withColumns({"_s": F.sum("n").over(w("truth")), "_p": F.sum("n").over(w("prediction"))})
    support = d.where("truth = prediction").select(*by, V("truth").alias("class"), V("_s").alias("support"), V("_p").alias("predicted"), V("n").alias("hits"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = support.withColumns({"precision": zero(F.try_divide("hits", "predicted")), "recall": zero(F.try_divide("hits", "support"))})
    return out.withColumn("f1", zero(F.try_divide(2 * V("precision") * V("recall"), V("precision") + V("recall"))))


def metrics(cm: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """accuracy, balanced_accuracy, kappa, jaccard, mcc, fowlkes_mallows, macro_f1, weighted_f1: closed forms of the margins."""
    r = class_report(cm, by)
    square = cm.groupBy(*by).agg(F.sum(V("n") * V("n")).alias("_nn"))
    g = r.groupBy(*by).agg(
        F.sum("hits").alias("_h"), F.sum("support").alias("_t"), F.sum(V("support") * V("predicted")).alias("_e"), F.sum(V("support") * V("support")).alias("_ss"), F.sum(V("predicted") * V("predicted")).alias("_pp"),
        F.avg(F.when(V("support") > 0, V("recall"))).alias("balanced_accuracy"), F.avg(F.coalesce(F.try_divide(V("hits"), V("support") + V("predicted") - V("hits")), F.lit(0.0))).alias("jaccard"), F.avg("f1").alias("macro_f1"), F.sum(V("f1") * V("support")).alias("_wf"),
    )
    g = g.join(square, list(by)) if by else g.crossJoin(square)
    t = V("_t").cast("double")
    acc, chance = V("_h") / t, V("_e") / (t * t)
    return g.select(
        *by, acc.alias("accuracy"), "balanced_accuracy", F.try_divide(acc - chance, 1 - chance).alias("kappa"), "jaccard",
        F.coalesce(F.try_divide(V("_h") * t - V("_e"), F.sqrt((t * t - V("_pp")) * (t * t - V("_ss")))), F.lit(0.0)).alias("mcc"),
        F.coalesce(F.try_divide(V("_nn") - t, F.sqrt((V("_pp") - t) * (V("_ss") - t))), F.lit(0.0)).alias("fowlkes_mallows"), "macro_f1", (V("_wf") / t).alias("weighted_f1"),
    )


def misses(pred: DataFrame, scores: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Wrong predictions beside the scores of all classes."""
    wrong = pred.where("truth <> prediction")
    asked = scores.join(wrong.select("sample_id"), "sample_id", "left_semi")
    return wrong.join(asked.groupBy("sample_id").agg(*[F.max(F.when(V("class") == c, V("score"))).alias(c) for c in classes]), "sample_id")


def curve_points(pred: DataFrame, scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(class, score, tp, fp, pos, neg): cumulative counts at each distinct threshold, from the highest score; ``by`` (columns of ``pred``) keeps folds or models apart."""
    one = scores.join(pred.select("sample_id", "truth", *by), "sample_id").withColumn("_y", (V("truth") == V("class")).cast("long"))
    g = one.groupBy(*by, "class", "score").agg(F.sum("_y").alias("_p"), F.count("*").alias("_c"))
    w = Window.partitionBy(*by, "class")
    o = w.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return g.select(*by, "class", "score", F.sum("_p").over(o).alias("tp"), F.sum(V("_c") - V("_p")).over(o).alias("fp"), F.sum("_p").over(w).alias("pos"), F.sum(V("_c") - V("_p")).over(w).alias("neg"))


def roc_curve(points: DataFrame) -> DataFrame:
    return points.select("class", "score", F.try_divide("fp", "neg").alias("fpr"), F.try_divide("tp", "pos").alias("tpr"))


def auroc(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(class, auroc) by the trapezoid rule from (0, 0)."""
    w = Window.partitionBy(*by, "class").orderBy(F.desc("score"))
    lag = lambda c: F.coalesce(F.lag(c).over(w), F.lit(0))
    area = points.withColumn("_a", (V("fp") - lag("fp")) * (V("tp") + lag("tp")) / 2)
    return area.groupBy(*by, "class").agg(F.try_divide(F.sum("_a"), F.first("pos") * F.first("neg")).alias("auroc"))


def auroc_spread(points: DataFrame, fold: str) -> DataFrame:
    """(class, mean, least, largest, n) of the areas under the curves of the folds; folds without both kinds of samples have none."""
    return auroc(points, [fold]).where("auroc IS NOT NULL").groupBy("class").agg(F.avg("auroc").alias("mean"), F.min("auroc").alias("least"), F.max("auroc").alias("largest"), F.count("*").alias("n"))


def auroc_macro(points: DataFrame) -> DataFrame:
    return auroc(points).agg(F.avg("auroc").alias("auroc"))


def auroc_ovo(pred: DataFrame, scores: DataFrame) -> DataFrame:
    """(auroc): mean over ordered pairs of classes of the area among the two classes' rows, by the first's score."""
    tagged = scores.join(pred.select("sample_id", "truth"), "sample_id")
    others = pred.select(V("truth").alias("other")).distinct()
    both = tagged.join(F.broadcast(others), (V("other") != V("class")) & ((V("truth") == V("class")) | (V("truth") == V("other"))))
    w = Window.partitionBy("class", "other")
    rank = F.rank().over(w.orderBy("score")) + (F.count("*").over(Window.partitionBy("class", "other", "score")) - 1) / 2
    r = both.withColumn("_r", rank).groupBy("class", "other").agg(F.sum(F.when(V("truth") == V("class"), V("_r")).otherwise(0)).alias("_s"), F.count_if(V("truth") == V("class")).alias("_p"), F.count("*").alias("_n"))
    return r.agg(F.avg((V("_s") - V("_p") * (V("_p") + 1) / 2) / (V("_p") * (V("_n") - V("_p")))).alias("auroc"))


def pr_curve(points: DataFrame) -> DataFrame:
    return points.select("class", "score", F.try_divide(V("tp"), V("tp") + V("fp")).alias("precision"), F.try_divide("tp", "pos").alias("recall"))


def average_precision(points: DataFrame) -> DataFrame:
    w = Window.partitionBy("class").orderBy(F.desc("score"))
    step = (V("tp") - F.coalesce(F.lag("tp").over(w), F.lit(0))) / V("pos") * V("tp") / (V("tp") + V("fp"))
    return points.where("pos > 0").withColumn("_s", step).groupBy("class").agg(F.sum("_s").alias("average_precision"))


def centroid_predict(train: DataFrame, test: DataFrame, labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(sample_id, truth, prediction): nearest class centroid of dense cells. ``labels`` is (sample_id, label); ``by`` keeps folds apart.

    Centroids are one row per class and feature.
    """
    mid = train.join(labels, "sample_id").groupBy(*by, V("label").alias("prediction"), "feature_id").agg(F.avg("value").alias("_c"))
    d = test.join(mid, [*by, "feature_id"]).groupBy(*by, "sample_id", "prediction").agg(F.round(F.sum((V("value") - V("_c")) * (V("value") - V("_c"))), 6).alias("_d"))
    w = Window.partitionBy(*by, "sample_id").orderBy("_d", "prediction")
    best = d.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return best.join(labels, "sample_id").select(*by, "sample_id", V("label").alias("truth"), "prediction")


def cross_validate(dense: DataFrame, labels: DataFrame, folds: DataFrame, k: int) -> DataFrame:
    """(fold, sample_id, truth, prediction) of the centroid model, all folds in one plan: a sample trains all folds but its own."""
    tagged = dense.join(folds.select("sample_id", V("fold").alias("_own")), "sample_id")
    train = tagged.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).where("fold <> _own")
    return centroid_predict(train, tagged.withColumnRenamed("_own", "fold"), labels, ["fold"])


def holdout(dense: DataFrame, labels: DataFrame, splits: DataFrame) -> DataFrame:
    """(split, sample_id, truth, prediction) over named splits (split, role, sample_id)."""
    tagged = dense.join(splits, "sample_id")
    return centroid_predict(tagged.where("role = 'train'"), tagged.where("role = 'test'"), labels, ["split"])


def split_props(splits: DataFrame, labels: DataFrame) -> DataFrame:
    n = splits.join(labels, "sample_id").groupBy("split", "role", "label").agg(F.count("*").alias("n"))
    return n.withColumn("share", V("n") / F.sum("n").over(Window.partitionBy("split", "role")))


def robustness_beta(models: DataFrame, x: str, y: str) -> DataFrame:
    """(slope, intercept) of shifted on standard accuracy."""
    return models.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def effective_robustness(models: DataFrame, key: str, x: str, y: str) -> DataFrame:
    beta = robustness_beta(models, x, y)
    return models.crossJoin(F.broadcast(beta)).select(key, (V(y) - (V("slope") * V(x) + V("intercept"))).alias("effective"), (V(y) - V(x)).alias("relative"))


def parameter_grid(spark, params: Mapping[str, Sequence], forbid: Column | None = None) -> DataFrame:
    """All combinations of small parameter lists but the forbidden, with unique names."""
    out = spark.range(1).select()
    for name, values in params.items():
        out = out.crossJoin(spark.createDataFrame([(v,) for v in values], [name]))
    out = out if forbid is None else out.where(~forbid)
    return out.withColumn("name", F.concat_ws("_", *[V(c).cast("string") for c in params]))


def regression_metrics(df: DataFrame, truth: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """mse, nrmse (by the range of the truth), pearson."""
    mse = F.avg(F.pow(V(truth) - V(prediction), 2))
    return df.groupBy(*by).agg(mse.alias("mse"), F.try_divide(F.sqrt(mse), F.max(truth) - F.min(truth)).alias("nrmse"), F.corr(truth, prediction).alias("pearson"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    n = df.groupBy(a, b).agg(F.count("*").alias("n"))
    pairs = lambda c: F.sum(c * (c - 1) / 2)
    cells = n.agg(pairs(V("n")).alias("_i"), F.sum("n").alias("_t"))
    ra, rb = (n.groupBy(x).agg(F.sum("n").alias("s")).agg(pairs(V("s")).alias(name)) for x, name in ((a, "_a"), (b, "_b")))
    g = cells.crossJoin(ra).crossJoin(rb)
    expected = V("_a") * V("_b") / (V("_t") * (V("_t") - 1) / 2)
    return g.select(F.try_divide(V("_i") - expected, (V("_a") + V("_b")) / 2 - expected).alias("adjusted_rand"))


def nmi(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mutual information by the mean of the entropies."""
    n = df.groupBy(a, b).agg(F.count("*").cast("double").alias("n"))
    s = lambda *by: F.sum("n").over(Window.partitionBy(*by))
    n = n.withColumns({"_a": s(a), "_b": s(b), "_t": s()})
    i = F.sum(V("n") / V("_t") * F.ln(V("n") * V("_t") / (V("_a") * V("_b"))))
    h = lambda c: -F.sum(V("n") / V("_t") * F.ln(V(c) / V("_t")))
    return n.agg(F.try_divide(2 * i, h("_a") + h("_b")).alias("nmi"))


def _spread(dense: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    tagged = dense.join(labels, "sample_id")
    return tagged, tagged.groupBy("label", "feature_id").agg(F.avg("value").alias("_c"))


def davies_bouldin(dense: DataFrame, labels: DataFrame) -> DataFrame:
    tagged, mid = _spread(dense, labels)
    d = tagged.join(mid, ["label", "feature_id"]).groupBy("label", "sample_id").agg(F.sqrt(F.sum((V("value") - V("_c")) * (V("value") - V("_c")))).alias("_d"))
    s = d.groupBy("label").agg(F.avg("_d").alias("_s"))
    a, b = mid.toDF("a", "feature_id", "_x"), mid.toDF("b", "feature_id", "_y")
    m = a.join(b, "feature_id").where("a <> b").groupBy("a", "b").agg(F.sqrt(F.sum((V("_x") - V("_y")) * (V("_x") - V("_y")))).alias("_m"))
    r = m.join(s.toDF("a", "_sa"), "a").join(s.toDF("b", "_sb"), "b").groupBy("a").agg(F.max((V("_sa") + V("_sb")) / V("_m")).alias("_r"))
    return r.agg(F.avg("_r").alias("davies_bouldin"))


def calinski_harabasz(dense: DataFrame, labels: DataFrame) -> DataFrame:
    tagged, mid = _spread(dense, labels)
    size = labels.groupBy("label").agg(F.count("*").alias("_n"))
    grand = dense.groupBy("feature_id").agg(F.avg("value").alias("_g"))
    between = mid.join(size, "label").join(grand, "feature_id").agg(F.sum(V("_n") * (V("_c") - V("_g")) * (V("_c") - V("_g"))).alias("_b"))
    within = tagged.join(mid, ["label", "feature_id"]).agg(F.sum((V("value") - V("_c")) * (V("value") - V("_c"))).alias("_w"))
    k = size.agg(F.count("*").alias("_k"), F.sum("_n").alias("_t"))
    return between.crossJoin(within).crossJoin(k).select(F.try_divide(V("_b") * (V("_t") - V("_k")), V("_w") * (V("_k") - 1)).alias("calinski_harabasz"))


def distances(dense: DataFrame) -> DataFrame:
    """(sample_id, other, distance) of all a study's samples to all others, both ways and copies too; absent cells are 0."""
    return pair_distances(dense, dense.select("sample_id").distinct())


def silhouette(dense: DataFrame, labels: DataFrame) -> DataFrame:
    d = class_distances(dense, labels.toDF("sample_id", "tag")).withColumn("_m", V("total") / V("n"))
    ab = d.groupBy("id", "tag", "size").agg(F.min(F.when(V("tag") == V("other_tag"), V("_m"))).alias("_a"), F.min(F.when(V("tag") != V("other_tag"), V("_m"))).alias("_b"))
    width = F.coalesce(F.try_divide(V("_b") - V("_a"), F.greatest("_a", "_b")), F.lit(0.0))
    return ab.agg((F.sum(width * V("size")) / F.sum("size")).alias("silhouette"))
