"""Cross-validation in one plan: the fold is a key of every learned state, so each fold's scaler, selection, balance and model see its training samples alone.

A plan of folds is ``train`` (fold, sample_id) and ``test`` (fold, sample_id). A sample's values and its part in
each fold are one row, written once; (fold, sample_id, feature_id, value), absent cells as 0, are made inside the rows. States are aggregates by fold and feature
or class, written and joined back. No loop over folds runs on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assaymill.functions.ordering import ordered
from assaymill.operators import normalise as nm
from assaymill.operators.evaluation import confusion, metrics
from assaymill.storage import materialize

V = F.col


@dataclass
class Folded:
    """One row per sample in ``rows``: ``_folds``, what it is in each fold, and ``_cells``, its dense values; and ``after``, which steps add to ``values``.

    A fold's entry is (fold, _train, _known, label): ``_known`` marks training samples with a label. Folds multiply the values inside
    a row, after all shuffles.
    """

    rows: DataFrame
    after: tuple[Callable[[DataFrame], DataFrame], ...] = ()

    @property
    def values(self) -> DataFrame:
        """(fold, sample_id, feature_id, value, _train, _known, label) of all folds."""
        each = self.rows.select("sample_id", "_cells", F.explode("_folds").alias("_f")).select("sample_id", "_f.*", F.explode("_cells").alias("_c"))
        out = each.select("fold", "sample_id", V("_c")["feature_id"].alias("feature_id"), V("_c")["value"].alias("value"), "_train", "_known", "label")
        for step in self.after:
            out = step(out)
        return out

    @property
    def labels(self) -> DataFrame:
        """(fold, sample_id, label) of training samples."""
        return self.rows.select("sample_id", F.explode("_folds").alias("_f")).select("_f.fold", "sample_id", "_f.label", "_f._known").where("_known").drop("_known")


Step = Callable[[Folded], Folded]


def folded(dense: DataFrame, labels: DataFrame, folds: DataFrame, k: int) -> Folded:
    """Each sample tests its own fold (sample_id, fold of 0 to k - 1) and trains the others. ``dense`` has every feature of every sample."""
    told = labels.select("sample_id", "label", F.lit(True).alias("_has"))
    own = folds.select("sample_id", V("fold").cast("int").alias("_own")).join(told, "sample_id", "left")
    train, known = (lambda f: f != V("_own")), F.coalesce("_has", F.lit(False))
    entry = lambda f: F.struct(f.alias("fold"), train(f).alias("_train"), (train(f) & known).alias("_known"), F.when(train(f), V("label")).alias("label"))
    own = own.select("sample_id", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), entry).alias("_folds"))
    held = dense.groupBy("sample_id").agg(F.collect_list(F.struct("feature_id", "value")).alias("_cells"))
    return Folded(materialize(held.join(own, "sample_id"), "folded"))


def scaled(data: Folded) -> Folded:
    """Standard scores by the training samples' mean and spread; a feature without spread becomes 0."""
    state = data.values.where("_train").groupBy("fold", "feature_id").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_sd"))
    z = F.coalesce(F.try_divide(V("value") - V("_m"), V("_sd")), F.lit(0.0))
    state = materialize(state, "scaler")  # one row per fold and feature
    return Folded(data.rows, (*data.after, lambda values: values.join(state, ["fold", "feature_id"]).withColumn("value", z).drop("_m", "_sd")))


def f_statistics(data: Folded) -> DataFrame:
    """(fold, feature_id, f): variance between the classes of a fold's training samples over that within them; infinite where classes differ and nothing varies within."""
    train = data.values.where("_known")
    g = train.groupBy("fold", "feature_id", "label").agg(F.count("*").alias("_n"), F.avg("value").alias("_m"), F.var_pop("value").alias("_v"))
    w = Window.partitionBy("fold", "feature_id")
    g = g.withColumn("_grand", F.sum(V("_n") * V("_m")).over(w) / F.sum("_n").over(w))
    s = g.groupBy("fold", "feature_id").agg(F.sum(V("_n") * F.pow(V("_m") - V("_grand"), 2)).alias("_b"), F.sum(V("_n") * V("_v")).alias("_w"), F.count("*").alias("_k"), F.sum("_n").alias("_t"))
    f = F.try_divide(V("_b") * (V("_t") - V("_k")), V("_w") * (V("_k") - 1))
    return s.select("fold", "feature_id", F.round(F.coalesce(f, F.when(V("_b") > 1e-12, float("inf")).otherwise(0.0)), 9).alias("f"))


def best_features(data: Folded) -> DataFrame:
    """(fold, feature_id, place): features of each fold by falling F."""
    return ordered(f_statistics(data), [F.desc("f"), "feature_id"], ["fold"]).select("fold", "feature_id", V("_nth").alias("place"))


def selected(n: int) -> Step:
    """The n features of largest F in the training samples."""

    def run(data: Folded) -> Folded:
        best = materialize(best_features(data).where(V("place") <= n).select("fold", "feature_id"), "selected")
        return Folded(data.rows, (*data.after, lambda values: values.join(best, ["fold", "feature_id"])))

    return run


def undersampled(seed: int = 0) -> Step:
    """As many training samples of each class as a fold's smallest has, first by md5 of seed, fold and sample; test samples all stay."""

    def run(data: Folded) -> Folded:
        order = F.md5(F.concat_ws("|", F.lit(str(seed)), V("fold").cast("string"), V("sample_id").cast("string")))
        sizes = data.labels.groupBy("fold", "label").count().groupBy("fold").agg(F.min("count").alias("_least"))
        drawn = ordered(data.labels.withColumn("_h", order), ["_h", "sample_id"], ["fold", "label"])
        kept = drawn.join(sizes, "fold").where(V("_nth") <= V("_least")).groupBy("sample_id").agg(F.collect_list("fold").alias("_kept"))
        rows = data.rows.join(kept, "sample_id", "left")
        stays = F.filter("_folds", lambda f: ~f["_train"] | F.coalesce(F.array_contains("_kept", f["fold"]), F.lit(False)))
        return Folded(materialize(rows.withColumn("_folds", stays).drop("_kept"), "undersampled"), data.after)

    return run


def centroid(data: Folded, by: Sequence[str] = ("fold",)) -> DataFrame:
    """(fold, sample_id, prediction): the class whose training mean is closest."""
    mid = data.values.where("_known").groupBy(*by, V("label").alias("prediction"), "feature_id").agg(F.avg("value").alias("_c"))
    d = data.values.where("NOT _train").drop("label").join(materialize(mid, "centres"), [*by, "feature_id"]).groupBy(*by, "sample_id", "prediction").agg(F.round(F.sum(F.pow(V("value") - V("_c"), 2)), 6).alias("_d"))
    return _least(d, by)


def gaussian(data: Folded, by: Sequence[str] = ("fold",), smooth: float = 1e-3) -> DataFrame:
    """(fold, sample_id, prediction): the class of largest posterior under independent normals; ``smooth`` is added to every variance."""
    keys = [*by, "prediction"]
    train = data.values.where("_known").withColumnRenamed("label", "prediction")
    state = train.groupBy(*keys, "feature_id").agg(F.avg("value").alias("_c"), (F.var_pop("value") + smooth).alias("_v"), F.count("*").alias("_n"))
    cost = F.pow(V("value") - V("_c"), 2) / V("_v") + F.ln("_v")
    d = data.values.where("NOT _train").drop("label").join(materialize(state, "normals"), [*by, "feature_id"]).groupBy(*by, "sample_id", "prediction").agg((F.sum(cost) - 2 * F.ln(F.max("_n"))).alias("_d"))
    return _least(d.withColumn("_d", F.round("_d", 6)), by)


def _least(d: DataFrame, by: Sequence[str]) -> DataFrame:
    best = d.groupBy(*by, "sample_id").agg(F.min(F.struct("_d", "prediction")).alias("_b"))
    return best.select(*by, "sample_id", V("_b")["prediction"].alias("prediction"))


MODELS = {"centroid": centroid, "gaussian": gaussian}


def cross_validate(dense: DataFrame, labels: DataFrame, folds: DataFrame, k: int, steps: Sequence[Step] = (), model: str = "centroid") -> DataFrame:
    """(fold, sample_id, truth, prediction) of a pipeline: ``steps`` learned in every fold, then a model of MODELS."""
    data = folded(dense, labels, folds, k)
    for step in steps:
        data = step(data)
    return MODELS[model](data).join(labels.select("sample_id", V("label").alias("truth")), "sample_id").select("fold", "sample_id", "truth", "prediction")


def feature_curve(dense: DataFrame, labels: DataFrame, folds: DataFrame, k: int, sizes: Sequence[int], steps: Sequence[Step] = (), model: str = "centroid") -> DataFrame:
    """(n_features, fold, accuracy): the model on each fold's n best features, for all sizes in one plan. Features are ranked by the training samples of their fold."""
    data = folded(dense, labels, folds, k)
    for step in steps:
        data = step(data)
    size = F.explode(F.filter(F.array(*map(F.lit, sorted(set(sizes)))), lambda n: n >= V("place")))
    places = materialize(best_features(data).withColumn("n_features", size).select("fold", "feature_id", "n_features"), "places")
    found = MODELS[model](Folded(data.rows, (*data.after, lambda values: values.join(places, ["fold", "feature_id"]))), ("n_features", "fold"))
    scored = found.join(labels.select("sample_id", V("label").alias("truth")), "sample_id")
    return scored.groupBy("n_features", "fold").agg(F.avg((V("truth") == V("prediction")).cast("double")).alias("accuracy"))


def best_size(curve: DataFrame) -> DataFrame:
    """(n_features, accuracy): the size of best mean accuracy over the folds, the smallest of equals."""
    return curve.groupBy("n_features").agg(F.round(F.avg("accuracy"), 9).alias("accuracy")).orderBy(F.desc("accuracy"), "n_features").limit(1)


def fold_metrics(pred: DataFrame) -> DataFrame:
    """``evaluation.metrics`` of every fold."""
    return metrics(confusion(pred, ["fold"]), ["fold"])


#: Steps on one sample at a time, which no fold has to learn.
IMPUTATIONS: dict[str, Callable[[DataFrame], DataFrame]] = {"plus_one": nm.impute_plus_one, "replace_one": nm.impute_replace_one, "multi_replace": nm.impute_multi_replace, "none": lambda d: d}
TRANSFORMS: dict[str, Callable[[DataFrame], DataFrame]] = {"log1p": lambda d: d.withColumn("value", F.log1p("value")), "log2": lambda d: d.withColumn("value", F.log2("value")), "size_log1p": nm.normalize_total_log1p, "robust_clr": nm.robust_clr, "ranks": nm.into_ranks, "none": lambda d: d}
BALANCES: dict[str, Callable[[], Step]] = {"undersample": undersampled}


def from_spec(spec: Mapping[str, object]) -> Callable[[DataFrame, DataFrame, DataFrame, int], DataFrame]:
    """A pipeline by names: a function of (dense, labels, folds, k) to ``cross_validate``'s predictions.

    In order: ``blacklist`` (features that go), ``impute`` (IMPUTATIONS), ``transform`` (TRANSFORMS), ``balance`` (BALANCES), ``scale`` (true or false),
    ``features`` (how many, by F) and ``model`` (MODELS; required). Unknown keys and names are errors.
    """
    known = {"blacklist", "impute", "transform", "balance", "scale", "features", "model"}
    if extra := set(spec) - known:
        raise ValueError(f"unknown steps: {', '.join(sorted(extra))}")
    for key, names in (("impute", IMPUTATIONS), ("transform", TRANSFORMS), ("balance", BALANCES), ("model", MODELS)):
        if (key in spec or key == "model") and spec.get(key) not in names:
            raise ValueError(f"{key}: {spec.get(key)!r} is none of {', '.join(names)}")
    steps: list[Step] = []
    if "balance" in spec:
        steps.append(BALANCES[str(spec["balance"])]())
    if spec.get("scale"):
        steps.append(scaled)
    if spec.get("features"):
        steps.append(selected(int(str(spec["features"]))))

    def run(dense: DataFrame, labels: DataFrame, folds: DataFrame, k: int) -> DataFrame:
        left = dense.where(~V("feature_id").isin(list(spec.get("blacklist", ()))))  # type: ignore[call-overload]
        left = TRANSFORMS[str(spec.get("transform", "none"))](IMPUTATIONS[str(spec.get("impute", "none"))](left))
        return cross_validate(left, labels, folds, k, steps, str(spec["model"]))

    return run
