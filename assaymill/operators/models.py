"""Models on Spark ML and explanations of them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assaymill.operators.nearest import balls, class_distances, sized_classes, within
from assaymill.storage import materialize

V = F.col


def label_encode(df: DataFrame, column: str) -> DataFrame:
    """(value, code): codes from 0 by value; joining it encodes and decodes."""
    values = df.select(V(column).alias("value")).where("value is not null").distinct()
    return values.withColumn("code", F.dense_rank().over(Window.partitionBy().orderBy("value")) - 1)


def vectors(cells: DataFrame, features: Sequence[str]) -> DataFrame:
    """(sample_id, features): vectors in the order of a feature list, which the caller holds and which goes to every task."""
    from pyspark.ml.functions import array_to_vector

    spark = cells.sparkSession
    places = spark.createDataFrame([(f, i) for i, f in enumerate(features)], f"feature_id {dict(cells.dtypes)['feature_id']}, _i int")
    placed = cells.join(F.broadcast(places), "feature_id", "left")
    pair = F.struct("_i", F.coalesce(V("value").cast("double"), F.lit(0.0)).alias("_v"))
    rows = placed.groupBy("sample_id").agg(F.collect_list(F.when(V("_i").isNotNull(), pair)).alias("_m"))
    # A feature that a sample lacks is 0, and a sample without any of the features has only zeros.
    rest = F.array_except(F.sequence(F.lit(0), F.lit(len(features) - 1)) if features else F.array().cast("array<int>"), V("_m")["_i"])
    every = F.array_sort(F.concat("_m", F.transform(rest, lambda i: F.struct(i.alias("_i"), F.lit(0.0).alias("_v")))))
    return rows.select("sample_id", array_to_vector(every["_v"]).alias("features"))


def training(cells: DataFrame, features: Sequence[str], labels: DataFrame, codes: DataFrame) -> DataFrame:
    """(features, label): vectors of labelled samples, written once, since an estimator reads them in every pass."""
    data = vectors(cells, features).join(labels, "sample_id").join(F.broadcast(codes), V("label") == V("value"))
    return materialize(data.select("features", V("code").cast("double").alias("label")), "training")


def classifier(kind: str, seed: int = 0, **params):
    """An estimator of Spark ML by name."""
    from pyspark.ml import classification as c

    make = {
        "forest": lambda: c.RandomForestClassifier(seed=seed, **params), "logistic": lambda: c.LogisticRegression(**params), "tree": lambda: c.DecisionTreeClassifier(seed=seed, **params),
        "svc": lambda: c.OneVsRest(classifier=c.LinearSVC(**params)), "boosted": lambda: c.OneVsRest(classifier=c.GBTClassifier(seed=seed, **params)),
    }
    return make[kind]()


@dataclass
class Pipeline:
    """Ordered steps on cells, then a classifier. A step is (fit, apply): fit learns from train, apply uses it on any cells."""

    steps: Sequence[tuple[Callable[[DataFrame], object], Callable[[DataFrame, object], DataFrame]]]
    estimator: object
    features: Sequence[str]
    state: list = field(default_factory=list)

    def fit(self, cells: DataFrame, labels: DataFrame) -> Pipeline:
        self.state = []
        for learn, apply in self.steps:
            self.state.append(learn(cells))
            cells = apply(cells, self.state[-1])
        self.codes = materialize(label_encode(labels, "label"), "codes")
        self.model = self.estimator.fit(training(cells, self.features, labels, self.codes))
        return self

    def predict(self, cells: DataFrame) -> DataFrame:
        for (_, apply), state in zip(self.steps, self.state, strict=True):
            cells = apply(cells, state)
        out = self.model.transform(vectors(cells, self.features))
        return out.join(F.broadcast(self.codes), V("prediction") == V("code")).select("sample_id", V("value").alias("prediction"))


def from_spec(spec: Mapping, registry: Mapping[str, tuple], features: Sequence[str]) -> Pipeline:
    """A pipeline from {steps: [names], model: name, params: {...}}."""
    return Pipeline([registry[s] for s in spec.get("steps", ())], classifier(spec["model"], **spec.get("params", {})), features)


def soft_vote(scores: Sequence[tuple[DataFrame, float]]) -> DataFrame:
    """(sample_id, class, score): weighted mean of several models' scores; a model without a sample is left out for it."""
    out = scores[0][0].withColumn("_w", F.lit(float(scores[0][1])))
    for df, w in scores[1:]:
        out = out.unionByName(df.withColumn("_w", F.lit(float(w))))
    return out.groupBy("sample_id", "class").agg((F.sum(V("score") * V("_w")) / F.sum("_w")).alias("score"))


def intrinsic_dimension(near: DataFrame) -> DataFrame:
    """(dimension): maximum likelihood from ratios of neighbour distances."""
    w = Window.partitionBy("sample_id")
    r = near.where("distance > 0").withColumns({"_far": F.max("distance").over(w), "_k": F.count("*").over(w)})
    per = r.where("distance < _far").groupBy("sample_id").agg(F.sum(F.ln(V("_far") / V("distance"))).alias("_s"), F.count("*").alias("_c"))
    return per.agg((F.sum("_c") / F.sum("_s")).alias("dimension"))


def linear_contributions(cells: DataFrame, coefs: DataFrame, n_samples: int) -> DataFrame:
    """(sample_id, class, feature_id, contribution): coefficient times distance from the feature's mean; exact for linear models."""
    mean = cells.groupBy("feature_id").agg((F.sum("value") / n_samples).alias("_m"))
    return cells.join(mean, "feature_id").join(coefs, "feature_id").select("sample_id", "class", "feature_id", (V("coef") * (V("value") - V("_m"))).alias("contribution"))


def consistency(contrib: DataFrame) -> DataFrame:
    """Per class and feature: deviation, range and share of signs of the contributions."""
    c = V("contribution")
    return contrib.groupBy("class", "feature_id").agg(F.stddev_pop(c).alias("std"), (F.max(c) - F.min(c)).alias("range"), (100 * F.count_if(c > 0) / F.count("*")).alias("pct_positive"), (100 * F.count_if(c < 0) / F.count("*")).alias("pct_negative"))


def global_importance(contrib: DataFrame, pred: DataFrame) -> DataFrame:
    """Mean size of the contributions over right and wrong samples."""
    right = contrib.join(pred.select("sample_id", (V("truth") == V("prediction")).alias("_ok")), "sample_id")
    size = F.abs("contribution")
    return right.groupBy("class", "feature_id").agg(F.avg(F.when(V("_ok"), size)).alias("right"), F.avg(F.when(~V("_ok"), size)).alias("wrong"))


def label_distance(dense: DataFrame, labels: DataFrame) -> DataFrame:
    """(x, y, distance): mean distance between samples of two labels."""
    d = class_distances(dense, labels.toDF("sample_id", "tag")).where("tag <= other_tag")
    return d.groupBy(V("tag").alias("x"), V("other_tag").alias("y")).agg((F.sum(V("total") * V("size")) / F.sum(V("n") * V("size"))).alias("distance"))


def class_medoids(dense: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, sample_id): the sample with the least mean distance to its class; ties go to the smaller id."""
    d = class_distances(dense, labels.toDF("sample_id", "tag")).where("tag = other_tag")
    best = d.groupBy(V("tag").alias("label")).agg(F.min(F.struct(F.round(V("total") / V("n"), 9).alias("mean_distance"), V("id").alias("sample_id"))).alias("_b"))
    return best.select("label", V("_b")["sample_id"].alias("sample_id"), V("_b")["mean_distance"].alias("mean_distance"))


def prototypes(cells: DataFrame, obs: DataFrame, label: str, radius: float, n: int = 3) -> DataFrame:
    """(label, sample_id, rank, gain): up to n samples of each class that stand for it.

    A sample covers what lies within ``radius``, itself included. Round by round each class takes the sample that newly covers most of the class, less what
    it covers of other classes (then the smallest id), while that is above 0. Balls are counted block by block and never written; a round counts what the last one covered.
    """
    every, width = sized_classes(cells, obs.select("sample_id", V(label).alias("tag")))
    # Copies cover alike, and the one of least id is taken first, so a class is one candidate.
    counts = materialize(balls(every, every, width, radius), "balls")
    counts, chosen, left = counts.withColumnsRenamed({"own": "_new", "foreign": "_price"}), None, every
    for i in range(1, n + 1):
        gains = every.select("_class", "_n", "tag", "id").join(counts, "_n").withColumn("gain", V("_new") - V("_price")).where("gain > 0")
        first = gains.groupBy("tag").agg(F.min(F.struct((-V("gain")).alias("_g"), V("id").alias("id"), V("_class").alias("_c"))).alias("_b"))
        found = materialize(first.select(V("tag").alias("label"), V("_b")["id"].alias("sample_id"), F.lit(i).alias("rank"), (-V("_b")["_g"]).alias("gain"), V("_b")["_c"].alias("_class")), "prototypes")
        chosen = found.drop("_class") if chosen is None else chosen.unionByName(found.drop("_class"))
        if i == n:
            break
        covered = materialize(within(every.join(found.select("_class"), "_class", "left_semi"), left, width, radius), "covered")
        gone = materialize(left.join(covered, "_class", "left_semi"), "gone")
        left = materialize(left.join(covered, "_class", "left_anti"), "uncovered")
        less = balls(every, gone, width, radius, only_own=True).select("_n", V("own").alias("_less"))
        counts = materialize(counts.join(less, "_n", "left").select("_n", (V("_new") - F.coalesce("_less", F.lit(0))).alias("_new"), "_price"), "balls")
    return chosen


def class_scores(model, data: DataFrame, codes: DataFrame) -> DataFrame:
    """(sample_id, class, score) from a probabilistic Spark ML model and ``label_encode``'s codes."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(data).select("sample_id", F.posexplode(vector_to_array("probability")).alias("code", "score"))
    return out.join(F.broadcast(codes), "code").select("sample_id", V("value").alias("class"), "score")


def alr_ensemble(train: DataFrame, test: DataFrame, labels: DataFrame, references: Mapping[str, float], features: Sequence[str], kind: str = "logistic", **params) -> DataFrame:
    """(sample_id, class, score): one model per reference feature on its log ratios, soft vote by weight; absent references are skipped.

    References are few (a list that the caller gives); each model trains on Spark.
    """
    from assaymill.operators.normalise import alr

    codes = materialize(label_encode(labels, "label"), "codes")
    train, test = materialize(train, "train"), materialize(test, "test")  # read for each reference
    votes = []
    for ref, weight in references.items():
        if ref not in features:
            continue
        rest = [f for f in features if f != ref]
        model = classifier(kind, **params).fit(training(alr(train, ref), rest, labels, codes))
        votes.append((class_scores(model, vectors(alr(test, ref), rest), codes), weight))
    return soft_vote(votes)


@dataclass
class TwoStage:
    """An outer model whose predicted label joins the inner model's features as one more cell of each sample."""

    outer: Pipeline
    inner: Pipeline

    def _extended(self, cells: DataFrame) -> DataFrame:
        told = self.outer.predict(cells).select("sample_id", F.concat(F.lit("outer="), V("prediction")).alias("feature_id"), F.lit(1.0).alias("value"))
        return cells.select("sample_id", "feature_id", "value").unionByName(told)

    def fit(self, cells: DataFrame, outer_labels: DataFrame, labels: DataFrame) -> TwoStage:
        self.outer.fit(cells, outer_labels)
        names = [f"outer={r['value']}" for r in self.outer.codes.collect()]
        self.inner.features = [*self.inner.features, *names]
        self.inner.fit(self._extended(cells), labels)
        return self

    def predict(self, cells: DataFrame) -> DataFrame:
        return self.inner.predict(self._extended(cells))


def per_task(make: Callable[[], Pipeline], cells: DataFrame, tasks: Mapping[str, DataFrame], test: DataFrame) -> DataFrame:
    """(task, sample_id, prediction) of an independent model for each task's labels."""
    out = None
    for task, labels in tasks.items():
        one = make().fit(cells, labels).predict(test).withColumn("task", F.lit(task))
        out = one if out is None else out.unionByName(one)
    return out.select("task", "sample_id", "prediction")


def inclusion(groups: Sequence[str], score: Callable[[list[str]], float]) -> list[str]:
    """Groups taken one after the other, each kept only if the score of those kept so far improves."""
    kept: list[str] = []
    best = float("-inf")
    for g in groups:
        s = score([*kept, g])
        if s > best:
            kept, best = [*kept, g], s
    return kept


def masked(ranges: DataFrame, how: str = "binary") -> tuple[Callable[[DataFrame], object], Callable[[DataFrame, object], DataFrame]]:
    """A step for ``Pipeline``: values outside their feature's ranges become 0, so the model sees the ranges alone."""
    from assaymill.operators.prepare import in_ranges

    return (lambda cells: None), (lambda cells, _: in_ranges(cells, ranges, how))
