"""Feature selection and class-pure value ranges."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assaymill.functions.ordering import ordered
from assaymill.storage import materialize

V = F.col


def variances(cells: DataFrame, n_samples: int) -> DataFrame:
    """(feature_id, mean, variance): population variance, absent cells as 0."""
    s = cells.groupBy("feature_id").agg((F.sum("value") / n_samples).alias("mean"), (F.sum(V("value") * V("value")) / n_samples).alias("_q"))
    return s.select("feature_id", "mean", (V("_q") - V("mean") * V("mean")).alias("variance"))


def variance_threshold(cells: DataFrame, n_samples: int, least: float) -> DataFrame:
    return variances(cells, n_samples).where(V("variance") > least).select("feature_id", "variance")


def mutual_information(dense: DataFrame, obs: DataFrame, label: str, bins: int = 5) -> DataFrame:
    """(feature_id, mi): plug-in mutual information of the class with equal-frequency bins, in nats."""
    cut = dense.withColumn("bin", F.ntile(bins).over(Window.partitionBy("feature_id").orderBy("value", "sample_id")))
    n = cut.join(obs.select("sample_id", V(label).alias("label")), "sample_id").groupBy("feature_id", "bin", "label").agg(F.count("*").alias("c"))
    s = lambda *by: F.sum("c").over(Window.partitionBy("feature_id", *by))
    n = n.withColumns({"_b": s("bin"), "_l": s("label"), "_t": s()})
    return n.groupBy("feature_id").agg(F.sum(V("c") / V("_t") * F.ln(V("c") * V("_t") / (V("_b") * V("_l")))).alias("mi"))


def min_ratio_n(ratios: DataFrame, batch: str, label: str, key: str, n: int) -> DataFrame:
    """The n smallest ratios of batch to label effect: choosing n of them to minimise the sum is a sort."""
    return ratios.withColumn("ratio", F.try_divide(batch, label)).where(V("ratio").isNotNull() & (F.abs("ratio") < F.lit(float("inf")))).orderBy("ratio", key).limit(n).select(key, "ratio")


def distance_vote(dense: DataFrame, rounds: int, n: int, seed: int = 0) -> DataFrame:
    """(feature_id, votes): features among the n closest between hashed pairs of samples, over rounds."""
    samples = dense.select("sample_id").distinct()
    each = samples.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    order = F.md5(F.concat_ws("|", V("round").cast("string"), F.lit(str(seed)), V("sample_id").cast("string")))
    each = each.withColumn("_k", F.row_number().over(Window.partitionBy("round").orderBy(order)) - 1)
    left = each.where("_k % 2 = 0").select("round", F.floor(V("_k") / 2).alias("pair"), V("sample_id").alias("_a"))
    right = each.where("_k % 2 = 1").select("round", F.floor(V("_k") / 2).alias("pair"), V("sample_id").alias("_b"))
    pairs = left.join(right, ["round", "pair"])
    a, b = dense.select(V("sample_id").alias("_a"), "feature_id", V("value").alias("_x")), dense.select(V("sample_id").alias("_b"), "feature_id", V("value").alias("_y"))
    d = pairs.join(a, "_a").join(b, ["_b", "feature_id"]).groupBy("round", "feature_id").agg(F.sum((V("_x") - V("_y")) * (V("_x") - V("_y"))).alias("_d"))
    best = d.withColumn("_r", F.row_number().over(Window.partitionBy("round").orderBy("_d", "feature_id"))).where(V("_r") <= n)
    return best.groupBy("feature_id").agg(F.count("*").alias("votes"))


def highly_variable(cells: DataFrame, n_samples: int, bins: int = 5) -> DataFrame:
    """(feature_id, dispersion, z): dispersion standardised within bins of equal width of the log mean."""
    v = variances(cells, n_samples).where("mean > 0").select("feature_id", F.log1p("mean").alias("_m"), F.ln(V("variance") / V("mean") + 1e-12).alias("dispersion"))
    lim = v.agg(F.min("_m").alias("_lo"), F.max("_m").alias("_hi"))
    v = v.crossJoin(F.broadcast(lim)).withColumn("bin", F.least(F.floor(F.coalesce(F.try_divide(V("_m") - V("_lo"), V("_hi") - V("_lo")), F.lit(0.0)) * bins), F.lit(bins - 1)))
    w = Window.partitionBy("bin")
    return v.select("feature_id", "bin", "dispersion", F.coalesce(F.try_divide(V("dispersion") - F.avg("dispersion").over(w), F.stddev_samp("dispersion").over(w)), F.lit(0.0)).alias("z"))


def mad_outliers(df: DataFrame, key: str, columns: Sequence[str], n_mads: float, any_of: bool = True) -> DataFrame:
    """Keys further than ``n_mads`` unscaled MADs from the median, in any or all columns."""
    long = df.select(key, *[V(c).cast("double") for c in columns]).unpivot([key], list(columns), "_c", "_v")
    mid = long.groupBy("_c").agg(F.median("_v").alias("_mid"))
    off = long.join(F.broadcast(mid), "_c").withColumn("_off", F.abs(V("_v") - V("_mid")))
    mad = off.groupBy("_c").agg(F.median("_off").alias("_mad"))
    flag = off.join(F.broadcast(mad), "_c").withColumn("_out", V("_off") > n_mads * V("_mad"))
    return flag.groupBy(key).agg((F.bool_or("_out") if any_of else F.bool_and("_out")).alias("outlier")).where("outlier").select(key)


def median_abs_lfc(lfc: DataFrame, dropout: DataFrame | None = None, most: float = 10.0) -> DataFrame:
    """Median size of a feature's effects over classes; features with much dropout are left out."""
    kept = lfc if dropout is None else lfc.join(dropout.where(V("pct_dropout_by_counts") <= most), "feature_id", "left_semi")
    return kept.groupBy("feature_id").agg(F.median(F.abs("lfc")).alias("score"))


def redundant_features(pairs: DataFrame, presence: DataFrame, value: str, least: float) -> DataFrame:
    """Features that a threshold graph links to one seen in more samples (n_cells; then the first by name): one per component stays."""
    links = pairs.where(V(value) >= least).select("x", "y")
    both = links.union(links.select("y", "x")).toDF("a", "b")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("l")).select(V("a").alias("feature_id"), F.least("a", "l").alias("root")), "labels")
    while True:  # labels spread over links, then jump to their own label's label
        near = both.join(labels.withColumnRenamed("feature_id", "b"), "b").groupBy(V("a").alias("feature_id")).agg(F.min("root").alias("_n"))
        step = labels.join(near, "feature_id").select("feature_id", F.least("root", "_n").alias("root"), V("root").alias("_old"))
        jump = labels.select(V("feature_id").alias("root"), V("root").alias("_further"))
        new = materialize(step.join(jump, "root", "left").select("feature_id", F.least("root", F.coalesce("_further", "root")).alias("root"), "_old"), "labels")
        if new.where("root <> _old").isEmpty():
            break
        labels = new.select("feature_id", "root")
    w = Window.partitionBy("root").orderBy(F.desc("n_cells"), "feature_id")
    return new.join(presence, "feature_id").withColumn("_r", F.row_number().over(w)).where("_r > 1").select("feature_id")


def range_edges(cells: DataFrame, n: int) -> DataFrame:
    """(feature_id, edge, position): n evenly spaced edges from the least to the largest value."""
    lim = cells.groupBy("feature_id").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    out = lim.withColumn("position", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return out.select("feature_id", "position", (V("_lo") + (V("_hi") - V("_lo")) * V("position") / (n - 1)).alias("edge"))


def range_gini(cells: DataFrame, obs: DataFrame, label: str, n: int) -> DataFrame:
    """(feature_id, lo, hi, n, gini) of all pairs of edges with a value between them.

    Values are counted per interval of edges first; a range's counts are sums over at most n intervals, so
    the pairs never meet the samples.
    """
    edges = range_edges(cells, n)
    lim = edges.groupBy("feature_id").agg(F.min("edge").alias("_lo"), F.max("edge").alias("_hi"))
    at = F.coalesce(F.try_divide(V("value") - V("_lo"), V("_hi") - V("_lo")), F.lit(0.0)) * (n - 1)
    # An edge belongs to the ranges on both sides; values on it get a slot of their own.
    slot = F.when(at == F.round(at), 2 * F.round(at)).otherwise(2 * F.floor(at) + 1).cast("int")
    counts = cells.join(F.broadcast(lim), "feature_id").join(obs.select("sample_id", V(label).alias("label")), "sample_id").withColumn("slot", slot).groupBy("feature_id", "label", "slot").agg(F.count("*").alias("c"))
    a, b = edges.select("feature_id", V("position").alias("i"), V("edge").alias("lo")), edges.select("feature_id", V("position").alias("j"), V("edge").alias("hi"))
    inside = a.join(b, "feature_id").where("i < j").join(counts, "feature_id").where((V("slot") >= 2 * V("i")) & (V("slot") <= 2 * V("j")))
    per = inside.groupBy("feature_id", "i", "j", "lo", "hi", "label").agg(F.sum("c").alias("c")).withColumn("_t", F.sum("c").over(Window.partitionBy("feature_id", "i", "j")))
    return per.groupBy("feature_id", "i", "j", "lo", "hi").agg(F.first("_t").alias("n"), F.sum(V("c") / V("_t") * (1 - V("c") / V("_t"))).alias("gini"))


def pure_intervals(ginis: DataFrame, cutoff: float) -> DataFrame:
    return ginis.where(V("gini") < cutoff)


def merged_ranges(pure: DataFrame) -> DataFrame:
    """(feature_id, lo, hi, n_intervals): overlapping pure intervals joined to their hull (gaps and islands)."""
    w = Window.partitionBy("feature_id").orderBy("lo", "hi")
    top = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = pure.withColumn("_new", (F.coalesce(top, V("lo") - 1) < V("lo")).cast("int"))
    marked = marked.withColumn("_isle", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.groupBy("feature_id", "_isle").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n_intervals")).drop("_isle")


def range_best(ginis: DataFrame, n: int) -> DataFrame:
    """Features by mean of (1 - gini) times count, best first."""
    return ginis.groupBy("feature_id").agg(F.avg((1 - V("gini")) * V("n")).alias("score")).orderBy(F.desc("score"), "feature_id").limit(n)


def rank_by(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Rank from 1 by ``order``, ties alike."""
    return ordered(df, order).select(*df.columns, V("_rank").cast("int").alias(name))


def top_l1(coefs: DataFrame, n: int, per_class: bool = False) -> DataFrame:
    """The n features of largest mean absolute coefficient (class, feature_id, coef), or the n of each class."""
    if per_class:
        w = Window.partitionBy("class").orderBy(F.desc(F.abs("coef")), "feature_id")
        return coefs.where("coef <> 0").withColumn("rank", F.row_number().over(w)).where(V("rank") <= n).select("class", "feature_id", "coef")
    return coefs.groupBy("feature_id").agg(F.avg(F.abs("coef")).alias("score")).where("score > 0").orderBy(F.desc("score"), "feature_id").limit(n)


def nonzero_importance(importances: DataFrame) -> DataFrame:
    """Features (feature_id, importance) that a model used at all."""
    return importances.where("importance > 0")


def chain_selectors(cells: DataFrame, selectors: Sequence[tuple[Callable[[DataFrame], DataFrame], int | None]]) -> DataFrame:
    """Features that selectors leave, each narrowing what the last one kept.

    A selector takes cells and returns features, best first by ``score`` where it has that column; with a number only
    the first so many of them go on.
    """
    kept = cells.select("feature_id").distinct()
    for select, n in selectors:
        found = select(cells.join(kept, "feature_id", "left_semi"))
        if n is not None:
            found = found.orderBy(*([F.desc("score")] if "score" in found.columns else []), "feature_id").limit(n)
        kept = found.select("feature_id")
    return kept
