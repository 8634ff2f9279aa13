"""Imputation, normalisation and batch correction of cells (sample_id, feature_id, value); an absent cell is 0."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assaymill.functions.expressions import average_rank
from assaymill.functions.ordering import ordered
from assaymill.storage import materialize


V = F.col


def densify(cells: DataFrame, samples: DataFrame, features: DataFrame) -> DataFrame:
    """All samples by the given features, absent cells as 0: for operators whose result is dense by definition."""
    grid = samples.select("sample_id").crossJoin(features.select("feature_id"))
    return grid.join(cells, ["sample_id", "feature_id"], "left").select("sample_id", "feature_id", F.coalesce("value", F.lit(0.0)).alias("value"))


def impute_plus_one(dense: DataFrame) -> DataFrame:
    return dense.withColumn("value", V("value") + 1)


def impute_replace_one(dense: DataFrame) -> DataFrame:
    return dense.withColumn("value", F.when(V("value") == 0, 1.0).otherwise(V("value")))


def impute_multi_replace(dense: DataFrame) -> DataFrame:
    """Rows closed to 1; zeros become delta = 1/P squared, the others shrink by what the zeros got."""
    total, p, zeros = F.sum("value").over(Window.partitionBy("sample_id")), F.count("*").over(Window.partitionBy("sample_id")), F.count_if(V("value") == 0).over(Window.partitionBy("sample_id"))
    return dense.withColumns({"_t": total, "_pp": p * p, "_z": zeros}).select("sample_id", "feature_id", F.when(V("value") == 0, 1 / V("_pp")).otherwise(F.try_divide(V("value"), V("_t")) * (1 - V("_z") / V("_pp"))).alias("value"))


def impute_labelled_median(dense: DataFrame, obs: DataFrame, label: str) -> DataFrame:
    """Zeros become the median of their feature within the sample's label, zeros included."""
    tagged = dense.join(obs.select("sample_id", V(label).alias("_label")), "sample_id")
    mid = tagged.groupBy("_label", "feature_id").agg(F.median("value").alias("_mid"))
    return tagged.join(mid, ["_label", "feature_id"]).select("sample_id", "feature_id", F.when(V("value") == 0, V("_mid")).otherwise(V("value")).alias("value"))


def impute_feature_median(dense: DataFrame) -> DataFrame:
    """Zeros become the median of the feature's non-zero values."""
    mid = dense.where("value <> 0").groupBy("feature_id").agg(F.median("value").alias("_mid"))
    return dense.join(mid, "feature_id", "left").select("sample_id", "feature_id", F.when(V("value") == 0, F.coalesce("_mid", F.lit(0.0))).otherwise(V("value")).alias("value"))


def clr(cells: DataFrame, samples: DataFrame, features: DataFrame, plus_one: bool = True, subset: DataFrame | None = None) -> DataFrame:
    """Log less the sample's mean log, over all features or a subset of them, for all samples by features.

    After plus-one an absent cell's log is 0 and its result is minus the mean, for which only present cells and the
    number of features are summed. Without plus-one a cell that is absent or not above 0 has no logarithm: null.
    """
    log = F.ln(V("value") + 1) if plus_one else F.ln(F.when(V("value") > 0, V("value")))
    counted = cells.withColumn("_log", log)
    over = features if subset is None else subset
    if subset is not None:
        counted = counted.join(subset.select("feature_id"), "feature_id", "left_semi")
    n = over.agg(F.count_distinct("feature_id").alias("_p"))
    mean = counted.groupBy("sample_id").agg(F.sum("_log").alias("_sum")).join(n).select("sample_id", (V("_sum") / V("_p")).alias("_mean"))
    out = densify(cells, samples, features).join(mean, "sample_id", "left")
    return out.select("sample_id", "feature_id", (log - F.coalesce("_mean", F.lit(0.0))).alias("value"))


def robust_clr(cells: DataFrame) -> DataFrame:
    """CLR over the non-zero values of a sample; zeros stay 0."""
    log = F.when(V("value") > 0, F.ln("value"))
    return cells.withColumn("_log", log).select("sample_id", "feature_id", F.coalesce(V("_log") - F.avg("_log").over(Window.partitionBy("sample_id")), F.lit(0.0)).alias("value"))


def normal_draw(seed: int, key: Column) -> Column:
    """One draw from N(0, 1) per key, from md5 of the seed and the key (Box and Muller), so that reruns and other engines agree."""
    part = lambda name: F.conv(F.left(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(name), key.cast("string"))), F.lit(8)), 16, 10).cast("double")
    return F.sqrt(-2 * F.ln((part("a") + 1) / 4294967297.0)) * F.cos(2 * F.pi() * part("b") / 4294967296.0)


def clr_scaled(cells: DataFrame, samples: DataFrame, features: DataFrame, scale: DataFrame, gamma: float = 0.1, seed: int = 0) -> DataFrame:
    """log2 CLR plus one draw per sample from N(log2 scale, gamma); ``scale`` has (sample_id, scale)."""
    shift = scale.select("sample_id", (normal_draw(seed, V("sample_id")) * max(gamma, 0.1) + F.log2("scale")).alias("_shift"))
    base = clr(cells, samples, features).join(shift, "sample_id")
    return base.select("sample_id", "feature_id", (V("value") / F.ln(F.lit(2.0)) + V("_shift")).alias("value"))


def alr(cells: DataFrame, reference: str) -> DataFrame:
    """Log ratio to a reference feature, which is dropped. Needs one positive value per sample and feature."""
    ref = cells.where(V("feature_id") == reference).select("sample_id", F.ln("value").alias("_ref"))
    return cells.where(V("feature_id") != reference).join(ref, "sample_id").select("sample_id", "feature_id", (F.ln("value") - V("_ref")).alias("value"))


def alr_scaled(cells: DataFrame, reference: str, scale: DataFrame, gamma: float = 0.1, seed: int = 0) -> DataFrame:
    """log2 ratio to a reference feature plus one draw per sample from N(log2 scale, gamma); ``scale`` has (sample_id, scale). Needs one positive value per sample and feature."""
    shift = scale.select("sample_id", (normal_draw(seed, V("sample_id")) * max(gamma, 0.1) + F.log2("scale")).alias("_shift"))
    return alr(cells, reference).join(shift, "sample_id").select("sample_id", "feature_id", (V("value") / F.ln(F.lit(2.0)) + V("_shift")).alias("value"))


def _length(var: DataFrame, fragment: float | None) -> DataFrame:
    return var.select("feature_id", (V("length") if fragment is None else V("length") - fragment + 1).alias("_len"))


def fpkm(cells: DataFrame, var: DataFrame, fragment: float | None = None) -> DataFrame:
    """Counts by effective length and sample total, times 1e9."""
    out = cells.withColumn("_t", F.sum("value").over(Window.partitionBy("sample_id"))).join(_length(var, fragment), "feature_id")
    return out.select("sample_id", "feature_id", F.coalesce(F.try_divide(V("value"), V("_len") * V("_t")) * 1e9, F.lit(0.0)).alias("value"))


def tpm(cells: DataFrame, var: DataFrame, fragment: float | None = None) -> DataFrame:
    """Counts by effective length, as a share of the sample's sum, times 1e6."""
    out = cells.join(_length(var, fragment), "feature_id").withColumn("_rate", F.try_divide("value", "_len"))
    return out.select("sample_id", "feature_id", F.coalesce(F.try_divide(V("_rate"), F.sum("_rate").over(Window.partitionBy("sample_id"))) * 1e6, F.lit(0.0)).alias("value"))


def normalize_total_log1p(cells: DataFrame, target: float = 1e4) -> DataFrame:
    return cells.select("sample_id", "feature_id", F.log1p(F.try_divide(V("value"), F.sum("value").over(Window.partitionBy("sample_id"))) * target).alias("value"))


def apply_size_factors(cells: DataFrame, factors: DataFrame) -> DataFrame:
    """Divide by (sample_id, factor), then log1p."""
    return cells.join(factors, "sample_id").select("sample_id", "feature_id", F.log1p(V("value") / V("factor")).alias("value"))


def median_of_ratios(cells: DataFrame, n_samples: int) -> DataFrame:
    """(sample_id, factor): median over features without a zero of value to the feature's geometric mean."""
    full = cells.where("value > 0").withColumns({"_n": F.count("*").over(Window.partitionBy("feature_id")), "_mean": F.avg(F.ln("value")).over(Window.partitionBy("feature_id"))}).where(V("_n") == n_samples)
    return full.groupBy("sample_id").agg(F.exp(F.median(F.ln("value") - V("_mean"))).alias("factor"))


def _log2(x: Column) -> Column:
    """Base-2 logarithm by the C library: Spark's is a quotient of two logarithms, whose last digit makes or breaks ties of ranks."""

    @F.pandas_udf("double")
    def log2(values: pd.Series) -> pd.Series:
        return pd.Series([math.log2(v) if v > 0 else None for v in values], dtype="float64")

    return log2(x)


def tmm_factors(cells: DataFrame, trim_m: float = 0.3, trim_a: float = 0.05) -> DataFrame:
    """(sample_id, total, factor): trimmed mean of M values, factors scaled to product 1.

    The reference is the sample whose upper quartile share is closest to the mean one (then the least id).
    """
    sized = cells.withColumn("total", F.sum("value").over(Window.partitionBy("sample_id"))).where("total > 0")
    upper = sized.where("value > 0").groupBy("sample_id").agg(F.percentile(V("value") / V("total"), 0.75).alias("_q"))
    far = upper.join(upper.agg(F.avg("_q").alias("_usual"))).withColumn("_far", F.abs(V("_q") - V("_usual")))
    ref = far.orderBy("_far", "sample_id").limit(1).select(V("sample_id").alias("_ref"))
    of_ref = sized.join(F.broadcast(ref), V("sample_id") == V("_ref")).select("feature_id", V("value").alias("_rv"), V("total").alias("_rt"))
    pair = sized.where("value > 0").join(of_ref.where("_rv > 0"), "feature_id")
    x, y = V("value") / V("total"), V("_rv") / V("_rt")
    pair = pair.select("sample_id", _log2(x / y).alias("m"), ((_log2(x) + _log2(y)) / 2).alias("a"), (1 / ((V("total") - V("value")) / V("total") / V("value") + (V("_rt") - V("_rv")) / V("_rt") / V("_rv"))).alias("w"))
    n = F.count("*").over(Window.partitionBy("sample_id"))
    pair = pair.withColumns({"n": n, "rm": average_rank(V("m"), "sample_id"), "ra": average_rank(V("a"), "sample_id")})
    low_m, low_a = F.floor(V("n") * trim_m) + 1, F.floor(V("n") * trim_a) + 1
    kept = pair.where(V("rm").between(low_m, V("n") + 1 - low_m) & V("ra").between(low_a, V("n") + 1 - low_a))
    raw = kept.groupBy("sample_id").agg(F.pow(F.lit(2.0), F.sum(V("m") * V("w")) / F.sum("w")).alias("f"))
    out = sized.groupBy("sample_id").agg(F.first("total").alias("total")).join(raw, "sample_id", "left").withColumn("f", F.coalesce("f", F.lit(1.0)))
    mean = out.agg(F.exp(F.avg(F.ln("f"))).alias("_g"))
    return out.crossJoin(F.broadcast(mean)).select("sample_id", "total", (V("f") / V("_g")).alias("factor"))


def logcpm(cells: DataFrame, factors: DataFrame, features: DataFrame, prior: float = 2.0) -> DataFrame:
    """log2 counts per million of the effective library size, with a prior scaled to it, for all samples of ``factors`` by features."""
    lib = factors.select("sample_id", (V("total") * V("factor")).alias("_lib"))
    mean = lib.agg(F.avg("_lib").alias("_usual"))
    lib = lib.join(mean).withColumn("_prior", prior * V("_lib") / V("_usual"))
    return densify(cells, factors, features).join(lib, "sample_id").select("sample_id", "feature_id", F.log2((V("value") + V("_prior")) / (V("_lib") + 2 * V("_prior")) * 1e6).alias("value"))


def fit_scaler(dense: DataFrame, how: str = "standard") -> DataFrame:
    """(feature_id, shift, scale) of a standard or min-max scaler."""
    if how == "standard":
        return dense.groupBy("feature_id").agg(F.avg("value").alias("shift"), F.stddev_pop("value").alias("scale"))
    return dense.groupBy("feature_id").agg(F.min("value").alias("shift"), (F.max("value") - F.min("value")).alias("scale"))


def apply_scaler(dense: DataFrame, scaler: DataFrame) -> DataFrame:
    """Shift and scale; features without spread become 0."""
    return dense.join(scaler, "feature_id").select("sample_id", "feature_id", F.coalesce(F.try_divide(V("value") - V("shift"), V("scale")), F.lit(0.0)).alias("value"))


def scale_by_batch(dense: DataFrame, obs: DataFrame, batch: str) -> DataFrame:
    w = Window.partitionBy("_batch", "feature_id")
    out = dense.join(obs.select("sample_id", V(batch).alias("_batch")), "sample_id")
    return out.select("sample_id", "feature_id", F.coalesce(F.try_divide(V("value") - F.avg("value").over(w), F.stddev_pop("value").over(w)), F.lit(0.0)).alias("value"))


def chain(df: DataFrame, steps: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    return reduce(lambda d, f: d.transform(f), steps, df)


def into_ranks(dense: DataFrame, standardise: bool = False) -> DataFrame:
    """Average rank within the sample; standardised per feature if asked."""
    out = dense.select("sample_id", "feature_id", average_rank(V("value"), "sample_id").cast("double").alias("value"))
    return apply_scaler(out, fit_scaler(out)) if standardise else out


def remove_batch(dense: DataFrame, obs: DataFrame, batch: str) -> DataFrame:
    """One-factor correction on log1p: batch means moved to their plain average; then back, clipped at 0 and cut to whole counts."""
    logged = dense.join(obs.select("sample_id", V(batch).alias("_batch")), "sample_id").withColumn("_log", F.log1p("value"))
    means = logged.groupBy("_batch", "feature_id").agg(F.avg("_log").alias("_mean"))
    means = means.withColumn("_all", F.avg("_mean").over(Window.partitionBy("feature_id")))
    out = logged.join(means, ["_batch", "feature_id"])
    return out.select("sample_id", "feature_id", F.floor(F.greatest(F.expm1(V("_log") - V("_mean") + V("_all")), F.lit(0.0)) + 1e-9).cast("double").alias("value"))


def lfc_batch_scale(counts: DataFrame, obs: DataFrame, batch: str, first: str, second: str) -> DataFrame:
    """Two batches brought together by the root of the ratio of their means, feature by feature."""
    out = counts.join(obs.select("sample_id", V(batch).alias("_batch")), "sample_id")
    means = out.groupBy("feature_id").agg(F.avg(F.when(V("_batch") == first, V("value"))).alias("_a"), F.avg(F.when(V("_batch") == second, V("value"))).alias("_b"))
    ratio = F.when((V("_a") > 0) & (V("_b") > 0), F.sqrt(V("_a") / V("_b"))).otherwise(1.0)
    scaled = out.join(means, "feature_id").withColumn("_r", ratio)
    return scaled.select("sample_id", "feature_id", F.when(V("_batch") == first, V("value") / V("_r")).otherwise(V("value") * V("_r")).alias("value"))


def batch_dispersion(dense: DataFrame, obs: DataFrame, batch: str) -> DataFrame:
    """(batch, feature_id, mean, dispersion): moments of a negative binomial, var = mean + dispersion mean squared."""
    out = dense.join(obs.select("sample_id", V(batch).alias("batch")), "sample_id").groupBy("batch", "feature_id").agg(F.avg("value").alias("mean"), F.var_samp("value").alias("_var"))
    return out.select("batch", "feature_id", "mean", F.greatest(F.coalesce(F.try_divide(V("_var") - V("mean"), V("mean") * V("mean")), F.lit(0.0)), F.lit(0.0)).alias("dispersion"))


def batch_confounding(obs: DataFrame, batch: str, group: str) -> DataFrame:
    """Per batch: its groups, how many other batches share one, and whether it stands alone."""
    pairs = obs.select(V(batch).alias("batch"), V(group).alias("grp")).distinct()
    other = pairs.withColumnsRenamed({"batch": "_other"})
    n = pairs.join(other, "grp").groupBy("batch").agg(F.count_distinct("grp").alias("n_groups"), (F.count_distinct("_other") - 1).alias("n_linked"))
    return n.withColumn("confounded", V("n_linked") == 0)


def correction_audit(before: DataFrame, after: DataFrame, by: str = "feature_id") -> DataFrame:
    """Per feature or sample: mean and spread of the change, and of its size."""
    d = before.join(after.withColumnRenamed("value", "_new"), ["sample_id", "feature_id"]).withColumn("_d", V("_new") - V("value"))
    return d.groupBy(by).agg(F.avg("_d").alias("mean_diff"), F.avg(F.abs("_d")).alias("mean_abs_diff"), F.stddev_samp("_d").alias("sd_diff"), F.avg(F.try_divide("_new", "value")).alias("mean_fold"))


def mean_adjust(before: DataFrame, after: DataFrame, new: DataFrame) -> DataFrame:
    """New data divided by each feature's mean ratio of raw to corrected; a ratio of 0 gives 0."""
    factor = before.join(after.withColumnRenamed("value", "_c"), ["sample_id", "feature_id"]).groupBy("feature_id").agg(F.coalesce(F.avg(F.try_divide("value", "_c")), F.lit(0.0)).alias("_f"))
    return new.join(factor, "feature_id").select("sample_id", "feature_id", F.coalesce(F.try_divide("value", "_f"), F.lit(0.0)).alias("value"))


def technical_effect(dense: DataFrame, obs: DataFrame, group: str, batch: str, share: float = 0.9) -> DataFrame:
    """(feature_id, effect, upto, high): variation between batches within groups; ``high`` are the features that cover ``share`` of it."""
    tagged = dense.join(obs.select("sample_id", V(group).alias("_g"), V(batch).alias("_b")), "sample_id")
    cell = tagged.groupBy("feature_id", "_g", "_b").agg(F.count("*").alias("_n"), F.avg("value").alias("_m"), F.sum("value").alias("_s"))
    w = Window.partitionBy("feature_id", "_g")
    effect = cell.withColumn("_gm", F.sum("_s").over(w) / F.sum("_n").over(w)).groupBy("feature_id").agg(F.sum(V("_n") * F.pow(V("_m") - V("_gm"), 2)).alias("effect"))
    order = Window.partitionBy().orderBy(F.desc("effect"), "feature_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = effect.withColumn("upto", F.try_divide(F.sum("effect").over(order), F.sum("effect").over(Window.partitionBy())))
    return out.withColumn("high", V("upto") - F.try_divide(V("effect"), F.sum("effect").over(Window.partitionBy())) < share)


def agg(name: str) -> Callable[[Column | str], Column]:
    """Aggregates by name."""
    return {"mean": F.avg, "sum": F.sum, "median": F.median, "std": F.stddev_samp, "var": F.var_samp}[name]


def encode_pairs(cells: DataFrame, samples: DataFrame, pairs: DataFrame) -> DataFrame:
    """(sample_id, x, y, value) of all samples by the given feature pairs (x, y): 1 where x is above y, absent cells as 0, else 0.

    A sample's values become one array with a place for each feature of the pairs, and pairs are read from it by place.
    """
    named = pairs.select(V("x").alias("feature_id")).union(pairs.select("y")).distinct()
    places = materialize(ordered(named, ["feature_id"]).select("feature_id", V("_nth").cast("int").alias("_i")), "places")
    n = places.count()
    held = cells.join(places, "feature_id").groupBy("sample_id").agg(F.collect_list(F.struct("_i", V("value").cast("double").alias("_v"))).alias("_m"))
    rows = samples.select("sample_id").join(held, "sample_id", "left").withColumn("_m", F.coalesce("_m", F.array().cast("array<struct<_i:int,_v:double>>")))
    rest = F.array_except(F.sequence(F.lit(1), F.lit(n)) if n else F.array().cast("array<int>"), V("_m")["_i"])
    every = F.array_sort(F.concat("_m", F.transform(rest, lambda i: F.struct(i.alias("_i"), F.lit(0.0).alias("_v")))))
    rows = rows.select("sample_id", every["_v"].alias("_v"))
    placed = pairs.join(places.toDF("x", "_x"), "x", "left").join(places.toDF("y", "_y"), "y", "left").select("x", "y", "_x", "_y")
    value = lambda at: F.coalesce(F.get("_v", V(at) - 1), F.lit(0.0))
    return rows.crossJoin(materialize(placed, "pairs")).select("sample_id", "x", "y", (value("_x") > value("_y")).cast("int").alias("value"))
