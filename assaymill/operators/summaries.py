"""Aggregations, windows and set operations on labelled tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assaymill.functions.ordering import ordered, running_sum, tile

V = F.col


def level_counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"))


def crosstab_long(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count("*").alias("n"))


def qc_samples(cells: DataFrame) -> DataFrame:
    return cells.groupBy("sample_id").agg(F.sum("value").alias("total_counts"), F.count_if(V("value") > 0).alias("n_features"), F.log1p(F.sum("value")).alias("log1p_total_counts"))


def qc_features(cells: DataFrame, n_samples: int) -> DataFrame:
    n = F.count_if(V("value") > 0)
    return cells.groupBy("feature_id").agg(n.alias("n_cells"), (F.sum("value") / n_samples).alias("mean_counts"), (100 * (1 - n / n_samples)).alias("pct_dropout_by_counts"), F.sum("value").alias("total_counts"))


def dotplot(cells: DataFrame, obs: DataFrame, group: str) -> DataFrame:
    """Mean and non-zero fraction per group and feature; absent cells count as 0."""
    tagged = obs.select("sample_id", V(group).alias("grp"))
    sizes = tagged.groupBy("grp").agg(F.count("*").alias("_n"))
    out = cells.join(tagged, "sample_id").groupBy("grp", "feature_id").agg(F.sum("value").alias("_s"), F.count_if(V("value") > 0).alias("_k")).join(sizes, "grp")
    return out.select("grp", "feature_id", (V("_s") / V("_n")).alias("mean"), (V("_k") / V("_n")).alias("fraction"))


def cluster_gini(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """(cluster, n, gini): impurity of the labels in each cluster."""
    n = df.groupBy(V(cluster).alias("cluster"), label).agg(F.count("*").alias("c")).withColumn("n", F.sum("c").over(Window.partitionBy("cluster")))
    return n.groupBy("cluster").agg(F.first("n").alias("n"), F.sum(V("c") / V("n") * (1 - V("c") / V("n"))).alias("gini"))


def total_gini(clusters: DataFrame) -> DataFrame:
    return clusters.agg((F.sum(V("n") * V("gini")) / F.sum("n")).alias("total_gini"))


def label_entropy(df: DataFrame, label: str) -> DataFrame:
    n = df.groupBy(label).agg(F.count("*").alias("c"))
    total = n.agg(F.sum("c").alias("t"))
    return n.crossJoin(F.broadcast(total)).agg((-F.sum(V("c") / V("t") * F.log2(V("c") / V("t")))).alias("entropy"))


def confounded(df: DataFrame, x: str, y: str) -> DataFrame:
    """Levels of x seen with exactly one y."""
    return df.groupBy(V(x).alias("x")).agg(F.min(y).alias("y"), F.count_distinct(y).alias("_k")).where("_k = 1").drop("_k")


def string_mode(df: DataFrame, key: str, value: str) -> DataFrame:
    """Most frequent value per key with its count; ties go to the smallest."""
    n = df.groupBy(key, value).agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.max_by(value, F.struct(V("n"), F.lit(0))).alias("_any"), F.max("n").alias("n")).drop("_any").join(n.withColumnRenamed("n", "_n"), key).where("n = _n").groupBy(key).agg(F.min(value).alias("mode"), F.first("n").alias("n"))


def group_sets(df: DataFrame, group: str, member: str, min_size: int = 1) -> DataFrame:
    """(group, members, n): distinct members, sorted and joined by commas, of groups that are large enough."""
    out = df.groupBy(group).agg(F.array_sort(F.collect_set(V(member).cast("string"))).alias("_m"))
    return out.where(F.size("_m") >= min_size).select(group, F.array_join("_m", ",").alias("members"), F.size("_m").cast("long").alias("n"))


def gene_set_average(cells: DataFrame, sets: DataFrame) -> DataFrame:
    """Sum over a set's members in the sample, by the number of members that the data knows."""
    known = sets.join(cells.select("feature_id").distinct(), "feature_id")
    size = known.groupBy("set_name").agg(F.count("*").alias("_n"))
    return cells.join(known, "feature_id").groupBy("sample_id", "set_name").agg(F.sum("value").alias("_s")).join(size, "set_name").select("sample_id", "set_name", (V("_s") / V("_n")).alias("value"))


def set_nonzero_fraction(cells: DataFrame, sets: DataFrame) -> DataFrame:
    size = sets.groupBy("set_name").agg(F.count("*").alias("_n"))
    return cells.where("value > 0").join(sets, "feature_id").groupBy("sample_id", "set_name").agg(F.count("*").alias("_k")).join(size, "set_name").select("sample_id", "set_name", (V("_k") / V("_n")).alias("fraction"))


def set_filter(fractions: DataFrame, n_samples: int, least: float, share: float) -> DataFrame:
    """Sets whose fraction reaches ``least`` in at least ``share`` of the samples."""
    n = fractions.groupBy("set_name").agg(F.count_if(V("fraction") >= least).alias("n_passing"))
    return n.where(V("n_passing") >= share * n_samples)


def fraction_by_meta(fractions: DataFrame, obs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean fraction per set for each level of each column, named ``column-level``, to 3 digits."""
    long = obs.select("sample_id", *[V(c).cast("string") for c in columns]).unpivot(["sample_id"], list(columns), "_c", "_l")
    return long.withColumn("level", F.concat_ws("-", "_c", "_l")).join(fractions, "sample_id").groupBy("set_name", "level").agg(F.round(F.avg("fraction"), 3).alias("fraction"))


def enrichment_summary(results: DataFrame, category: str, analysis: str, analyses: Sequence[str], p: Column, alpha: float = 0.05) -> DataFrame:
    """Significant rows per category and analysis, absent pairs as 0."""
    return results.where(p < alpha).groupBy(category).pivot(analysis, list(analyses)).agg(F.count(F.lit(1))).fillna(0)


def effect_summary(df: DataFrame, group: str, effect: str, significant: Column) -> DataFrame:
    x = F.abs(V(effect))
    return df.groupBy(group).agg(F.avg(x).alias("mean"), F.median(x).alias("median"), F.var_samp(x).alias("var"), F.min(x).alias("min"), F.max(x).alias("max"), F.stddev_samp(x).alias("sd"), F.count_if(significant).alias("n_sig"))


def metric_summary(results: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    return results.groupBy(*keys).agg(F.avg(value).alias("mean"), F.median(value).alias("median"), F.stddev_samp(value).alias("std"))


def joined_list(df: DataFrame, key: str, value: str, first: str, order: str) -> DataFrame:
    """Sorted ``;`` list of values per key, and the first of another column."""
    return df.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(V(value).cast("string"))), ";").alias("joined"), F.min_by(first, order).alias("first"))


def miss_frequency(pred: DataFrame, by: Sequence[str]) -> DataFrame:
    return pred.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(V("truth") != V("prediction")).alias("misses"), (F.count_if(V("truth") != V("prediction")) / F.count("*")).alias("frequency"))


def strategy_gain(trials: DataFrame, strategy: str, objective: str) -> DataFrame:
    """Mean objective per strategy less the smallest of them."""
    out = trials.groupBy(strategy).agg(F.avg(objective).alias("mean"))
    return out.withColumn("gain", V("mean") - F.min("mean").over(Window.partitionBy()))


def cm_total(cm: DataFrame) -> DataFrame:
    return cm.groupBy("truth", "prediction").agg(F.sum("n").alias("n"))


def cm_correctness(total: DataFrame) -> DataFrame:
    """Per class: hits, rows, accuracy and share of all rows."""
    out = total.groupBy("truth").agg(F.sum(F.when(V("truth") == V("prediction"), V("n")).otherwise(0)).alias("hits"), F.sum("n").alias("total"))
    return out.select("truth", "hits", "total", (V("hits") / V("total")).alias("accuracy"), (V("total") / F.sum("total").over(Window.partitionBy())).alias("share"))


def cm_spread(cm: DataFrame, folds: int) -> DataFrame:
    """Mean and population deviation of each cell over the folds; a fold without the cell counts 0."""
    out = cm.groupBy("truth", "prediction").agg((F.sum("n") / folds).alias("mean"), (F.sum(V("n") * V("n")) / folds).alias("_q"))
    return out.select("truth", "prediction", "mean", F.sqrt(F.greatest(V("_q") - V("mean") * V("mean"), F.lit(0.0))).alias("std"))


def coef_spread(coefs: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return coefs.groupBy(*by).agg(F.stddev_pop(value).alias("std"), F.var_pop(value).alias("var"))


def upset(df: DataFrame, item: str, group: str) -> DataFrame:
    """(combo, n, members): items by the exact combination of groups they are in."""
    combo = df.groupBy(item).agg(F.array_join(F.array_sort(F.collect_set(V(group).cast("string"))), "&").alias("combo"))
    return combo.groupBy("combo").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(V(item).cast("string"))), ",").alias("members"))


def unique_members(df: DataFrame, item: str, group: str) -> DataFrame:
    return df.groupBy(item).agg(F.min(group).alias(group), F.count_distinct(group).alias("_k")).where("_k = 1").drop("_k")


def label_variance(cells: DataFrame, obs: DataFrame, label: str) -> DataFrame:
    """Sample variance of every feature within each label, zeros included without being stored."""
    tagged = obs.select("sample_id", V(label).alias("label"))
    sizes = tagged.groupBy("label").agg(F.count("*").alias("_n"))
    s = cells.join(tagged, "sample_id").groupBy("label", "feature_id").agg(F.sum("value").alias("_s"), F.sum(V("value") * V("value")).alias("_q")).join(sizes, "label")
    return s.select("label", "feature_id", F.try_divide(V("_q") - V("_s") * V("_s") / V("_n"), V("_n") - 1).alias("variance"))


def top_n(df: DataFrame, order: Sequence[Column], n: int, by: Sequence[str] = ()) -> DataFrame:
    """First ``n`` rows, of each group if asked. The order should end in a unique key."""
    if not by:
        return df.orderBy(*order).limit(n)
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(V("rank") <= n)


def disjoint_top_n(df: DataFrame, kind: str, position: str, item: str, score: str, n: int) -> DataFrame:
    """Each kind, in order of ``position``, takes its best n items that no earlier kind has in its own raw top n."""
    order = Window.partitionBy(kind).orderBy(F.desc(score), item)
    raw = df.withColumn("_raw", F.row_number().over(order))
    first = raw.where(V("_raw") <= n).groupBy(item).agg(F.min(position).alias("_first"))
    free = raw.join(first, item, "left").where(V("_first").isNull() | (V("_first") >= V(position)))
    return free.withColumn("rank", F.row_number().over(order)).where(V("rank") <= n).select(kind, item, score, "rank")


def half_half(a: DataFrame, b: DataFrame, score: str, item: str, n: int) -> DataFrame:
    """The best n/2 of a, then the best n/2 of b that are not among them."""
    first = a.orderBy(F.desc(score), item).limit(n // 2).select(item, F.lit("a").alias("side"))
    second = b.join(first, item, "left_anti").orderBy(F.desc(score), item).limit(n // 2).select(item, F.lit("b").alias("side"))
    return first.unionByName(second)


def ratio_bins(df: DataFrame, value: str, key: str, bins: int = 10) -> DataFrame:
    """``df`` with ``bin``, one of so many bins of equal size by rising value."""
    return ordered(df, [value, key]).select(*df.columns, tile(bins).alias("bin"))


def noisy_features(df: DataFrame, label: str, item: str, ratio: str, q: float, how: str) -> DataFrame:
    """Items whose ratio is under their label's quantile, in any label, all labels, or by the median over labels."""
    cut = df.groupBy(label).agg(F.percentile(ratio, q).alias("_cut"))
    under = df.join(cut, label).withColumn("_low", V(ratio) < V("_cut"))
    g = under.groupBy(item)
    if how in ("any", "all"):
        return g.agg((F.bool_or("_low") if how == "any" else F.bool_and("_low")).alias("noisy")).where("noisy").select(item)
    stat = F.median if how == "median" else F.avg
    return g.agg(stat(ratio).alias("_r"), stat("_cut").alias("_c")).where("_r < _c").select(item)


def pareto_front(df: DataFrame, x: str, y: str, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows that no other beats in both columns: scanned by falling x, those whose y exceeds all before."""
    before = Window.partitionBy(*by).orderBy(F.desc(x), F.desc(y), key).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_top", F.max(y).over(before)).where(V("_top").isNull() | (V(y) > V("_top"))).drop("_top")


def cumulative_effect(df: DataFrame, value: str, key: str) -> DataFrame:
    """Decile by falling value, with the running share of the total."""
    rows = running_sum(df, value, [F.desc(value), key])
    return rows.select(key, tile(10).alias("decile"), F.try_divide("_upto", "_total").alias("cumulative"))


def argmax_class(scores: DataFrame) -> DataFrame:
    """Class of the highest score per sample; ties go to the first class by name."""
    best = scores.groupBy("sample_id").agg(F.max("score").alias("score"))
    return scores.join(best, ["sample_id", "score"]).groupBy("sample_id").agg(F.min("class").alias("prediction"), F.first("score").alias("score"))


def rank_winners(results: DataFrame, lower_is_better: Sequence[str] = ()) -> DataFrame:
    """(metric, fold, model): the best model; ties go to the first by name."""
    signed = F.when(V("metric").isin(*lower_is_better), V("value")).otherwise(-V("value")) if lower_is_better else -V("value")
    w = Window.partitionBy("metric", "fold").orderBy(signed, "model")
    return results.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("metric", "fold", "model")


def rank_table(winners: DataFrame) -> DataFrame:
    return winners.groupBy("metric", "model").agg(F.count("*").alias("wins"))


def pairwise_overlaps(sets: DataFrame) -> DataFrame:
    """(x, y, n) for every unordered pair of sets, empty overlaps included: the sets are a fixed collection."""
    names = sets.select("set_name").distinct()
    all_pairs = names.select(V("set_name").alias("x")).join(names.select(V("set_name").alias("y")), V("x") < V("y"))
    both = sets.select(V("set_name").alias("x"), "feature_id").join(sets.select(V("set_name").alias("y"), "feature_id"), "feature_id").where("x < y")
    return all_pairs.join(both.groupBy("x", "y").agg(F.count("*").alias("n")), ["x", "y"], "left").fillna(0, ["n"])


def jaccard_distance(sets: DataFrame) -> DataFrame:
    size = sets.groupBy("set_name").agg(F.count("*").alias("_k"))
    out = pairwise_overlaps(sets).join(size.toDF("x", "_a"), "x").join(size.toDF("y", "_b"), "y")
    return out.select("x", "y", (1 - V("n") / (V("_a") + V("_b") - V("n"))).alias("distance"))


def resolve_overlaps(sets: DataFrame) -> DataFrame:
    """Every item stays in its smallest set; ties go to the first name."""
    size = sets.withColumn("_k", F.count("*").over(Window.partitionBy("set_name")))
    return size.withColumn("_r", F.row_number().over(Window.partitionBy("feature_id").orderBy("_k", "set_name"))).where("_r = 1").select("set_name", "feature_id")


def in_all_groups(df: DataFrame, item: str, group: str) -> DataFrame:
    n = df.select(group).distinct().count()
    return df.groupBy(item).agg(F.count_distinct(group).alias("_k")).where(V("_k") == n).select(item)


def negative_contributions(flags: DataFrame, item: str) -> DataFrame:
    """Items negative for misses, and for hits or in training, positive nowhere: from columns wrong_neg, right_neg, train_neg, pos."""
    any_ = flags.groupBy(item).agg(*[F.bool_or(c).alias(c) for c in ("wrong_neg", "right_neg", "train_neg", "pos")])
    return any_.where("wrong_neg and (right_neg or train_neg) and not pos").select(item)


def distinct_orderings(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).where("x <> y").distinct()


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def topn_overlap(a: DataFrame, b: DataFrame, kind: str, item: str, score: str, n: int) -> DataFrame:
    """Share of two lists' top n that they have in common, per kind."""
    order = [F.desc(score), V(item)]
    both = top_n(a, order, n, [kind]).select(kind, item).join(top_n(b, order, n, [kind]).select(kind, item), [kind, item])
    return a.select(kind).distinct().join(both.groupBy(kind).agg(F.count("*").alias("_c")), kind, "left").select(kind, (F.coalesce("_c", F.lit(0)) / n).alias("overlap"))


def set_metadata(sets: DataFrame, order: str) -> DataFrame:
    """(set_name, size, source): distinct members of each set, and the source that comes first by ``order``."""
    return sets.groupBy("set_name").agg(F.count_distinct("feature_id").alias("size"), F.min_by("source", order).alias("source"))


def trial_table(trials: DataFrame, params: Sequence[str]) -> DataFrame:
    """One row per trial (n, objective, param, value): its parameters side by side."""
    return trials.groupBy("n").pivot("param", list(params)).agg(F.first("value")).join(trials.groupBy("n").agg(F.max("objective").alias("objective")), "n")


def curve_steps(points: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Points of curves with ``step``, their number from 1 along the curve."""
    return points.withColumn("step", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def average_curves(points: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean and variance over folds of the points that have one place (keys and ``step``) in their curves."""
    return points.groupBy(*keys, "step").agg(F.avg(value).alias("mean"), F.var_samp(value).alias("var"), F.count("*").alias("n"))


def z_columns(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Columns of a summary table less their mean, by their sample deviation; columns without spread become 0."""
    stats = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"_s_{c}") for c in columns])
    return df.crossJoin(F.broadcast(stats)).select(key, *[F.coalesce(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")), F.lit(0.0)).alias(c) for c in columns])


#: Aggregates that may be asked for by name.
AGGREGATES = {"mean": F.avg, "sum": F.sum, "median": F.median, "std": F.stddev_samp, "var": F.var_samp, "min": F.min, "max": F.max, "count": F.count}


def aggregate_by_name(df: DataFrame, by: Sequence[str], value: str, names: Sequence[str]) -> DataFrame:
    """``by`` and one column for each named aggregate of ``value``; a name that is unknown is an error."""
    unknown = [n for n in names if n not in AGGREGATES]
    if unknown:
        raise ValueError(f"unknown aggregates {unknown}; known are {sorted(AGGREGATES)}")
    return df.groupBy(*by).agg(*[AGGREGATES[n](value).alias(n) for n in names])


def outlier_table(flags: DataFrame, splits: DataFrame, obs: DataFrame, label: str) -> DataFrame:
    """(split, role, label, outliers, n): flagged samples per part of each split and label."""
    each = splits.join(obs.select("sample_id", F.col(label).alias("label")), "sample_id").join(flags.select("sample_id", F.lit(1).alias("_o")), "sample_id", "left")
    return each.groupBy("split", "role", "label").agg(F.count("_o").alias("outliers"), F.count("*").alias("n"))
