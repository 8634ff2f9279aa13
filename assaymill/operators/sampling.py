"""Splits, samples and class balance. Random draws are orders by md5 of seed and key, so they can be repeated anywhere."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assaymill.functions.expressions import hash_order, hash_rank
from assaymill.functions.ordering import ordered, same
from assaymill.operators.nearest import nearest, nearest_of_each_tag, probed, probes_for, space_of
from assaymill.storage import materialize

V = F.col


def hash_split(df: DataFrame, key: str, parts: Mapping[str, float], seed: int = 0) -> DataFrame:
    """(key, role): parts in order, each a share of the rows; the last takes the rest."""
    out = hash_rank(df.select(key), key, seed)
    names, upto, role = list(parts), 0.0, F.lit(None).cast("string")
    for name in names[:-1]:
        upto += parts[name]
        role = F.coalesce(role, F.when(V("_r") <= F.floor(V("_n") * upto + 1e-9), name))
    return out.select(key, F.coalesce(role, F.lit(names[-1])).alias("role"))


def stratified_kfold(df: DataFrame, key: str, label: str, k: int, seed: int = 0) -> DataFrame:
    return hash_rank(df.select(key, label), key, seed, [label]).select(key, label, ((V("_r") - 1) % k).cast("int").alias("fold"))


def kfold(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """Folds without strata, from the hash itself: no order over all rows is needed."""
    return df.select(key, (F.conv(F.substring(hash_order(key, seed), 1, 8), 16, 10).cast("long") % k).alias("fold"))


def group_kfold(df: DataFrame, group: str, label: str, k: int) -> DataFrame:
    """(group, fold): greedy, large groups first, each to the fold that evens out the labels most; no group spans folds.

    The groups' label counts, one row per group and label, are what the driver handles.
    """
    table: dict = {}
    for r in df.groupBy(group, label).count().collect():
        table.setdefault(r[group], {})[r[label]] = r["count"]
    total: dict = {}
    for counts in table.values():
        for name, n in counts.items():
            total[name] = total.get(name, 0) + n
    load = [{name: 0 for name in total} for _ in range(k)]
    where = []
    for g, counts in sorted(table.items(), key=lambda x: (-sum(x[1].values()), str(x[0]))):
        def cost(i: int, counts=counts) -> tuple:
            return sum(((load[i][n] + counts.get(n, 0)) / total[n]) ** 2 - (load[i][n] / total[n]) ** 2 for n in total), sum(load[i].values()), i

        best = min(range(k), key=cost)
        for n, c in counts.items():
            load[best][n] += c
        where.append((g, best))
    return df.sparkSession.createDataFrame(where, f"{group} {dict(df.dtypes)[group]}, fold int")


def sample_by_class(df: DataFrame, key: str, label: str, sizes: Mapping[str, int] | int, seed: int = 0) -> DataFrame:
    """First so many of each class in hash order, at most what it has."""
    n = F.lit(sizes) if isinstance(sizes, int) else F.coalesce(F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])[V(label)], F.lit(0))
    return hash_rank(df, key, seed, [label]).where(V("_r") <= n).drop("_r", "_n")


def preserving_sample(df: DataFrame, key: str, label: str, fraction: float, seed: int = 0) -> DataFrame:
    """A fraction of every class, at least one row of each."""
    out = hash_rank(df, key, seed, [label])
    return out.where(V("_r") <= F.greatest(F.lit(1), F.bround(V("_n") * fraction))).drop("_r", "_n")


def split_and_sample(df: DataFrame, key: str, label: str, share: float, n: int, seed: int = 0) -> DataFrame:
    """(key, label, role): a split whose test part also gets n of each class from train."""
    split = df.join(hash_split(df, key, {"test": share, "train": 1 - share}, seed), key)
    moved = sample_by_class(split.where("role = 'train'"), key, label, n, seed + 1).select(key, F.lit(1).alias("_m"))
    return split.join(moved, key, "left").select(key, label, F.when(V("_m") == 1, "test").otherwise(V("role")).alias("role"))


def keep_and_sample(df: DataFrame, key: str, label: str, stratum: str, value: str, fraction: float, seed: int = 0) -> DataFrame:
    """All of one stratum, and a label-preserving sample of the rest."""
    own = F.coalesce(V(stratum) == value, F.lit(False))
    return df.where(own).unionByName(preserving_sample(df.where(~own), key, label, fraction, seed))


def balanced_rounds(df: DataFrame, key: str, label: str, rounds: int) -> DataFrame:
    """Per round, as many of each class as the smallest has."""
    least = df.groupBy(label).agg(F.count("*").alias("_n")).agg(F.min("_n").alias("_least"))
    each = df.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).crossJoin(F.broadcast(least))
    order = F.md5(F.concat_ws("|", V("round").cast("string"), V(key).cast("string")))
    return each.withColumn("_r", F.row_number().over(Window.partitionBy("round", label).orderBy(order, key))).where(V("_r") <= V("_least")).drop("_r", "_least")


def spaced_targets(df: DataFrame, label: str, steps: int, move: int = 1, geometric: bool = True) -> DataFrame:
    """(label, n, target): each class goes ``move`` rungs from the last rung of the ladder at or under its size."""
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    lim = n.agg(F.min("n").cast("double").alias("_lo"), F.max("n").cast("double").alias("_hi"))
    at = V("pos") / (steps - 1)
    rung = V("_lo") * F.pow(V("_hi") / V("_lo"), at) if geometric else V("_lo") + (V("_hi") - V("_lo")) * at
    ladder = lim.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).select("pos", F.round(rung).cast("long").alias("rung"))
    own = n.join(F.broadcast(ladder), V("rung") <= V("n")).groupBy(label, "n").agg(F.max("pos").alias("_p"))
    goal = own.withColumn("pos", F.greatest(F.least(V("_p") + move, F.lit(steps - 1)), F.lit(0)))
    return goal.join(F.broadcast(ladder), "pos").select(label, "n", V("rung").alias("target"))


def sampling_strategy(df: DataFrame, label: str, strategy: str) -> DataFrame:
    """(label, n, target): classes a named strategy resamples to the largest (over) or smallest (minority reaches the largest)."""
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    w = Window.partitionBy()
    n = n.withColumns({"_lo": F.min("n").over(w), "_hi": F.max("n").over(w)})
    chosen = {"minority": V("n") == V("_lo"), "not minority": V("n") != V("_lo"), "not majority": V("n") != V("_hi"), "auto": V("n") != V("_hi"), "all": F.lit(True), "none": F.lit(False)}[strategy]
    return n.select(label, "n", F.when(chosen, V("_hi")).otherwise(V("n")).alias("target"))


def random_oversample(df: DataFrame, key: str, label: str, seed: int = 0) -> DataFrame:
    """Every row, and repeats in hash order until each class has as many as the largest; ``copy`` numbers them."""
    out = hash_rank(df, key, seed, [label])
    out = out.crossJoin(F.broadcast(df.groupBy(label).count().agg(F.max("count").alias("_hi"))))
    copies = F.floor((V("_hi") - V("_r")) / V("_n")) + 1
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), copies.cast("long")))).drop("_r", "_n", "_hi")


def random_undersample(df: DataFrame, key: str, label: str, seed: int = 0) -> DataFrame:
    least = df.groupBy(label).count().agg(F.min("count").alias("_lo"))
    return hash_rank(df, key, seed, [label]).crossJoin(F.broadcast(least)).where(V("_r") <= V("_lo")).drop("_r", "_n", "_lo")


def neighbours(cells: DataFrame, obs: DataFrame, label: str, k: int, within: bool = False) -> DataFrame:
    """(sample_id, label, other, other_label, distance, rank): the exact k nearest by Euclidean distance, of the same label if ``within``.

    Absent cells are 0. Ties go to the smaller id. All pairs are compared.
    """
    samples = obs.select("sample_id", V(label).alias("tag"))
    return nearest(cells, samples, cells, samples, k, same_tag=within).withColumnsRenamed({"tag": "label", "other_tag": "other_label"})


def tomek_links(nearest: DataFrame) -> DataFrame:
    """Mutual nearest neighbours of different classes, each pair once; from ``neighbours`` with k = 1."""
    back = nearest.select(V("sample_id").alias("other"), V("other").alias("sample_id"))
    return nearest.join(back, ["sample_id", "other"]).where((V("label") != V("other_label")) & (V("sample_id") < V("other"))).select("sample_id", "other", "label", "other_label", "distance")


def cross_links(nearest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nearest neighbours in another class: ((label, n, pct), (x, y, n))."""
    cross = nearest.where("label <> other_label")
    size = nearest.groupBy("label").agg(F.count("*").alias("_t"))
    per = size.join(cross.groupBy("label").agg(F.count("*").alias("n")), "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"), (100 * F.coalesce("n", F.lit(0)) / V("_t")).alias("pct"))
    pairs = cross.select(F.least("label", "other_label").alias("x"), F.greatest("label", "other_label").alias("y")).groupBy("x", "y").agg(F.count("*").alias("n"))
    return per, pairs


def enn_remove(nearest: DataFrame) -> DataFrame:
    """Samples whose k neighbours mostly belong to other classes."""
    return nearest.groupBy("sample_id").agg(F.count_if(V("label") != V("other_label")).alias("_d"), F.count("*").alias("_k")).where(2 * V("_d") > V("_k")).select("sample_id")


def smote(dense: DataFrame, near: DataFrame, seed: int = 0) -> DataFrame:
    """(sample_id, other, feature_id, value): one new row per sample, between it and a hash-picked neighbour of its class."""
    pick = near.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), V("sample_id").cast("string"), V("other").cast("string"))))
    pick = pick.withColumn("_r", F.row_number().over(Window.partitionBy("sample_id").orderBy("_h"))).where("_r = 1")
    weight = F.conv(F.substring("_h", 1, 8), 16, 10).cast("double") / 4294967296.0
    pick = pick.select("sample_id", "other", weight.alias("_w"))
    a = dense.join(pick, "sample_id")
    b = dense.select(V("sample_id").alias("other"), "feature_id", V("value").alias("_b"))
    return a.join(b, ["other", "feature_id"]).select("sample_id", "other", "feature_id", (V("value") + V("_w") * (V("_b") - V("value"))).alias("value"))


def near_miss(cells: DataFrame, obs: DataFrame, label: str, k: int = 3, version: int = 1) -> DataFrame:
    """(sample_id, label, score): every class cut to the size of the smallest, whose samples all stay (score null).

    Version 1 keeps the samples of least mean distance to their k nearest of the smallest class, version 2 to their k farthest. Version 3 keeps
    those of greatest mean distance to their k nearest, among the samples that are one of the k nearest of their class to any of the smallest class; where
    these are too few, the others follow in the same order.
    """
    tagged = obs.select("sample_id", V(label).alias("tag"))
    sizes = tagged.groupBy("tag").agg(F.count("*").alias("_n"))
    least = sizes.orderBy("_n", "tag").first()
    if least is None:
        return tagged.select("sample_id", V("tag").alias("label"), F.lit(None).cast("double").alias("score"))
    small = tagged.where(V("tag").eqNullSafe(F.lit(least["tag"])))
    large = tagged.where(~V("tag").eqNullSafe(F.lit(least["tag"])))
    part = lambda s: cells.join(s.select("sample_id"), "sample_id", "left_semi")
    far = nearest(part(large), large, part(small), small, k, farthest=version == 2).groupBy("sample_id").agg(F.round(F.avg("distance"), 9).alias("score"))
    ranked = large.join(far, "sample_id", "left")
    order = [V("score"), V("sample_id")]
    if version == 3:
        as_text = large.withColumn("sample_id", V("sample_id").cast("string"))
        met = nearest_of_each_tag(part(small), small, part(large).withColumn("sample_id", V("sample_id").cast("string")), as_text, k)
        ranked = ranked.join(met.withColumnRenamed("other", "_met"), V("sample_id").cast("string") == V("_met"), "left")
        order = [V("_met").isNull(), F.desc("score"), V("sample_id")]
    kept = ordered(ranked, order, ["tag"]).where(V("_nth") <= least["_n"]).select("sample_id", V("tag").alias("label"), "score")
    return kept.unionByName(small.select("sample_id", V("tag").alias("label"), F.lit(None).cast("double").alias("score")))


def quotas(weights: DataFrame, key: str, by: str, weight: str, total: str) -> DataFrame:
    """``weights`` with ``quota``: ``total`` (one number per group) shared in whole numbers by weight, by largest remainder (then by key); sums are exact."""
    sums = weights.groupBy(by).agg(F.sum(weight).alias("_w"))
    w = same(weights, sums, [by])
    share = F.coalesce(F.try_divide(V(weight) * V(total), V("_w")), F.lit(0.0))
    w = w.withColumns({"_down": F.floor(F.round(share, 9)), "_rest": F.round(share - F.floor(F.round(share, 9)), 9)})
    placed = ordered(w, [F.desc("_rest"), V(key)], [by])
    given = placed.groupBy(by).agg(F.sum("_down").alias("_given"))
    out = same(placed, given, [by])
    more = F.when((V("_w") > 0) & (V("_nth") <= V(total) - V("_given")), 1).otherwise(0)
    return out.withColumn("quota", (V("_down") + more).cast("long")).select(*weights.columns, "quota")


def difficulty(near: DataFrame) -> DataFrame:
    """(sample_id, label, other_class, k): of a sample's neighbours (``neighbours``), how many belong to another class."""
    return near.groupBy("sample_id", "label").agg(F.count_if(V("label") != V("other_label")).alias("other_class"), F.count("*").alias("k"))


def between(cells: DataFrame, picks: DataFrame) -> DataFrame:
    """(sample_id, copy, other, feature_id, value): points a share ``w`` of the way from sample to other; ``picks`` is (sample_id, copy, other, w). Cells where both are 0 stay absent."""
    a = cells.join(picks, "sample_id").select("sample_id", "copy", "other", "feature_id", (V("value") * (1 - V("w"))).alias("value"))
    b = cells.withColumnRenamed("sample_id", "other").join(picks, "other").select("sample_id", "copy", "other", "feature_id", (V("value") * V("w")).alias("value"))
    return a.unionByName(b).groupBy("sample_id", "copy", "other", "feature_id").agg(F.sum("value").alias("value"))


def picks_of(near: DataFrame, copies: DataFrame, seed: int = 0) -> DataFrame:
    """(sample_id, copy, other, w): for each of a sample's ``copies`` (sample_id, quota) a neighbour and a weight, both from md5."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), V("sample_id").cast("string"), V("copy").cast("string")))
    number = lambda at: F.conv(F.substring("_h", at, 8), 16, 10).cast("double") / 4294967296.0
    near = near.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("rank", "other"))).alias("_near"))  # k of them
    each = copies.where("quota > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), V("quota")))).select("sample_id", "copy").withColumn("_h", h)
    each = each.join(near, "sample_id")
    return each.select("sample_id", "copy", F.get("_near", F.floor(number(1) * F.size("_near")).cast("int"))["other"].alias("other"), number(9).alias("w"))


def adasyn(cells: DataFrame, obs: DataFrame, label: str, k: int = 5, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """((sample_id, label, other_class, quota), new points as ``between``): each class filled up to the largest, most where neighbours are of other classes.

    A sample's share of its class's new points is the share of other classes among its k neighbours; a class without any such neighbour gets none. Each
    point lies between the sample and one of its k nearest of its own class.
    """
    samples = obs.select("sample_id", V(label).alias("label"))
    sizes = samples.groupBy("label").agg(F.count("*").alias("_n"))
    goal = sizes.withColumn("_total", F.max("_n").over(Window.partitionBy()) - V("_n"))
    hard = same(difficulty(neighbours(cells, obs, label, k)), goal.select("label", "_total"), ["label"])
    given = materialize(quotas(hard, "sample_id", "label", "other_class", "_total").select("sample_id", "label", "other_class", "quota"), "quotas")
    return given, between(cells, picks_of(neighbours(cells, obs, label, k, within=True), given, seed))


def borderline_smote(cells: DataFrame, obs: DataFrame, label: str, k: int = 5, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """((sample_id, label, other_class, quota), new points): each class filled up to the largest, from its samples in danger alone: those with half or more, but not all, of their k neighbours in other classes."""
    samples = obs.select("sample_id", V(label).alias("label"))
    sizes = samples.groupBy("label").agg(F.count("*").alias("_n"))
    goal = sizes.withColumn("_total", F.max("_n").over(Window.partitionBy()) - V("_n"))
    hard = difficulty(neighbours(cells, obs, label, k)).withColumn("_danger", ((2 * V("other_class") >= V("k")) & (V("other_class") < V("k"))).cast("int"))
    shared = quotas(same(hard, goal.select("label", "_total"), ["label"]), "sample_id", "label", "_danger", "_total")
    given = materialize(shared.select("sample_id", "label", "other_class", "quota"), "quotas")
    return given, between(cells, picks_of(neighbours(cells, obs, label, k, within=True), given, seed))


def smote_even(cells: DataFrame, obs: DataFrame, label: str, k: int = 5, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(cells, samples (sample_id string, label)) of all samples and of new points that fill each class up to the largest, each sample taking its turn; new points are named after sample and copy."""
    samples = obs.select("sample_id", V(label).alias("label"))
    sizes = samples.groupBy("label").agg(F.count("*").alias("_n"))
    goal = sizes.withColumn("_total", F.max("_n").over(Window.partitionBy()) - V("_n"))
    given = quotas(same(samples.withColumn("_one", F.lit(1)), goal.select("label", "_total"), ["label"]), "sample_id", "label", "_one", "_total")
    given = materialize(given.select("sample_id", "label", "quota"), "quotas")
    picks = materialize(picks_of(neighbours(cells, obs, label, k, within=True), given, seed), "picks")
    name = F.concat_ws("+", V("sample_id").cast("string"), V("copy").cast("string"))
    made = picks.join(given.select("sample_id", "label"), "sample_id").select(name.alias("sample_id"), "label")
    new = between(cells, picks)
    every = cells.select(V("sample_id").cast("string").alias("sample_id"), "feature_id", V("value").cast("double").alias("value")).unionByName(new.select(name.alias("sample_id"), "feature_id", "value"))
    return every, samples.select(V("sample_id").cast("string").alias("sample_id"), "label").unionByName(made)


def smote_enn(cells: DataFrame, obs: DataFrame, label: str, k: int = 5, edit: int = 3, seed: int = 0) -> DataFrame:
    """(sample_id, label) of old and new samples after ``smote_even`` that ``edit`` neighbours do not outvote."""
    every, samples = smote_even(cells, obs, label, k, seed)
    return samples.join(enn_remove(neighbours(every, samples, "label", edit)), "sample_id", "left_anti")


def smote_tomek(cells: DataFrame, obs: DataFrame, label: str, k: int = 5, seed: int = 0) -> DataFrame:
    """(sample_id, label) of old and new samples after ``smote_even`` that are on no Tomek link."""
    every, samples = smote_even(cells, obs, label, k, seed)
    links = tomek_links(neighbours(every, samples, "label", 1))
    return samples.join(links.select("sample_id").union(links.select("other")), "sample_id", "left_anti")


def near_candidates(cells: DataFrame, samples: DataFrame, k: int = 5, recall: float = 0.95) -> DataFrame:
    """(sample_id, other): pairs of which one is among the other's k nearest in the cells it looks into, each pair once.

    How many cells that are is read from the data, so that on a bounded sample ``recall`` of all true neighbours are found.
    """
    tagged = samples.select("sample_id", F.lit("").alias("tag"))
    cells = materialize(cells, "cells")  # read by each step below
    space = space_of(cells, tagged)
    near = probed(cells, tagged, cells, tagged, k, probes_for(cells, tagged, k, recall, space), space)
    return near.select(F.least("sample_id", "other").alias("sample_id"), F.greatest("sample_id", "other").alias("other")).distinct()


def poisson_batches(df: DataFrame, key: str, batches: int, size: float, seed: int = 0) -> DataFrame:
    """``df`` with ``batch`` and ``copy``: bootstrap batches, each a share ``size`` (possibly over 1) of the rows in the mean.

    A row's number of copies in a batch is a Poisson draw from md5 of the seed, the batch and the key.
    """
    from math import exp, factorial

    most = int(size + 12 * max(size, 1) ** 0.5)
    below, total = [], 0.0
    for i in range(most):
        total += exp(-size) * size**i / factorial(i)
        below.append(round(total, 12))
    each = df.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))))
    u = F.conv(F.left(F.md5(F.concat_ws("|", F.lit(str(seed)), "batch", V(key).cast("string"))), F.lit(8)), 16, 10).cast("double") / 4294967296.0
    copies = F.size(F.filter(F.lit(below), lambda t: t <= u))
    return each.withColumn("_k", copies).where("_k > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), V("_k")))).drop("_k")
