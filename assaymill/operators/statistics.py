"""Differential tests, associations and enrichment, from moments and ranks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import log, pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assaymill.functions.expressions import average_rank, value_ranks
from assaymill.functions.ordering import carried, ordered, same
from assaymill.functions.tails import ln_chi2_upper, ln_f_upper, ln_t_two_sided, with_p
from assaymill.storage import lookup

V = F.col


def auroc(cells: DataFrame, obs: DataFrame, label: str, features: DataFrame | None = None) -> DataFrame:
    """(feature_id, label, auroc, z) of each class against the rest, with tie correction.

    Only cells that are not 0 are ranked, by distinct value: a feature's zeros, stored or absent, are one block of ties between its negative
    and its positive values, whose size follows from ``obs``. Features without cells have an area of one half if ``features`` lists
    them. Ranks are shared by all classes.
    """
    tags = obs.select("sample_id", V(label).alias("label"))
    sizes = tags.groupBy("label").agg(F.count("*").alias("_p"))
    sizes = sizes.withColumn("_n", F.sum("_p").over(Window.partitionBy()))
    listed = (cells if features is None else features).select("feature_id").distinct()
    counts = cells.where("value <> 0").join(tags, "sample_id").groupBy("feature_id", "value", "label").agg(F.count("*").alias("_c"))
    ties = counts.groupBy("feature_id", "value").agg(F.sum("_c").alias("_t"))
    upto = F.sum("_t").over(Window.partitionBy("feature_id").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # places among the cells that are not 0; positive values stand behind the block of zeros as well
    ranks = ties.select("feature_id", "value", (upto - (V("_t") - 1) / 2).alias("_r"))
    blocks = ties.groupBy("feature_id").agg(F.sum("_t").alias("_cells"), F.sum(F.when(V("value") < 0, V("_t")).otherwise(0)).alias("_below"), F.sum(V("_t") * (V("_t") * V("_t") - 1)).alias("_ties"))
    placed = counts.join(ranks, ["feature_id", "value"]).groupBy("feature_id", "label")
    placed = placed.agg(F.sum(V("_r") * V("_c")).alias("_rs"), F.sum("_c").alias("_k"), F.sum(F.when(V("value") > 0, V("_c")).otherwise(0)).alias("_up"))
    grid = listed.crossJoin(sizes)
    s = grid.join(placed.withColumnRenamed("label", "_l"), (grid["feature_id"] == placed["feature_id"]) & grid["label"].eqNullSafe(V("_l")), "left").drop(placed["feature_id"], "_l")
    s = s.join(blocks, "feature_id", "left").fillna(0, ["_rs", "_k", "_up", "_cells", "_below", "_ties"])
    s = s.withColumns({"_q": V("_n") - V("_p"), "_zeros": V("_n") - V("_cells")})
    ties_all = V("_ties") + V("_zeros") * (V("_zeros") * V("_zeros") - 1)
    sums = V("_rs") + V("_up") * V("_zeros") + (V("_p") - V("_k")) * (V("_below") + (V("_zeros") + 1) / 2)
    a = (sums - V("_p") * (V("_p") + 1) / 2) / (V("_p") * V("_q"))
    sd = F.sqrt(F.greatest((V("_n") + 1 - ties_all / (V("_n") * (V("_n") - 1))) / (12 * V("_p") * V("_q")), F.lit(0.0)))
    return s.where("_q > 0").select("feature_id", "label", a.alias("auroc"), F.try_divide(a - 0.5, sd).alias("z"))


# Coefficients of a Chebyshev fit to the complementary error function (relative error under 1.2e-7).
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def two_sided_p(z: Column) -> Column:
    """Two-sided normal tail, to seven digits however small it is."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + x / 2)
    fit = reduce(lambda inner, c: F.lit(c) + t * inner, ERFC[-2::-1], F.lit(ERFC[-1]))
    return t * F.exp(fit - x * x)


def log_factorial(n: Column) -> Column:
    """ln n!, by Stirling's series eight places further on."""
    x = n + 9.0
    series = (x - 0.5) * F.ln(x) - x + 0.5 * log(2 * pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return series - sum(F.ln(n + float(k)) for k in range(1, 9))


def hypergeometric_tail(hits: Column, drawn: Column, good: Column, total: Column) -> Column:
    """P(at least ``hits`` of ``good`` among ``drawn`` of ``total``)."""
    choose = lambda n, k: log_factorial(n) - log_factorial(k) - log_factorial(n - k)
    most, least = F.least(good, drawn), F.greatest(hits, drawn + good - total)
    term = lambda i: F.exp(choose(good, i) + choose(total - good, drawn - i) - choose(total, drawn))
    return F.when(least > most, 0.0).otherwise(F.aggregate(F.sequence(least, F.greatest(least, most)), F.lit(0.0), lambda s, i: s + term(i)))


def class_moments(cells: DataFrame, obs: DataFrame, label: str) -> DataFrame:
    """Per feature and class: size, mean and sample variance of the class (1) and of the rest (2), zeros included."""
    tagged = obs.select("sample_id", V(label).alias("label"))
    sizes = tagged.groupBy("label").agg(F.count("*").alias("n1"))
    total = tagged.count()
    s = cells.join(tagged, "sample_id").groupBy("feature_id", "label").agg(F.sum("value").alias("s1"), F.sum(V("value") * V("value")).alias("q1")).join(sizes, "label")
    w = Window.partitionBy("feature_id")
    s = s.withColumns({"s2": F.sum("s1").over(w) - V("s1"), "q2": F.sum("q1").over(w) - V("q1"), "n2": total - V("n1")})
    out = [(F.try_divide(V(f"s{i}"), V(f"n{i}"))).alias(f"mean{i}") for i in (1, 2)] + [F.try_divide(V(f"q{i}") - F.try_divide(V(f"s{i}") * V(f"s{i}"), V(f"n{i}")), V(f"n{i}") - 1).alias(f"var{i}") for i in (1, 2)]
    return s.select("feature_id", "label", "n1", "n2", *out)


def ovr_lfc(moments: DataFrame) -> DataFrame:
    return moments.select("feature_id", "label", (F.log2(V("mean1") + 1) - F.log2(V("mean2") + 1)).alias("lfc"))


def ovr_welch_t(moments: DataFrame) -> DataFrame:
    a, b = V("var1") / V("n1"), V("var2") / V("n2")
    t = F.try_divide(V("mean1") - V("mean2"), F.sqrt(F.greatest(a + b, F.lit(0.0))))
    df = F.try_divide((a + b) * (a + b), a * a / (V("n1") - 1) + b * b / (V("n2") - 1))
    return moments.select("feature_id", "label", t.alias("t"), df.alias("df"))


def contrast_summary(moments: DataFrame, least_t: float = 2.0) -> DataFrame:
    """Per class: features up, down and neither, by the size of Welch's t."""
    t = ovr_welch_t(moments)
    return t.groupBy("label").agg(F.count_if(V("t") >= least_t).alias("up"), F.count_if(V("t") <= -least_t).alias("down"), F.count_if(F.coalesce(F.abs("t") < least_t, F.lit(True))).alias("neither"))


def pairwise_wilcoxon(df: DataFrame, value: str, group: str) -> DataFrame:
    """(a, b, u): rank-sum statistic of a against b for each pair of groups."""
    groups = df.select(group).distinct()
    pairs = groups.select(V(group).alias("a")).join(groups.select(V(group).alias("b")), V("a") < V("b"))
    both = df.join(F.broadcast(pairs), (V(group) == V("a")) | (V(group) == V("b")))
    ranked = both.withColumn("_r", average_rank(V(value), "a", "b")).where(V(group) == V("a"))
    return ranked.groupBy("a", "b").agg((F.sum("_r") - F.count("*") * (F.count("*") + 1) / 2).alias("u"))


def adjust(df: DataFrame, p: str, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Columns bh, bonferroni and holm; rows of equal p are ordered by ``key``, rows without p have none and do not count.

    Rows are ordered in range parts, which carry the least and the largest value to each other.
    """
    rows = ordered(df.where(V(p).isNotNull()), [p, key], by)
    rows = rows.withColumns({"_bh": V(p) * V("_rows") / V("_nth"), "_holm": V(p) * (V("_rows") - V("_nth") + 1)})
    parts = rows.groupBy(*by, "_part").agg(F.min("_bh").alias("_low"), F.max("_holm").alias("_high"))
    parts = parts.select(*by, "_part", carried(F.min("_low"), by, later=True).alias("_later"), carried(F.max("_high"), by).alias("_earlier"))
    # Spark computes a frame that ends at the last row anew for each row, so both frames begin at the first.
    rest, done = (Window.partitionBy(*by, "_part").orderBy(o).rowsBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.desc("_nth"), F.asc("_nth")))
    out = same(rows, parts, [*by, "_part"]).withColumns({"bh": F.least(F.min("_bh").over(rest), "_later", F.lit(1.0)), "bonferroni": F.least(V(p) * V("_rows"), F.lit(1.0)), "holm": F.least(F.greatest(F.max("_holm").over(done), "_earlier"), F.lit(1.0))})
    return out.select(*df.columns, "bh", "bonferroni", "holm").unionByName(df.where(V(p).isNull()), allowMissingColumns=True)


def ovr_welch_p(moments: DataFrame) -> DataFrame:
    """(feature_id, label, t, df, p, log10_p, bh, bonferroni, holm): Welch's test of each class against the rest, adjusted over the features of a class.

    A feature without spread in either group has no t and no p.
    """
    t = ovr_welch_t(moments).withColumns(with_p(ln_t_two_sided(V("t"), V("df"))))
    return adjust(t, "p", "feature_id", ["label"])


def lfc_filter(df: DataFrame, effect: str, key: str, least: float, test: Column, n: int = 2000) -> DataFrame:
    return df.where((F.abs(effect) >= least) & test).orderBy(F.desc(F.abs(effect)), key).limit(n)


def friedman(results: DataFrame, block: str, treatment: str, value: str) -> DataFrame:
    """(n_blocks, k, chi2, f): Friedman's statistic of treatments over blocks, and its F form."""
    r = results.withColumn("_r", average_rank(V(value), block))
    sums = r.groupBy(treatment).agg(F.sum("_r").alias("_s"), F.count("*").alias("_j"))
    out = sums.agg(F.count("*").alias("k"), F.max("_j").alias("n_blocks"), F.sum(V("_s") * V("_s")).alias("_q"))
    out = out.withColumn("chi2", 12 / (V("n_blocks") * V("k") * (V("k") + 1)) * V("_q") - 3 * V("n_blocks") * (V("k") + 1))
    return out.select("n_blocks", "k", "chi2", F.try_divide((V("n_blocks") - 1) * V("chi2"), V("n_blocks") * (V("k") - 1) - V("chi2")).alias("f"))


def friedman_p(test: DataFrame) -> DataFrame:
    """``friedman`` with p of the chi-square form and p_f, log10_p_f of the F form; null where all blocks agree in every rank."""
    one = with_p(ln_chi2_upper(V("chi2"), V("k") - 1.0))
    two = with_p(ln_f_upper(V("f"), V("k") - 1.0, (V("k") - 1.0) * (V("n_blocks") - 1.0)))
    return test.withColumns({**one, "p_f": two["p"], "log10_p_f": two["log10_p"]})


def kruskal(df: DataFrame, value: str, group: str) -> DataFrame:
    """(h, df, p, log10_p): Kruskal-Wallis with tie correction."""
    ranks = value_ranks(df, value)
    ties = ranks.agg(F.sum(V("n") * (V("n") * V("n") - 1)).alias("_ties"), F.sum("n").alias("_n"))
    cells = df.where(V(value).isNotNull()).groupBy(group, V(value).cast("double").alias("value")).agg(F.count("*").alias("_k"))
    r = cells.join(ranks, "value").select(group, (V("rank") * V("_k")).alias("_r"), "_k")
    sums = r.groupBy(group).agg((F.sum("_r") * F.sum("_r") / F.sum("_k")).alias("_q")).agg(F.sum("_q").alias("_q"), F.count("*").alias("_k"))
    n = V("_n")
    out = sums.crossJoin(ties).select(F.try_divide(12 / (n * (n + 1)) * V("_q") - 3 * (n + 1), 1 - V("_ties") / (n * n * n - n)).alias("h"), (V("_k") - 1).alias("df"))
    return out.withColumns(with_p(ln_chi2_upper(V("h"), V("df").cast("double"))))


def chi_square(df: DataFrame, group: str, member: str, family: str) -> DataFrame:
    """(family, chi2, df, p, log10_p) of group by membership; a family with one group or one membership has no p."""
    n = df.groupBy(family, group, member).agg(F.count("*").alias("_o"))
    grid = n.select(family, group).distinct().join(n.select(family, member).distinct(), family).join(n, [family, group, member], "left").fillna(0, ["_o"])
    s = lambda *by: F.sum("_o").over(Window.partitionBy(family, *by))
    e = s(group) * s(member) / s()
    free = (F.count_distinct(group) - 1) * (F.count_distinct(member) - 1)
    out = grid.withColumn("_e", e).groupBy(family).agg(F.sum((V("_o") - V("_e")) * (V("_o") - V("_e")) / V("_e")).alias("chi2"), free.alias("df"))
    return out.withColumns(with_p(F.when(V("df") > 0, ln_chi2_upper(V("chi2"), V("df").cast("double")))))


def correlations(df: DataFrame, a: str, b: str) -> DataFrame:
    """(pearson, spearman) of two columns."""
    r = df.where(V(a).isNotNull() & V(b).isNotNull()).groupBy(V(a).cast("double").alias("_a"), V(b).cast("double").alias("_b")).agg(F.count("*").alias("_k"))
    rows = r.withColumn("_i", F.explode(F.array_repeat(F.lit(1), V("_k").cast("int"))))
    for c in ("_a", "_b"):
        ranks = value_ranks(rows, c)
        rows = lookup(rows, ranks.select(V("value").alias(c), V("rank").alias(f"_r{c}"), V("n").alias("_n")), [c], "_n")
    r = rows.withColumnsRenamed({"_r_a": "_ra", "_r_b": "_rb"})
    return r.agg(F.corr("_a", "_b").alias("pearson"), F.corr("_ra", "_rb").alias("spearman"))


def central(pairs: DataFrame, value: str = "rho") -> DataFrame:
    """Median association of every feature with the others."""
    both = pairs.select(V("x").alias("feature_id"), value).union(pairs.select("y", value))
    return both.groupBy("feature_id").agg(F.median(value).alias("median"))


def enrichment(ranked: DataFrame, sets: DataFrame, score: str = "score") -> tuple[DataFrame, DataFrame]:
    """((set_name, es, peak), leading edge (set_name, feature_id)): largest deviation of the running sum over features by falling score.

    Hits step by their share of the members' absolute scores, misses by an equal share.
    """
    grid = ranked.crossJoin(sets.select("set_name").distinct()).join(sets.withColumn("_in", F.lit(1)), ["set_name", "feature_id"], "left")
    w = Window.partitionBy("set_name")
    grid = grid.withColumns({"_h": F.when(V("_in") == 1, F.abs(score)).otherwise(0.0), "_m": F.when(V("_in") == 1, 0.0).otherwise(1.0), "_pos": F.row_number().over(w.orderBy(F.desc(score), "feature_id"))})
    o = w.orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    walk = F.coalesce(F.try_divide(F.sum("_h").over(o), F.sum("_h").over(w)), F.lit(0.0)) - F.coalesce(F.try_divide(F.sum("_m").over(o), F.sum("_m").over(w)), F.lit(0.0))
    grid = grid.withColumn("_walk", F.round(walk, 9))
    top = grid.groupBy("set_name").agg(F.max("_walk").alias("_hi"), F.min("_walk").alias("_lo"))
    top = top.withColumn("es", F.when(V("_hi") >= -V("_lo"), V("_hi")).otherwise(V("_lo")))
    at = grid.join(top.select("set_name", "es"), "set_name").where("_walk = es").groupBy("set_name").agg(F.first("es").alias("es"), F.min("_pos").alias("peak"))
    edge = grid.where("_in = 1").join(at, "set_name").where(F.when(V("es") >= 0, V("_pos") <= V("peak")).otherwise(V("_pos") > V("peak")))
    return at, edge.select("set_name", "feature_id")


def permutation_p(ranked: DataFrame, sets: DataFrame, rounds: int = 100, seed: int = 0) -> DataFrame:
    """(set_name, p): share of random sets of equal size whose enrichment score is as extreme.

    A round's random set are the features that come first by md5 of seed, round, set and feature, so every set and round
    is a window of its own, as large as the number of features.
    """
    seen = enrichment(ranked, sets)[0].select("set_name", F.abs("es").alias("_seen"))
    sizes = sets.join(ranked.select("feature_id"), "feature_id", "left_semi").groupBy("set_name").agg(F.count_distinct("feature_id").alias("_size"))
    grid = sizes.withColumn("_round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).join(ranked.select("feature_id", "score"))
    w = Window.partitionBy("set_name", "_round")
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), "_round", "set_name", "feature_id"))
    grid = grid.withColumn("_in", F.row_number().over(w.orderBy(draw, "feature_id")) <= V("_size"))
    grid = grid.withColumns({"_h": F.when(V("_in"), F.abs("score")).otherwise(0.0), "_m": F.when(V("_in"), 0.0).otherwise(1.0)})
    o = w.orderBy(F.desc("score"), "feature_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    walk = F.coalesce(F.try_divide(F.sum("_h").over(o), F.sum("_h").over(w)), F.lit(0.0)) - F.coalesce(F.try_divide(F.sum("_m").over(o), F.sum("_m").over(w)), F.lit(0.0))
    drawn = grid.withColumn("_walk", F.round(walk, 9)).groupBy("set_name", "_round").agg(F.max(F.abs("_walk")).alias("_es"))
    return drawn.join(seen, "set_name").groupBy("set_name").agg(((1 + F.count_if(V("_es") >= V("_seen"))) / (F.count("*") + 1)).alias("p"))


def over_representation(chosen: DataFrame, universe: DataFrame, sets: DataFrame) -> DataFrame:
    """(set_name, hits, drawn, good, total) of chosen features in sets, within a universe."""
    inside = sets.join(universe.select("feature_id"), "feature_id", "left_semi")
    hits = inside.join(chosen.select("feature_id").distinct().withColumn("_c", F.lit(1)), "feature_id", "left")
    sizes = universe.agg(F.count("*").alias("total")).crossJoin(chosen.join(universe.select("feature_id"), "feature_id", "left_semi").agg(F.count("*").alias("drawn")))
    return hits.groupBy("set_name").agg(F.count("_c").alias("hits"), F.count("*").alias("good")).crossJoin(F.broadcast(sizes)).select("set_name", "hits", "drawn", "good", "total")


def set_mean_diff(t: DataFrame, sets: DataFrame) -> DataFrame:
    """(label, set_name, mean_t): mean Welch t of a set's features per class."""
    return t.join(sets, "feature_id").groupBy("label", "set_name").agg(F.avg("t").alias("mean_t"))
