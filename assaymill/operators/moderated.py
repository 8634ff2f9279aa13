"""Tests with moderated variances: every feature's variance is shrunken towards what all features have, and a least effect can be asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaymill.functions.ordering import same
from assaymill.functions.tails import digamma, inverse_trigamma, ln_t_two_sided, trigamma, with_p
from assaymill.operators.statistics import adjust

V = F.col


def pooled(moments: DataFrame) -> DataFrame:
    """(feature_id, label, diff, n1, n2, variance, df) of ``statistics.class_moments``: mean of the class less that of the rest, and the pooled variance within both."""
    df = V("n1") + V("n2") - 2
    within = (V("n1") - 1) * F.coalesce("var1", F.lit(0.0)) + (V("n2") - 1) * F.coalesce("var2", F.lit(0.0))
    out = moments.select("feature_id", "label", (V("mean1") - V("mean2")).alias("diff"), "n1", "n2", F.try_divide(within, df).alias("variance"), df.cast("double").alias("df"))
    return out.where("df > 0 AND n1 > 0 AND n2 > 0")


def variance_prior(tests: DataFrame) -> DataFrame:
    """(label, prior_df, prior_variance) of the scaled inverse chi-square from which the features' variances seem drawn, by the mean and spread of their logarithms.

    Where the logarithms spread no more than chance allows, ``prior_df`` is infinite. Features without variance do not count.
    """
    e = F.ln("variance") - digamma(V("df") / 2) + F.ln(V("df") / 2)
    s = tests.where("variance > 0").withColumns({"_e": e, "_tri": trigamma(V("df") / 2)}).groupBy("label")
    s = s.agg(F.avg("_e").alias("_mean"), (F.coalesce(F.var_samp("_e"), F.lit(0.0)) - F.avg("_tri")).alias("_spread"))
    half = inverse_trigamma(V("_spread"))
    s = s.withColumn("_half", F.when(V("_spread") > 1e-12, half))
    return s.select("label", F.coalesce(2 * V("_half"), F.lit(float("inf"))).alias("prior_df"), F.when(V("_half").isNull(), F.exp("_mean")).otherwise(F.exp(V("_mean") + digamma(V("_half")) - F.ln("_half"))).alias("prior_variance"))


def moderated_t(moments: DataFrame, least: float = 0.0) -> DataFrame:
    """(feature_id, label, diff, t, df, p, log10_p, bh, bonferroni, holm): each class against the rest with shrunken variances.

    With ``least`` the hypothesis is a difference of at most so much: t is measured from there (0 within it), and p is the mean of both ends' tails.
    The degrees of freedom are the prior's and the feature's, at most those of all features together.
    """
    tests = pooled(moments)
    tests = same(same(tests, variance_prior(tests), ["label"]), tests.groupBy("label").agg(F.sum("df").alias("_all")), ["label"])
    endless = V("prior_df") == float("inf")
    variance = F.when(endless, V("prior_variance")).otherwise((V("prior_df") * V("prior_variance") + V("df") * V("variance")) / (V("prior_df") + V("df")))
    out = tests.withColumns({"_se": F.sqrt(variance * (1 / V("n1") + 1 / V("n2"))), "df": F.least(V("prior_df") + V("df"), V("_all"))})
    if not least:
        ln_p = ln_t_two_sided(V("t"), V("df"))
        out = out.withColumn("t", F.try_divide("diff", "_se")).withColumns(with_p(ln_p))
    else:
        near, far = F.try_divide(F.abs("diff") - least, V("_se")), F.try_divide(F.abs("diff") + least, V("_se"))
        upper = lambda t: F.when(t >= 0, F.exp(ln_t_two_sided(t, V("df"))) / 2).otherwise(1 - F.exp(ln_t_two_sided(t, V("df"))) / 2)
        out = out.withColumns({"t": F.signum("diff") * F.greatest(near, F.lit(0.0)), "_near": near, "_far": far}).withColumn("p", upper(V("_near")) + upper(V("_far")))
        out = out.withColumn("log10_p", F.log10("p"))
    return adjust(out.select("feature_id", "label", "diff", "t", "df", "p", "log10_p"), "p", "feature_id", ["label"])


def decisions(tests: DataFrame, level: float = 0.05) -> DataFrame:
    """(label, up, down, neither): features of each class by the sign of t where the adjusted p is at most ``level``."""
    hit = F.coalesce(V("bh") <= level, F.lit(False))
    return tests.groupBy("label").agg(F.count_if(hit & (V("t") > 0)).alias("up"), F.count_if(hit & (V("t") < 0)).alias("down"), F.count_if(~(hit & (V("t") != 0))).alias("neither"))


def top_tags(tests: DataFrame, n: int) -> DataFrame:
    """The n features of least p in each class, with their place."""
    from assaymill.functions.ordering import ordered

    return ordered(tests.where("p IS NOT NULL"), ["p", "feature_id"], ["label"]).where(V("_nth") <= n).select(*tests.columns, V("_nth").cast("int").alias("rank"))
