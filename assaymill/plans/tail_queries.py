"""Queries of tests with their tail probabilities. The SQL sums or integrates, where the library evaluates continued fractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaymill.operators import moderated as md
from assaymill.operators import statistics as st
from assaymill.plans.fixtures import Fixtures
from assaymill.plans.model_queries import MOMENTS, WELCH, _moments
from assaymill.plans.registry import query, r

V = F.col


def beta_sql(x: str, y: str, a: str, b: str) -> str:
    """ln of the incomplete beta function, from its power series of positive terms on the side that converges fast."""

    def part(x: str, y: str, a: str, b: str) -> str:
        term = f"exp(lgamma({a} + {b} + n) - lgamma({a} + {b}) - lgamma({a} + 1 + n) + lgamma({a} + 1) + n * ln({x}))"
        return f"({a} * ln({x}) + {b} * ln({y}) + lgamma({a} + {b}) - lgamma({a} + 1) - lgamma({b}) + ln(list_sum(list_transform(range((60 + 45 * ({a} + {b} + 2) / ({b} + 1))::BIGINT), lambda n: {term}))))"

    return f"CASE WHEN {x} * ({a} + {b} + 2) < {a} + 1 THEN {part(x, y, a, b)} ELSE ln(1 - exp({part(y, x, b, a)})) END"


def t_sql(t: str, df: str) -> str:
    return beta_sql(f"({df} / ({df} + {t} * {t}))", f"({t} * {t} / ({df} + {t} * {t}))", f"({df} / 2)", "0.5::DOUBLE")


def f_sql(f: str, d1: str, d2: str) -> str:
    return beta_sql(f"({d2} / ({d2} + {d1} * {f}))", f"({d1} * {f} / ({d2} + {d1} * {f}))", f"({d2} / 2)", f"({d1} / 2)")


def chi2_sql(x: str, df: str) -> str:
    """ln of the upper tail: Simpson's rule over the density beyond x, in units of the density there."""
    inner = f"list_sum(list_transform(range(20001), lambda i: (CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(({df} / 2 - 1) * ln(1 + i * 0.006 / ({x} / 2)) - i * 0.006))) * 0.002"
    return f"(({df} / 2 - 1) * ln({x} / 2) - {x} / 2 - lgamma({df} / 2) + ln({inner}))"


def adjusted_sql(table: str, key: str, by: str = "") -> str:
    """CTEs adj (with k and n) and fin (with bh, bonferroni, holm) of a table with p."""
    part = f"PARTITION BY {by}" if by else ""
    return (
        f"adj AS (SELECT *, row_number() OVER ({part} ORDER BY p, {key}) AS k, count(*) OVER ({part}) AS n FROM {table} WHERE p IS NOT NULL), "
        f"fin AS (SELECT *, least(min(p * n / k) OVER ({part} ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1) AS bh, least(p * n, 1) AS bonferroni, least(max(p * (n - k + 1)) OVER ({part} ORDER BY k), 1) AS holm FROM adj UNION ALL BY NAME SELECT * FROM {table} WHERE p IS NULL)"
    )


TESTS = f"lnp AS (SELECT *, {t_sql('t', 'df')} AS l FROM wel), tst AS (SELECT feature_id, label, t, df, exp(l) AS p, l / ln(10) AS log10_p FROM lnp)"


@query(f"SELECT feature_id, label, {r('t')} AS t, {r('df')} AS df, {r('p')} AS p, {r('log10_p')} AS log10_p, {r('bh')} AS bh, {r('bonferroni')} AS bonferroni, {r('holm')} AS holm FROM fin", MOMENTS, WELCH, TESTS, adjusted_sql("tst", "feature_id", "label"))
def ovr_welch_p(fx: Fixtures) -> DataFrame:
    return st.ovr_welch_p(_moments(fx))


FRIEDMAN = "fri AS (SELECT max(j)::DOUBLE AS n_blocks, count(*)::DOUBLE AS k, 12.0 / (max(j) * count(*) * (count(*) + 1)) * sum(s * s) - 3 * max(j) * (count(*) + 1) AS chi2 FROM (SELECT c_nationkey, sum(k)::DOUBLE AS s, count(*) AS j FROM (SELECT *, rank() OVER (PARTITION BY c_mktsegment ORDER BY value) + (count(*) OVER (PARTITION BY c_mktsegment, value) - 1) / 2.0 AS k FROM (SELECT c_mktsegment, c_nationkey, avg(c_acctbal) AS value FROM customer GROUP BY 1, 2 QUALIFY count(*) OVER (PARTITION BY c_nationkey) = 5)) GROUP BY 1)), frf AS (SELECT *, (n_blocks - 1) * chi2 / (n_blocks * (k - 1) - chi2) AS f FROM fri)"


@query(f"SELECT n_blocks::BIGINT AS n_blocks, k::BIGINT AS k, {r('chi2')} AS chi2, {r('f')} AS f, {r('exp(lc)')} AS p, {r('lc / ln(10)')} AS log10_p, {r('exp(lf)')} AS p_f, {r('lf / ln(10)')} AS log10_p_f FROM (SELECT *, {chi2_sql('chi2', '(k - 1)')} AS lc, {f_sql('f', '(k - 1)', '((k - 1) * (n_blocks - 1))')} AS lf FROM frf)", FRIEDMAN)
def friedman_p(fx: Fixtures) -> DataFrame:
    """Nations that have customers in all five segments, compared over the segments by mean balance."""
    means = fx.read("customer").groupBy("c_mktsegment", "c_nationkey").agg(F.avg("c_acctbal").alias("value"))
    full = means.groupBy("c_nationkey").agg(F.count("*").alias("_n")).where("_n = 5").select("c_nationkey")
    return st.friedman_p(st.friedman(means.join(full, "c_nationkey"), "c_mktsegment", "c_nationkey", "value"))


@query(f"SELECT {r('h')} AS h, df, {r('exp(l)')} AS p, {r('l / ln(10)')} AS log10_p FROM (SELECT *, {chi2_sql('h', 'df::DOUBLE')} AS l FROM (SELECT (12.0 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS h, g - 1 AS df FROM (SELECT sum(s * s / c) AS q, count(*) AS g, sum(c)::DOUBLE AS n, sum(ties)::DOUBLE AS ties FROM (SELECT c_mktsegment, sum(k)::DOUBLE AS s, count(*) AS c, sum(t * t - 1) AS ties FROM (SELECT *, rank() OVER (ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_nationkey) - 1) / 2.0 AS k, count(*) OVER (PARTITION BY c_nationkey) AS t FROM customer) GROUP BY 1))))")
def kruskal_p(fx: Fixtures) -> DataFrame:
    return st.kruskal(fx.read("customer"), "c_nationkey", "c_mktsegment")


CHISQ = f"chs AS (SELECT p_type, sum((o - e) ** 2 / e) AS chi2, (count(DISTINCT p_brand) - 1) * (count(DISTINCT m) - 1) AS df FROM (SELECT p_type, p_brand, m, o, sum(o) OVER (PARTITION BY p_type, p_brand) * sum(o) OVER (PARTITION BY p_type, m) / sum(o) OVER (PARTITION BY p_type) AS e FROM (SELECT g.p_type, g.p_brand, m.m, count(p_partkey)::DOUBLE AS o FROM (SELECT DISTINCT p_type, p_brand FROM part) g JOIN (SELECT DISTINCT p_type, p_size > 25 AS m FROM part) m USING (p_type) LEFT JOIN part p ON p.p_type = g.p_type AND p.p_brand = g.p_brand AND (p.p_size > 25) = m.m GROUP BY 1, 2, 3)) GROUP BY 1), chp AS (SELECT p_type, chi2, df, exp(l) AS p, l / ln(10) AS log10_p FROM (SELECT *, CASE WHEN df > 0 THEN {chi2_sql('chi2', 'df::DOUBLE')} END AS l FROM chs))"


@query(f"SELECT p_type, {r('chi2')} AS chi2, df, {r('p')} AS p, {r('log10_p')} AS log10_p, {r('bh')} AS bh, {r('bonferroni')} AS bonferroni, {r('holm')} AS holm FROM fin", CHISQ, adjusted_sql("chp", "p_type"))
def chisq_p(fx: Fixtures) -> DataFrame:
    return st.adjust(st.chi_square(fx.read("part").withColumn("m", V("p_size") > 25), "p_brand", "m", "p_type"), "p", "p_type")


# moderated tests -------------------------------------------------------------------------------


def _digamma_sql(x: str) -> str:
    y = f"({x} + 30)"
    return f"(ln({y}) - 1 / (2 * {y}) - 1 / (12 * {y} ** 2) + 1 / (120 * {y} ** 4) - list_sum(list_transform(range(30), lambda i: 1 / ({x} + i))))"


def _trigamma_sql(x: str) -> str:
    y = f"({x} + 30)"
    return f"(1 / {y} + 1 / (2 * {y} ** 2) + 1 / (6 * {y} ** 3) - 1 / (30 * {y} ** 5) + list_sum(list_transform(range(30), lambda i: 1 / ({x} + i) ** 2)))"


#: The inverse is found by halving an interval of logarithms, eighty times.
MODERATED = f"""pol AS (SELECT feature_id, label, m1 - m2 AS diff, n1, n2, n1 + n2 - 2 AS df, ((n1 - 1) * coalesce(v1, 0) + (n2 - 1) * coalesce(v2, 0)) / (n1 + n2 - 2) AS s2 FROM mom),
pri AS (SELECT label, avg(e) AS m, coalesce(var_samp(e), 0) - avg(tri) AS spread FROM (SELECT label, ln(s2) - {_digamma_sql('(df / 2)')} + ln(df / 2) AS e, {_trigamma_sql('(df / 2)')} AS tri FROM pol WHERE s2 > 0) GROUP BY 1),
hlf AS (SELECT label, m, CASE WHEN spread > 1e-12 THEN exp((b[1] + b[2]) / 2) END AS h FROM (SELECT *, list_reduce(list_concat([[-20.0, 30.0]], list_transform(range(80), lambda i: [i::DOUBLE])), lambda b, i: CASE WHEN {_trigamma_sql('exp((b[1] + b[2]) / 2)')} > spread THEN [(b[1] + b[2]) / 2, b[2]] ELSE [b[1], (b[1] + b[2]) / 2] END) AS b FROM pri)),
prd AS (SELECT label, CASE WHEN h IS NULL THEN 'inf'::DOUBLE ELSE 2 * h END AS d0, CASE WHEN h IS NULL THEN exp(m) ELSE exp(m + {_digamma_sql('h')} - ln(h)) END AS s0 FROM hlf),
shr AS (SELECT feature_id, label, diff, sqrt(CASE WHEN isinf(d0) THEN s0 ELSE (d0 * s0 + df * s2) / (d0 + df) END * (1 / n1 + 1 / n2)) AS se, least(d0 + df, sum(df) OVER (PARTITION BY label)) AS df FROM pol JOIN prd USING (label))"""
MOD = f"tst AS (SELECT feature_id, label, diff, t, df, exp(l) AS p, l / ln(10) AS log10_p FROM (SELECT *, {t_sql('t', 'df')} AS l FROM (SELECT *, diff / se AS t FROM shr)))"
TREAT = f"tst AS (SELECT feature_id, label, diff, sign(diff) * greatest(a, 0) AS t, df, p, log10(p) AS log10_p FROM (SELECT *, CASE WHEN a >= 0 THEN exp({t_sql('a', 'df')}) / 2 ELSE 1 - exp({t_sql('a', 'df')}) / 2 END + exp({t_sql('b', 'df')}) / 2 AS p FROM (SELECT *, (abs(diff) - 0.05) / se AS a, (abs(diff) + 0.05) / se AS b FROM shr)))"
_OUT = f"SELECT feature_id, label, {r('diff')} AS diff, {r('t')} AS t, {r('df')} AS df, {r('p')} AS p, {r('log10_p')} AS log10_p, {r('bh')} AS bh, {r('bonferroni')} AS bonferroni, {r('holm')} AS holm FROM fin"
_LOGGED = MOMENTS.replace("FROM dense d JOIN obs", "FROM (SELECT sample_id, feature_id, ln(value + 1) AS value FROM dense) d JOIN obs")


def _log_moments(fx: Fixtures) -> DataFrame:
    return st.class_moments(fx.cells.withColumn("value", F.log1p("value")), fx.obs, "label")


@query(_OUT, _LOGGED, MODERATED, MOD, adjusted_sql("tst", "feature_id", "label"))
def moderated_t(fx: Fixtures) -> DataFrame:
    return md.moderated_t(_log_moments(fx))


@query(_OUT, _LOGGED, MODERATED, TREAT, adjusted_sql("tst", "feature_id", "label"))
def treat_test(fx: Fixtures) -> DataFrame:
    """A difference of more than 0.05 in mean log counts."""
    return md.moderated_t(_log_moments(fx), 0.05)


@query(f"SELECT label, d0 AS prior_df, {r('s0')} AS prior_variance FROM (SELECT label, {r('d0')} AS d0, s0 FROM prd)", _LOGGED, MODERATED)
def variance_prior(fx: Fixtures) -> DataFrame:
    return md.variance_prior(md.pooled(_log_moments(fx)))


@query("SELECT label, count(*) FILTER (WHERE bh <= 0.5 AND t > 0) AS up, count(*) FILTER (WHERE bh <= 0.5 AND t < 0) AS down, count(*) FILTER (WHERE NOT coalesce(bh <= 0.5 AND t <> 0, false)) AS neither FROM fin GROUP BY 1", _LOGGED, MODERATED, MOD, adjusted_sql("tst", "feature_id", "label"))
def decide_tests(fx: Fixtures) -> DataFrame:
    return md.decisions(md.moderated_t(_log_moments(fx)), 0.5)


@query(f"SELECT feature_id, label, {r('t')} AS t, {r('p')} AS p, k::INT AS rank FROM adj WHERE k <= 5", _LOGGED, MODERATED, MOD, adjusted_sql("tst", "feature_id", "label"))
def top_tags(fx: Fixtures) -> DataFrame:
    return md.top_tags(md.moderated_t(_log_moments(fx)), 5).select("feature_id", "label", "t", "p", "rank")
