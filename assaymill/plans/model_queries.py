"""Queries of hierarchies, tests, selection, sampling, evaluation and models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaymill.operators import evaluation as ev
from assaymill.operators import gram as gr
from assaymill.operators import hierarchy as hi
from assaymill.operators import models as mo
from assaymill.operators import negbin as nb
from assaymill.operators import normalise as nm
from assaymill.operators import sampling as sp
from assaymill.operators import selection as se
from assaymill.operators import statistics as st
from assaymill.plans.fixtures import SEGMENTS, Fixtures
from assaymill.plans.registry import query, r

V = F.col

# hierarchies -----------------------------------------------------------------------------------


@query("SELECT sample_id, set_name, sum(value) AS value FROM cells JOIN sets USING (feature_id) GROUP BY 1, 2")
def recode_sum(fx: Fixtures) -> DataFrame:
    return hi.recode(fx.cells, fx.sets)


@query(f"SELECT sample_id, set_name, {r('sum(value) / any_value(k)')} AS value FROM cells JOIN sets USING (feature_id) JOIN (SELECT set_name, count(*) AS k FROM sets GROUP BY 1) USING (set_name) GROUP BY 1, 2")
def recode_mean(fx: Fixtures) -> DataFrame:
    return hi.recode(fx.cells, fx.sets, "mean")


@query("SELECT p_brand, p_type, code, rating::INT AS rating FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY rating, code) AS i FROM (SELECT p_brand, p_type, 'E' || p_size % 5 AS code, CASE p_size % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 4 END AS rating FROM part)) WHERE i = 1")
def best_evidence(fx: Fixtures) -> DataFrame:
    df = fx.read("part").select("p_brand", "p_type", F.concat(F.lit("E"), (V("p_size") % 5).cast("string")).alias("code"))
    return hi.best_evidence(df, "p_brand", "p_type", "code", {"E0": 2, "E1": 1, "E2": 3})


DAG = "clo AS (SELECT parent AS ancestor, child AS descendant, 1 AS depth FROM edges UNION SELECT c.ancestor, e.child, c.depth + 1 FROM clo c JOIN edges e ON e.parent = c.descendant), lev AS (SELECT 'all' AS term, 0 AS level UNION ALL SELECT descendant, min(depth) FROM clo WHERE ancestor = 'all' GROUP BY 1)"


@query("SELECT term, level FROM lev", DAG)
def dag_levels(fx: Fixtures) -> DataFrame:
    return hi.levels(fx.edges)


@query("SELECT ancestor, descendant, min(depth) AS depth FROM clo GROUP BY 1, 2", DAG)
def dag_descendants(fx: Fixtures) -> DataFrame:
    return hi.closure(fx.edges)


@query("SELECT parent AS term, count(*) AS n_children FROM edges GROUP BY 1")
def dag_n_children(fx: Fixtures) -> DataFrame:
    return hi.n_children(fx.edges)


@query("SELECT parent, child FROM edges WHERE child IN (SELECT ancestor FROM clo WHERE descendant IN ('NATION_1', 'NATION_2') UNION SELECT unnest(['NATION_1', 'NATION_2']))", DAG)
def dag_subset(fx: Fixtures) -> DataFrame:
    return hi.subset(fx.edges, fx.spark.sql("SELECT explode(array('NATION_1', 'NATION_2')) AS term"))


@query("SELECT count(*) = 0 AS acyclic FROM clo WHERE ancestor = descendant", DAG)
def dag_acyclic(fx: Fixtures) -> DataFrame:
    return hi.acyclic(fx.edges)


@query("SELECT feature_id AS sample_id, term, sum(value) AS value FROM (SELECT feature_id, nation, sum(value) AS value FROM cells JOIN obs USING (sample_id) GROUP BY 1, 2) JOIN (SELECT ancestor AS term, descendant AS member FROM clo UNION SELECT term, term FROM lev) ON member = nation JOIN lev USING (term) WHERE level <= 1 GROUP BY 1, 2", DAG)
def aggregate_to_level(fx: Fixtures) -> DataFrame:
    values = fx.cells.join(fx.obs, "sample_id").groupBy(V("feature_id").alias("sample_id"), V("nation").alias("term")).agg(F.sum("value").alias("value"))
    return hi.aggregate_to_level(values, fx.edges, 1)


@query("SELECT descendant AS term, ancestor AS top FROM clo JOIN lev ON term = ancestor WHERE level = 1", DAG)
def top_level_map(fx: Fixtures) -> DataFrame:
    return hi.top_level_map(fx.edges, 1)


@query("""SELECT label, coalesce(parent, 'unknown') AS parent, coalesce(n, 0) AS n FROM (SELECT DISTINCT label FROM obs) LEFT JOIN (
  SELECT label, parent, n FROM (SELECT label, CASE WHEN sample_id % 4 = 0 THEN 'x' ELSE 'y' END AS parent, count(*) AS n, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, CASE WHEN sample_id % 4 = 0 THEN 'x' ELSE 'y' END) AS i FROM obs WHERE sample_id % 4 <= 1 GROUP BY 1, 2) WHERE i = 1) USING (label)""")
def parent_vote(fx: Fixtures) -> DataFrame:
    items = fx.obs.groupBy("label").agg(F.array_join(F.collect_list((V("sample_id") % 4).cast("string")), ";").alias("terms"))
    parents = fx.spark.sql("SELECT '0' AS term, 'x' AS parent UNION ALL SELECT '1', 'y'")
    priority = fx.spark.sql("SELECT 'x' AS parent, 1 AS priority UNION ALL SELECT 'y', 2")
    return hi.parent_vote(items, "label", "terms", parents, priority)


@query("SELECT DISTINCT parent AS term FROM edges WHERE parent NOT IN (SELECT child FROM edges)")
def dag_roots(fx: Fixtures) -> DataFrame:
    return hi.roots(fx.edges)


@query("SELECT descendant AS term, 'all' AS root FROM clo WHERE ancestor = 'all'", DAG)
def root_family(fx: Fixtures) -> DataFrame:
    return hi.root_family(fx.edges)


@query(f"""SELECT sample_id, set_name, {r('greatest(max(w), 0) + least(min(w), 0)')} AS score FROM (
  SELECT sample_id, set_name, coalesce(sum(h) OVER o / nullif(sum(h) OVER q, 0), 0) - coalesce(sum(1 - i) OVER o / nullif(sum(1 - i) OVER q, 0), 0) AS w FROM (
    SELECT d.sample_id, s.set_name, d.feature_id, d.k, CASE WHEN t.feature_id IS NULL THEN 0 ELSE 1 END AS i, CASE WHEN t.feature_id IS NULL THEN 0.0 ELSE d.k END AS h
    FROM (SELECT *, rank() OVER (PARTITION BY sample_id ORDER BY value) + (count(*) OVER (PARTITION BY sample_id, value) - 1) / 2.0 AS k FROM dense) d CROSS JOIN (SELECT DISTINCT set_name FROM sets) s LEFT JOIN sets t ON t.set_name = s.set_name AND t.feature_id = d.feature_id)
  WINDOW q AS (PARTITION BY sample_id, set_name), o AS (PARTITION BY sample_id, set_name ORDER BY k DESC, feature_id ROWS UNBOUNDED PRECEDING)) GROUP BY 1, 2""")
def rank_set_score(fx: Fixtures) -> DataFrame:
    return hi.rank_set_score(fx.dense, fx.sets)


@query(f"SELECT sample_id, set_name, {r('avg(z)')} AS score FROM (SELECT *, coalesce((value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0), 0) AS z FROM dense WINDOW w AS (PARTITION BY feature_id)) JOIN sets USING (feature_id) GROUP BY 1, 2")
def mean_z_score(fx: Fixtures) -> DataFrame:
    return hi.mean_z_score(fx.dense, fx.sets)


@query("SELECT set_name, feature_id FROM (SELECT *, count(*) OVER (PARTITION BY set_name) AS n FROM (SELECT DISTINCT p_type || '-' || p_size AS set_name, p_brand AS feature_id FROM part WHERE p_size % 5 NOT IN (0, 1))) WHERE n BETWEEN 5 AND 20")
def build_gene_sets(fx: Fixtures) -> DataFrame:
    df = fx.read("part").select(F.concat_ws("-", "p_type", V("p_size").cast("string")).alias("set_name"), V("p_brand").alias("feature_id"), F.concat(F.lit("E"), (V("p_size") % 5).cast("string")).alias("code"))
    return hi.build_gene_sets(df, ["E0", "E1"], 5, 20)


@query("SELECT set_name, feature_id FROM (SELECT *, count(*) OVER (PARTITION BY set_name) AS n FROM sets) WHERE n BETWEEN 5 AND 1000")
def marker_sets(fx: Fixtures) -> DataFrame:
    return hi.build_gene_sets(fx.sets.withColumn("code", F.lit("x")), [], 5, 1000)


@query(f"SELECT sample_id, {r('score')} AS score, {r('1 / (1 + exp(-score))')} AS probability, CASE WHEN 1 / (1 + exp(-score)) >= 0.5 THEN 'basal-like' ELSE 'classical' END AS class FROM (SELECT sample_id, -0.5 + CASE WHEN a > b THEN 1.25 ELSE 0 END + CASE WHEN c > d THEN -0.75 ELSE 0 END AS score FROM (SELECT sample_id, max(CASE WHEN feature_id = 'Brand#1' THEN value END) AS a, max(CASE WHEN feature_id = 'Brand#2' THEN value END) AS b, max(CASE WHEN feature_id = 'Brand#3' THEN value END) AS c, max(CASE WHEN feature_id = 'Brand#4' THEN value END) AS d FROM dense WHERE sample_id IN (SELECT sample_id FROM cells) GROUP BY 1))")
def pair_classifier(fx: Fixtures) -> DataFrame:
    pairs = fx.spark.sql("SELECT 'Brand#1' AS a, 'Brand#2' AS b, 1.25D AS coef UNION ALL SELECT 'Brand#3', 'Brand#4', -0.75D")
    return hi.pair_classifier(fx.cells, pairs, -0.5, "basal-like", "classical")


# tests -----------------------------------------------------------------------------------------


AUROC = """auc AS (SELECT feature_id, label, a, (a - 0.5) / nullif(sqrt((n + 1 - ties / (n * (n - 1))) / (12 * p * (n - p))), 0) AS z FROM (
  SELECT feature_id, label, any_value(n)::DOUBLE AS n, count(*)::DOUBLE AS p, any_value(ties)::DOUBLE AS ties, (sum(k) - count(*) * (count(*) + 1) / 2) / (count(*) * (any_value(n) - count(*))) AS a FROM (
    SELECT *, sum(t * t - 1) OVER (PARTITION BY feature_id) AS ties FROM (SELECT *, rank() OVER (PARTITION BY feature_id ORDER BY value) + (count(*) OVER (PARTITION BY feature_id, value) - 1) / 2.0 AS k, count(*) OVER (PARTITION BY feature_id, value) AS t, count(*) OVER (PARTITION BY feature_id) AS n FROM dense JOIN obs USING (sample_id))) GROUP BY 1, 2))"""


@query(f"SELECT feature_id, label, {r('a')} AS auroc, {r('z')} AS z FROM auc", AUROC)
def auroc_ovr(fx: Fixtures) -> DataFrame:
    return st.auroc(fx.cells, fx.obs, "label", fx.var)


_FIT = reduce(lambda inner, c: f"({c} + t * {inner})", st.ERFC[-2::-1], str(st.ERFC[-1]))


@query(f"SELECT feature_id, label, {r('a')} AS auroc, {r('z')} AS z, {r(f't * exp({_FIT} - z * z / 2)')} AS p FROM (SELECT *, 1 / (1 + abs(z) / sqrt(2.0) / 2) AS t FROM auc WHERE z IS NOT NULL)", AUROC)
def auroc_ovr_p(fx: Fixtures) -> DataFrame:
    return st.auroc(fx.cells, fx.obs, "label", fx.var).where("z is not null").withColumn("p", st.two_sided_p(V("z")))


MOMENTS = "mom AS (SELECT c.feature_id, c.label, n1, n2, s1 / n1 AS m1, s2 / n2 AS m2, (q1 - s1 * s1 / n1) / nullif(n1 - 1, 0) AS v1, (q2 - s2 * s2 / n2) / nullif(n2 - 1, 0) AS v2 FROM (SELECT d.feature_id, o.label, sum(value) AS s1, sum(value * value) AS q1, count(*)::DOUBLE AS n1, sum(sum(value)) OVER w - sum(value) AS s2, sum(sum(value * value)) OVER w - sum(value * value) AS q2, (sum(count(*)) OVER w - count(*))::DOUBLE AS n2 FROM dense d JOIN obs o USING (sample_id) GROUP BY 1, 2 WINDOW w AS (PARTITION BY d.feature_id)) c WHERE s1 > 0)"
WELCH = "wel AS (SELECT feature_id, label, (m1 - m2) / nullif(sqrt(v1 / n1 + v2 / n2), 0) AS t, (v1 / n1 + v2 / n2) ** 2 / nullif((v1 / n1) ** 2 / nullif(n1 - 1, 0) + (v2 / n2) ** 2 / nullif(n2 - 1, 0), 0) AS df FROM mom)"


def _moments(fx: Fixtures) -> DataFrame:
    return st.class_moments(fx.cells, fx.obs, "label")


@query(f"SELECT feature_id, label, {r('log2(m1 + 1) - log2(m2 + 1)')} AS lfc FROM mom", MOMENTS)
def ovr_lfc(fx: Fixtures) -> DataFrame:
    return st.ovr_lfc(_moments(fx))


@query(f"SELECT feature_id, label, {r('t')} AS t, {r('df')} AS df FROM wel", MOMENTS, WELCH)
def ovr_welch_t(fx: Fixtures) -> DataFrame:
    return st.ovr_welch_t(_moments(fx))


@query("SELECT label, count(*) FILTER (WHERE t >= 1) AS up, count(*) FILTER (WHERE t <= -1) AS down, count(*) FILTER (WHERE coalesce(abs(t) < 1, true)) AS neither FROM wel GROUP BY 1", MOMENTS, WELCH)
def contrast_summary(fx: Fixtures) -> DataFrame:
    return st.contrast_summary(_moments(fx), 1.0)


@query(f"SELECT label, set_name, {r('avg(t)')} AS mean_t FROM wel JOIN sets USING (feature_id) GROUP BY 1, 2", MOMENTS, WELCH)
def set_mean_diff(fx: Fixtures) -> DataFrame:
    return st.set_mean_diff(st.ovr_welch_t(_moments(fx)), fx.sets)


@query(f"SELECT feature_id, {r('median(abs(log2(m1 + 1) - log2(m2 + 1)))')} AS score FROM mom GROUP BY 1", MOMENTS)
def median_abs_lfc(fx: Fixtures) -> DataFrame:
    return se.median_abs_lfc(st.ovr_lfc(_moments(fx)))


@query("SELECT a.c AS a, b.c AS b, (SELECT sum(CASE WHEN x.c_acctbal > y.c_acctbal THEN 1.0 WHEN x.c_acctbal = y.c_acctbal THEN 0.5 ELSE 0 END) FROM customer x JOIN customer y ON x.c_mktsegment = a.c AND y.c_mktsegment = b.c)::DOUBLE AS u FROM (SELECT DISTINCT c_mktsegment AS c FROM customer) a JOIN (SELECT DISTINCT c_mktsegment AS c FROM customer) b ON a.c < b.c")
def pairwise_wilcoxon(fx: Fixtures) -> DataFrame:
    return st.pairwise_wilcoxon(fx.read("customer"), "c_acctbal", "c_mktsegment")


PVALUES = "pv AS (SELECT p_partkey, (p_partkey * 7919 % 10007) / 100070.0::DOUBLE AS p FROM part), adj AS (SELECT *, row_number() OVER (ORDER BY p, p_partkey) AS k, count(*) OVER () AS n FROM pv)"


def _adjusted(fx: Fixtures) -> DataFrame:
    p = fx.read("part").select("p_partkey", ((V("p_partkey") * 7919 % 10007) / 100070.0).alias("p"))
    return st.adjust(p, "p", "p_partkey")


@query(f"SELECT p_partkey, {r('least(min(p * n / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1)')} AS bh FROM adj", PVALUES)
def adjust_bh(fx: Fixtures) -> DataFrame:
    return _adjusted(fx).select("p_partkey", "bh")


@query(f"SELECT p_partkey, {r('least(p * n, 1)')} AS bonferroni FROM adj", PVALUES)
def adjust_bonferroni(fx: Fixtures) -> DataFrame:
    return _adjusted(fx).select("p_partkey", "bonferroni")


@query(f"SELECT p_partkey, {r('least(max(p * (n - k + 1)) OVER (ORDER BY k), 1)')} AS holm FROM adj", PVALUES)
def adjust_holm(fx: Fixtures) -> DataFrame:
    return _adjusted(fx).select("p_partkey", "holm")


@query("SELECT p_partkey, p_size FROM part WHERE abs(p_size - 25) >= 10 AND p_retailprice < 1500 ORDER BY abs(p_size - 25) DESC, p_partkey LIMIT 50")
def lfc_filter(fx: Fixtures) -> DataFrame:
    return st.lfc_filter(fx.read("part").withColumn("e", V("p_size") - 25), "e", "p_partkey", 10, V("p_retailprice") < 1500, 50).select("p_partkey", "p_size")


@query(f"SELECT n_blocks, k, {r('chi2')} AS chi2, {r('(n_blocks - 1) * chi2 / nullif(n_blocks * (k - 1) - chi2, 0)')} AS f FROM (SELECT max(j) AS n_blocks, count(*) AS k, 12.0 / (max(j) * count(*) * (count(*) + 1)) * sum(s * s) - 3 * max(j) * (count(*) + 1) AS chi2 FROM (SELECT model, sum(k)::DOUBLE AS s, count(*) AS j FROM (SELECT *, rank() OVER (PARTITION BY fold ORDER BY value) + (count(*) OVER (PARTITION BY fold, value) - 1) / 2.0 AS k FROM results WHERE metric = 'accuracy') GROUP BY 1))")
def friedman_stat(fx: Fixtures) -> DataFrame:
    return st.friedman(fx.results.where("metric = 'accuracy'"), "fold", "model", "value")


@query(f"SELECT {r('(12.0 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n * n * n - n))')} AS h FROM (SELECT sum(s * s / c) AS q, sum(c)::DOUBLE AS n, sum(ties)::DOUBLE AS ties FROM (SELECT c_mktsegment, sum(k)::DOUBLE AS s, count(*) AS c, sum(t * t - 1) AS ties FROM (SELECT *, rank() OVER (ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_nationkey) - 1) / 2.0 AS k, count(*) OVER (PARTITION BY c_nationkey) AS t FROM customer) GROUP BY 1))")
def kruskal_stat(fx: Fixtures) -> DataFrame:
    return st.kruskal(fx.read("customer"), "c_nationkey", "c_mktsegment").select("h")


@query(f"SELECT p_type, {r('sum((o - e) ** 2 / e)')} AS chi2 FROM (SELECT p_type, o, sum(o) OVER (PARTITION BY p_type, p_brand) * sum(o) OVER (PARTITION BY p_type, m) / sum(o) OVER (PARTITION BY p_type) AS e FROM (SELECT g.p_type, g.p_brand, m.m, count(p_partkey)::DOUBLE AS o FROM (SELECT DISTINCT p_type, p_brand FROM part) g JOIN (SELECT DISTINCT p_type, p_size > 25 AS m FROM part) m USING (p_type) LEFT JOIN part p ON p.p_type = g.p_type AND p.p_brand = g.p_brand AND (p.p_size > 25) = m.m GROUP BY 1, 2, 3)) GROUP BY 1")
def chisq_family(fx: Fixtures) -> DataFrame:
    return st.chi_square(fx.read("part").withColumn("m", V("p_size") > 25), "p_brand", "m", "p_type").select("p_type", "chi2")


@query(f"SELECT {r('corr(p_size, p_retailprice)')} AS pearson FROM part")
def pearson(fx: Fixtures) -> DataFrame:
    return st.correlations(fx.read("part"), "p_size", "p_retailprice").select("pearson")


@query(f"SELECT {r('corr(a, b)')} AS spearman FROM (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS b FROM part)")
def spearman(fx: Fixtures) -> DataFrame:
    return st.correlations(fx.read("part"), "p_size", "p_retailprice").select("spearman")


LOGS = "logs AS (SELECT sample_id, feature_id, ln(value + 1) AS value FROM dense), prop AS (SELECT a.feature_id AS x, b.feature_id AS y, var_samp(a.value - b.value) / nullif(var_samp(a.value), 0) AS phi, 2 * covar_samp(a.value, b.value) / nullif(var_samp(a.value) + var_samp(b.value), 0) AS rho, 1 - corr(a.value, b.value) AS dist FROM logs a JOIN logs b ON a.sample_id = b.sample_id AND a.feature_id < b.feature_id GROUP BY 1, 2)"


def _proportions(fx: Fixtures) -> DataFrame:
    return gr.proportionality(fx.cells.withColumn("value", F.log1p("value")), fx.n, fx.var)


@query(f"SELECT x, y, {r('phi')} AS phi FROM prop", LOGS)
def phi_matrix(fx: Fixtures) -> DataFrame:
    return _proportions(fx).select("x", "y", "phi")


@query(f"SELECT x, y, {r('rho')} AS rho FROM prop", LOGS)
def rho_matrix(fx: Fixtures) -> DataFrame:
    return _proportions(fx).select("x", "y", "rho")


@query(f"SELECT feature_id, {r('median(rho)')} AS median FROM (SELECT x AS feature_id, rho FROM prop UNION ALL SELECT y, rho FROM prop) GROUP BY 1", LOGS)
def rho_central(fx: Fixtures) -> DataFrame:
    return st.central(_proportions(fx))


@query(f"SELECT x, y, {r('dist')} AS distance FROM prop", LOGS)
def feature_corr_distance(fx: Fixtures) -> DataFrame:
    return _proportions(fx).select("x", "y", (1 - V("corr")).alias("distance"))


ES = """walk AS (SELECT set_name, feature_id, i, pos, round(coalesce(sum(h) OVER o / nullif(sum(h) OVER q, 0), 0) - coalesce(sum(1 - i) OVER o / nullif(sum(1 - i) OVER q, 0), 0), 9) AS w FROM (
  SELECT s.set_name, f.feature_id, CASE WHEN t.feature_id IS NULL THEN 0 ELSE 1 END AS i, CASE WHEN t.feature_id IS NULL THEN 0.0 ELSE abs(f.score) END AS h, row_number() OVER (PARTITION BY s.set_name ORDER BY f.score DESC, f.feature_id) AS pos FROM (SELECT feature_id, length - 1900 AS score FROM var) f CROSS JOIN (SELECT DISTINCT set_name FROM sets) s LEFT JOIN sets t ON t.set_name = s.set_name AND t.feature_id = f.feature_id)
  WINDOW q AS (PARTITION BY set_name), o AS (PARTITION BY set_name ORDER BY pos ROWS UNBOUNDED PRECEDING)),
tops AS (SELECT set_name, CASE WHEN max(w) >= -min(w) THEN max(w) ELSE min(w) END AS es FROM walk GROUP BY 1),
ats AS (SELECT t.set_name, t.es, min(pos) AS peak FROM tops t JOIN walk k ON k.set_name = t.set_name AND k.w = t.es GROUP BY 1, 2)"""


def _enrichment(fx: Fixtures) -> tuple[DataFrame, DataFrame]:
    return st.enrichment(fx.var.select("feature_id", (V("length") - 1900).alias("score")), fx.sets)


@query(f"SELECT set_name, {r('es')} AS es, peak::INT AS peak FROM ats", ES)
def enrichment_score(fx: Fixtures) -> DataFrame:
    return _enrichment(fx)[0]


@query("SELECT k.set_name, k.feature_id FROM walk k JOIN ats a USING (set_name) WHERE i = 1 AND CASE WHEN es >= 0 THEN pos <= peak ELSE pos > peak END", ES)
def leading_edge(fx: Fixtures) -> DataFrame:
    return _enrichment(fx)[1]


DRAWS = """siz AS (SELECT set_name, count(*) AS size FROM sets GROUP BY 1),
drw AS (SELECT set_name, k, f.feature_id, score, row_number() OVER (PARTITION BY set_name, k ORDER BY md5('0|' || k || '|' || set_name || '|' || f.feature_id), f.feature_id) <= size AS i FROM siz CROSS JOIN (SELECT unnest(range(1, 101)) AS k) CROSS JOIN (SELECT feature_id, length - 1900 AS score FROM var) f),
hit AS (SELECT *, CASE WHEN i THEN abs(score) ELSE 0.0 END AS h, CASE WHEN i THEN 0.0 ELSE 1.0 END AS m FROM drw),
des AS (SELECT set_name, k, max(abs(w)) AS es FROM (SELECT set_name, k, round(coalesce(sum(h) OVER o / nullif(sum(h) OVER q, 0), 0) - coalesce(sum(m) OVER o / nullif(sum(m) OVER q, 0), 0), 9) AS w FROM hit
  WINDOW q AS (PARTITION BY set_name, k), o AS (PARTITION BY set_name, k ORDER BY score DESC, feature_id ROWS UNBOUNDED PRECEDING)) GROUP BY 1, 2)"""


@query(f"SELECT set_name, {r('(1 + count(*) FILTER (WHERE d.es >= abs(t.es))) / (count(*) + 1)')} AS p FROM des d JOIN tops t USING (set_name) GROUP BY 1", ES, DRAWS)
def enrichment_p(fx: Fixtures) -> DataFrame:
    return st.permutation_p(fx.var.select("feature_id", (V("length") - 1900).alias("score")), fx.sets)


CHOSEN = "cho AS (SELECT feature_id FROM var WHERE length > 1900)"


@query("SELECT set_name, count(c.feature_id) AS hits, (SELECT count(*) FROM cho) AS drawn, count(*) AS good, (SELECT p FROM sizes) AS total FROM sets s LEFT JOIN cho c USING (feature_id) GROUP BY 1", CHOSEN)
def ora_counts(fx: Fixtures) -> DataFrame:
    return st.over_representation(fx.var.where("length > 1900"), fx.var, fx.sets)


CHOOSE = "ora AS (SELECT set_name, count(c.feature_id) AS hits, (SELECT count(*) FROM cho) AS drawn, count(*) AS good, (SELECT p FROM sizes) AS total FROM sets s LEFT JOIN cho c USING (feature_id) GROUP BY 1), lch AS (SELECT *, unnest(range(hits, least(good, drawn) + 1)) AS i FROM ora)"


@query(f"SELECT set_name, hits, drawn, good, total, {r('sum(exp(lgamma(good + 1) - lgamma(i + 1) - lgamma(good - i + 1) + lgamma(total - good + 1) - lgamma(drawn - i + 1) - lgamma(total - good - drawn + i + 1) - lgamma(total + 1) + lgamma(drawn + 1) + lgamma(total - drawn + 1)))')} AS p FROM lch WHERE drawn - i <= total - good GROUP BY ALL", CHOSEN, CHOOSE)
def ora_p(fx: Fixtures) -> DataFrame:
    n = st.over_representation(fx.var.where("length > 1900"), fx.var, fx.sets)
    return n.withColumn("p", st.hypergeometric_tail(V("hits"), V("drawn"), V("good"), V("total")))


# selection -------------------------------------------------------------------------------------


@query(f"SELECT feature_id, {r('var_pop(value)')} AS variance FROM dense GROUP BY 1 HAVING var_pop(value) > 500")
def variance_threshold(fx: Fixtures) -> DataFrame:
    return se.variance_threshold(fx.cells, fx.n, 500)


@query(f"SELECT feature_id, {r('sum(c / t * ln(c * t / (b * l)))')} AS mi FROM (SELECT *, sum(c) OVER (PARTITION BY feature_id, bin) AS b, sum(c) OVER (PARTITION BY feature_id, label) AS l, sum(c) OVER (PARTITION BY feature_id) AS t FROM (SELECT feature_id, bin, label, count(*) AS c FROM (SELECT *, ntile(5) OVER (PARTITION BY feature_id ORDER BY value, sample_id) AS bin FROM dense) JOIN obs USING (sample_id) GROUP BY 1, 2, 3)) GROUP BY 1")
def mutual_info_binned(fx: Fixtures) -> DataFrame:
    return se.mutual_information(fx.dense, fx.obs, "label")


@query(f"SELECT p_brand, {r('a / b')} AS ratio FROM (SELECT p_brand, sum(p_size)::DOUBLE AS a, sum(p_retailprice) AS b FROM part GROUP BY 1) ORDER BY a / b, p_brand LIMIT 7")
def min_ratio_n(fx: Fixtures) -> DataFrame:
    df = fx.read("part").groupBy("p_brand").agg(F.sum("p_size").cast("double").alias("a"), F.sum("p_retailprice").alias("b"))
    return se.min_ratio_n(df, "a", "b", "p_brand", 7)


@query("""SELECT feature_id, count(*) AS votes FROM (SELECT g, feature_id, row_number() OVER (PARTITION BY g ORDER BY d, feature_id) AS i FROM (
  SELECT a.g, x.feature_id, sum((x.value - y.value) ** 2) AS d FROM ord a JOIN ord b ON a.g = b.g AND a.k % 2 = 0 AND b.k = a.k + 1 JOIN dense x ON x.sample_id = a.sample_id JOIN dense y ON y.sample_id = b.sample_id AND y.feature_id = x.feature_id GROUP BY 1, 2)) WHERE i <= 5 GROUP BY 1""",
    "ord AS (SELECT g, sample_id, row_number() OVER (PARTITION BY g ORDER BY md5(g || '|0|' || sample_id)) - 1 AS k FROM (SELECT DISTINCT sample_id FROM dense) CROSS JOIN (SELECT unnest(range(1, 4)) AS g))")
def distance_vote(fx: Fixtures) -> DataFrame:
    return se.distance_vote(fx.dense, 3, 5)


@query(f"SELECT feature_id, bin::BIGINT AS bin, {r('d')} AS dispersion, {r('coalesce((d - avg(d) OVER w) / nullif(stddev_samp(d) OVER w, 0), 0)')} AS z FROM (SELECT feature_id, d, least(floor((m - min(m) OVER ()) / (max(m) OVER () - min(m) OVER ()) * 5), 4) AS bin FROM (SELECT feature_id, ln(1 + avg(value)) AS m, ln(var_pop(value) / avg(value) + 1e-12) AS d FROM dense GROUP BY 1)) WINDOW w AS (PARTITION BY bin)")
def highly_variable(fx: Fixtures) -> DataFrame:
    return se.highly_variable(fx.cells, fx.n)


MAD = "lng AS (SELECT p_partkey, 'p_size' AS c, p_size::DOUBLE AS v FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part), fl AS (SELECT p_partkey, c, abs(v - mid) > 1.7 * median(abs(v - mid)) OVER (PARTITION BY c) AS o FROM (SELECT *, median(v) OVER (PARTITION BY c) AS mid FROM lng))"


@query("SELECT p_partkey FROM fl GROUP BY 1 HAVING bool_or(o)", MAD)
def mad_outliers_any(fx: Fixtures) -> DataFrame:
    return se.mad_outliers(fx.read("part"), "p_partkey", ["p_size", "p_retailprice"], 1.7)


@query("SELECT p_partkey FROM fl GROUP BY 1 HAVING bool_and(o)", MAD)
def mad_outliers_all(fx: Fixtures) -> DataFrame:
    return se.mad_outliers(fx.read("part"), "p_partkey", ["p_size", "p_retailprice"], 1.7, False)


LINKED = """lnk AS (SELECT x AS a, y AS b FROM prop WHERE rho >= 0.1 UNION SELECT y, x FROM prop WHERE rho >= 0.1),
rch AS (SELECT a, a AS b FROM lnk UNION SELECT r.a, l.b FROM rch r JOIN lnk l ON l.a = r.b),
cmp AS (SELECT a AS feature_id, min(b) AS root FROM rch GROUP BY 1)"""


@query("SELECT feature_id FROM (SELECT feature_id, row_number() OVER (PARTITION BY root ORDER BY n DESC, feature_id) AS k FROM cmp JOIN (SELECT feature_id, count(*) AS n FROM cells GROUP BY 1) USING (feature_id)) WHERE k > 1", LOGS, LINKED)
def redundant_features(fx: Fixtures) -> DataFrame:
    presence = fx.cells.groupBy("feature_id").agg(F.count("*").alias("n_cells"))
    return se.redundant_features(_proportions(fx), presence, "rho", 0.1)


@query(f"SELECT feature_id, k::INT AS position, {r('lo + (hi - lo) * k / 6')} AS edge FROM (SELECT feature_id, min(value) AS lo, max(value) AS hi FROM cells GROUP BY 1) CROSS JOIN (SELECT unnest(range(7)) AS k)")
def range_edges(fx: Fixtures) -> DataFrame:
    return se.range_edges(fx.cells, 7)


GINIS = "edg AS (SELECT feature_id, k, lo + (hi - lo) * k / 6 AS e FROM (SELECT feature_id, min(value) AS lo, max(value) AS hi FROM cells GROUP BY 1) CROSS JOIN (SELECT unnest(range(7)) AS k)), gns AS (SELECT feature_id, i, j, any_value(lo) AS lo, any_value(hi) AS hi, sum(c)::BIGINT AS n, sum(c / t * (1 - c / t)) AS gini FROM (SELECT a.feature_id, a.k AS i, b.k AS j, any_value(a.e) AS lo, any_value(b.e) AS hi, label, count(*) AS c, sum(count(*)) OVER (PARTITION BY a.feature_id, a.k, b.k) AS t FROM edg a JOIN edg b ON a.feature_id = b.feature_id AND a.k < b.k JOIN cells c ON c.feature_id = a.feature_id AND c.value >= a.e - 1e-9 AND c.value <= b.e + 1e-9 JOIN obs USING (sample_id) GROUP BY 1, 2, 3, label) GROUP BY 1, 2, 3)"


@query(f"SELECT feature_id, i::INT AS i, j::INT AS j, {r('lo')} AS lo, {r('hi')} AS hi, n, {r('gini')} AS gini FROM gns", GINIS)
def range_gini(fx: Fixtures) -> DataFrame:
    return se.range_gini(fx.cells, fx.obs, "label", 7)


@query(f"SELECT feature_id, {r('lo')} AS lo, {r('hi')} AS hi FROM gns WHERE gini < 0.6", GINIS)
def pure_intervals(fx: Fixtures) -> DataFrame:
    return se.pure_intervals(se.range_gini(fx.cells, fx.obs, "label", 7), 0.6).select("feature_id", "lo", "hi")


@query(f"SELECT feature_id, {r('min(lo)')} AS lo, {r('max(hi)')} AS hi, count(*) AS n_intervals FROM (SELECT *, sum(s) OVER (PARTITION BY feature_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY feature_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS s FROM gns WHERE gini < 0.6)) GROUP BY feature_id, g", GINIS)
def ranges(fx: Fixtures) -> DataFrame:
    return se.merged_ranges(se.pure_intervals(se.range_gini(fx.cells, fx.obs, "label", 7), 0.6))


@query(f"SELECT feature_id, {r('avg((1 - gini) * n)')} AS score FROM gns GROUP BY 1 ORDER BY avg((1 - gini) * n) DESC, feature_id LIMIT 5", GINIS)
def range_best(fx: Fixtures) -> DataFrame:
    return se.range_best(se.range_gini(fx.cells, fx.obs, "label", 7), 5)


# sampling --------------------------------------------------------------------------------------

ORDER = "hsh AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('0|' || c_custkey), c_custkey) AS k, row_number() OVER (ORDER BY md5('0|' || c_custkey), c_custkey) AS a, count(*) OVER (PARTITION BY c_mktsegment) AS n, count(*) OVER () AS t FROM customer)"


def _c(fx: Fixtures) -> DataFrame:
    return fx.read("customer")


@query("SELECT c_custkey, CASE WHEN a <= floor(t * 0.1 + 1e-9) THEN 'test' WHEN a <= floor(t * 0.35 + 1e-9) THEN 'second' ELSE 'train' END AS role FROM hsh", ORDER)
def hash_split(fx: Fixtures) -> DataFrame:
    return sp.hash_split(_c(fx), "c_custkey", {"test": 0.1, "second": 0.25, "train": 0.65})


@query("SELECT c_custkey, c_mktsegment, ((k - 1) % 5)::INT AS fold FROM hsh", ORDER)
def stratified_kfold(fx: Fixtures) -> DataFrame:
    return sp.stratified_kfold(_c(fx), "c_custkey", "c_mktsegment", 5)


@query("SELECT c_custkey, (('0x' || md5('0|' || c_custkey)[1:8])::BIGINT % 5) AS fold FROM customer")
def plain_kfold(fx: Fixtures) -> DataFrame:
    return sp.kfold(_c(fx), "c_custkey", 5)


@query()
def group_kfold(fx: Fixtures) -> DataFrame:
    return sp.group_kfold(_c(fx), "c_nationkey", "c_mktsegment", 4)


@query("SELECT c_custkey, c_mktsegment FROM hsh WHERE k <= CASE c_mktsegment WHEN 'BUILDING' THEN 10 WHEN 'MACHINERY' THEN 100000 ELSE 0 END", ORDER)
def sample_by_class(fx: Fixtures) -> DataFrame:
    return sp.sample_by_class(_c(fx), "c_custkey", "c_mktsegment", {"BUILDING": 10, "MACHINERY": 100000}).select("c_custkey", "c_mktsegment")


@query("SELECT c_custkey FROM hsh WHERE k <= greatest(1, round_even(n * 0.03, 0))", ORDER)
def preserving_sample(fx: Fixtures) -> DataFrame:
    return sp.preserving_sample(_c(fx), "c_custkey", "c_mktsegment", 0.03).select("c_custkey")


@query("SELECT c_custkey, c_mktsegment, CASE WHEN a <= floor(t * 0.2 + 1e-9) OR j <= 3 THEN 'test' ELSE 'train' END AS role FROM (SELECT *, CASE WHEN a > floor(t * 0.2 + 1e-9) THEN row_number() OVER (PARTITION BY c_mktsegment, a > floor(t * 0.2 + 1e-9) ORDER BY md5('1|' || c_custkey), c_custkey) END AS j FROM hsh)", ORDER)
def split_and_sample(fx: Fixtures) -> DataFrame:
    return sp.split_and_sample(_c(fx).select("c_custkey", "c_mktsegment"), "c_custkey", "c_mktsegment", 0.2, 3)


@query("SELECT c_custkey FROM customer WHERE c_nationkey = 3 UNION ALL SELECT c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('0|' || c_custkey), c_custkey) AS k, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer WHERE c_nationkey <> 3) WHERE k <= greatest(1, round_even(n * 0.1, 0))")
def keep_and_sample(fx: Fixtures) -> DataFrame:
    return sp.keep_and_sample(_c(fx), "c_custkey", "c_mktsegment", "c_nationkey", 3, 0.1).select("c_custkey")


@query("SELECT g::INT AS round, c_custkey FROM (SELECT g, c_custkey, row_number() OVER (PARTITION BY g, c_mktsegment ORDER BY md5(g || '|' || c_custkey), c_custkey) AS k FROM customer CROSS JOIN (SELECT unnest(range(3)) AS g)) WHERE k <= (SELECT min(c) FROM (SELECT count(*) AS c FROM customer GROUP BY c_mktsegment))")
def balanced_rounds(fx: Fixtures) -> DataFrame:
    return sp.balanced_rounds(_c(fx), "c_custkey", "c_mktsegment", 3).select("round", "c_custkey")


@query("SELECT c.lang, c.n, l.rung AS target FROM (SELECT lang, n, max(pos) AS p FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1) JOIN lad ON rung <= n GROUP BY 1, 2) c JOIN lad l ON l.pos = greatest(least(c.p + 1, 4), 0)", "lad AS (SELECT pos, round(lo * pow(hi / lo, pos / 4.0))::BIGINT AS rung FROM (SELECT min(n)::DOUBLE AS lo, max(n)::DOUBLE AS hi FROM (SELECT count(*) AS n FROM documents GROUP BY lang)) CROSS JOIN (SELECT unnest(range(5)) AS pos))")
def spaced_resample(fx: Fixtures) -> DataFrame:
    return sp.spaced_targets(fx.read("documents").select("lang"), "lang", 5)


@query("SELECT lang, n, CASE WHEN n <> max(n) OVER () THEN max(n) OVER () ELSE n END AS target FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1)")
def sampling_strategy(fx: Fixtures) -> DataFrame:
    return sp.sampling_strategy(fx.read("documents").select("lang"), "lang", "not majority")


@query("SELECT c_custkey, g AS copy FROM (SELECT c_custkey, unnest(range(1, ((m - k) // n + 2)::BIGINT)) AS g FROM (SELECT *, max(n) OVER () AS m FROM hsh))", ORDER)
def random_oversample(fx: Fixtures) -> DataFrame:
    return sp.random_oversample(_c(fx), "c_custkey", "c_mktsegment").select("c_custkey", "copy")


@query("SELECT c_custkey FROM (SELECT *, min(n) OVER () AS m FROM hsh) WHERE k <= m", ORDER)
def random_undersample(fx: Fixtures) -> DataFrame:
    return sp.random_undersample(_c(fx), "c_custkey", "c_mktsegment").select("c_custkey")


NEAR = "dst AS (SELECT a.sample_id, b.sample_id AS other, round(sqrt(sum((a.value - b.value) ** 2)), 9) AS d FROM dense a JOIN dense b ON a.feature_id = b.feature_id AND a.sample_id <> b.sample_id GROUP BY 1, 2), nn AS (SELECT x.sample_id, p.label, x.other, q.label AS other_label, d, row_number() OVER (PARTITION BY x.sample_id ORDER BY d, other) AS k FROM dst x JOIN obs p ON p.sample_id = x.sample_id JOIN obs q ON q.sample_id = x.other)"


def _near(fx: Fixtures, k: int, within: bool = False) -> DataFrame:
    return sp.neighbours(fx.cells, fx.obs, "label", k, within)


@query("SELECT a.sample_id, a.other FROM nn a JOIN nn b ON b.sample_id = a.other AND b.other = a.sample_id WHERE a.k = 1 AND b.k = 1 AND a.sample_id < a.other AND a.label <> a.other_label", NEAR)
def tomek_remove(fx: Fixtures) -> DataFrame:
    return sp.tomek_links(_near(fx, 1)).select("sample_id", "other")


@query("SELECT sample_id FROM nn WHERE k <= 3 GROUP BY 1 HAVING 2 * count(*) FILTER (WHERE label <> other_label) > count(*)", NEAR)
def enn_remove(fx: Fixtures) -> DataFrame:
    return sp.enn_remove(_near(fx, 3))


@query(f"SELECT label, count(*) FILTER (WHERE label <> other_label) AS n, {r('100 * count(*) FILTER (WHERE label <> other_label) / count(*)')} AS pct FROM nn WHERE k = 1 GROUP BY 1", NEAR)
def tomek_class(fx: Fixtures) -> DataFrame:
    return sp.cross_links(_near(fx, 1))[0]


@query("SELECT least(label, other_label) AS x, greatest(label, other_label) AS y, count(*) AS n FROM nn WHERE k = 1 AND label <> other_label GROUP BY 1, 2", NEAR)
def tomek_pairs(fx: Fixtures) -> DataFrame:
    return sp.cross_links(_near(fx, 1))[1]


@query(f"SELECT p.sample_id, p.other, a.feature_id, {r('a.value + p.w * (b.value - a.value)')} AS value FROM pik p JOIN dense a ON a.sample_id = p.sample_id JOIN dense b ON b.sample_id = p.other AND b.feature_id = a.feature_id", NEAR, "wnn AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY d, other) AS kk FROM nn WHERE label = other_label)", "pik AS (SELECT sample_id, other, ('0x' || h[1:8])::BIGINT / 4294967296.0 AS w FROM (SELECT *, md5('0|' || sample_id || '|' || other) AS h, row_number() OVER (PARTITION BY sample_id ORDER BY md5('0|' || sample_id || '|' || other)) AS i FROM wnn WHERE kk <= 3) WHERE i = 1)")
def smote(fx: Fixtures) -> DataFrame:
    return sp.smote(fx.dense, _near(fx, 3, True))


# evaluation ------------------------------------------------------------------------------------


@query("SELECT a.c AS truth, b.c AS prediction, (SELECT count(*) FROM pred p WHERE p.truth = a.c AND p.prediction = b.c) AS n FROM (SELECT DISTINCT truth AS c FROM pred) a CROSS JOIN (SELECT DISTINCT truth AS c FROM pred) b")
def confusion_long(fx: Fixtures) -> DataFrame:
    return ev.confusion(fx.pred)


def _metric_sql(by: str) -> tuple[str, str]:
    g, b, on = (f"{by}, ", f"GROUP BY {by}", f"USING ({by})") if by else ("", "", "")
    rep = f"""rep AS (SELECT {g}c, sum((truth = c)::INT)::DOUBLE AS s, sum((prediction = c)::INT)::DOUBLE AS p, sum((truth = c AND prediction = c)::INT)::DOUBLE AS h FROM pred CROSS JOIN (SELECT DISTINCT truth AS c FROM pred) GROUP BY {g}c),
pr AS (SELECT *, coalesce(h / nullif(p, 0), 0) AS pre, coalesce(h / nullif(s, 0), 0) AS rec, coalesce(2 * h / nullif(s + p, 0), 0) AS f1 FROM rep),
sq AS (SELECT {g}sum(n * n)::DOUBLE AS nn FROM (SELECT {g}truth, prediction, count(*) AS n FROM pred GROUP BY {g}truth, prediction) {b}),
ag AS (SELECT {g}sum(h) AS h, sum(s) AS t, sum(s * p) AS e, sum(s * s) AS ss, sum(p * p) AS pp, avg(CASE WHEN s > 0 THEN rec END) AS bal, avg(coalesce(h / nullif(s + p - h, 0), 0)) AS jac, avg(f1) AS mf, sum(f1 * s) / sum(s) AS wf FROM pr {b})"""
    body = f"SELECT {g}{r('h / t')} AS accuracy, {r('bal')} AS balanced_accuracy, {r('(h / t - e / (t * t)) / nullif(1 - e / (t * t), 0)')} AS kappa, {r('jac')} AS jaccard, {r('(h * t - e) / sqrt((t * t - pp) * (t * t - ss))')} AS mcc, {r('(nn - t) / sqrt((pp - t) * (ss - t))')} AS fowlkes_mallows, {r('mf')} AS macro_f1, {r('wf')} AS weighted_f1 FROM ag {'JOIN sq ' + on if by else 'CROSS JOIN sq'}"
    return body, rep


@query(*_metric_sql(""))
def metrics_all(fx: Fixtures) -> DataFrame:
    return ev.metrics(ev.confusion(fx.pred))


@query(*_metric_sql("model"))
def metrics_by_group(fx: Fixtures) -> DataFrame:
    return ev.metrics(ev.confusion(fx.pred, ["model"]), ["model"])


@query(*_metric_sql("fold"))
def combined_metrics(fx: Fixtures) -> DataFrame:
    return ev.metrics(ev.confusion(fx.pred, ["fold"]), ["fold"])


@query(f"SELECT c AS class, s::BIGINT AS support, p::BIGINT AS predicted, h::BIGINT AS hits, {r('pre')} AS precision, {r('rec')} AS recall, {r('f1')} AS f1 FROM pr", _metric_sql("")[1])
def class_report(fx: Fixtures) -> DataFrame:
    return ev.class_report(ev.confusion(fx.pred))


@query("SELECT sample_id, truth, prediction, " + ", ".join(f"{r(f'max(score) FILTER (WHERE class = {chr(39)}{c}{chr(39)})')} AS {c}" for c in SEGMENTS) + " FROM pred JOIN scores USING (sample_id) WHERE truth <> prediction GROUP BY 1, 2, 3")
def misses(fx: Fixtures) -> DataFrame:
    return ev.misses(fx.pred.select("sample_id", "truth", "prediction"), fx.scores, SEGMENTS)


POINTS = "pts AS (SELECT class, score, sum(y) OVER o AS tp, sum(c - y) OVER o AS fp, sum(y) OVER w AS pos, sum(c - y) OVER w AS neg FROM (SELECT class, score, sum((truth = class)::INT)::DOUBLE AS y, count(*) AS c FROM scores JOIN pred USING (sample_id) GROUP BY 1, 2) WINDOW w AS (PARTITION BY class), o AS (PARTITION BY class ORDER BY score DESC ROWS UNBOUNDED PRECEDING)), auc AS (SELECT class, sum((fp - pf) * (tp + pt) / 2) / (any_value(pos) * any_value(neg)) AS a FROM (SELECT *, coalesce(lag(fp) OVER w, 0) AS pf, coalesce(lag(tp) OVER w, 0) AS pt FROM pts WINDOW w AS (PARTITION BY class ORDER BY score DESC)) GROUP BY 1)"


def _points(fx: Fixtures) -> DataFrame:
    return ev.curve_points(fx.pred, fx.scores)


@query(f"SELECT class, {r('score')} AS score, {r('fp / neg')} AS fpr, {r('tp / pos')} AS tpr FROM pts", POINTS)
def roc_curve(fx: Fixtures) -> DataFrame:
    return ev.roc_curve(_points(fx))


@query(f"SELECT {r('avg(a)')} AS auroc FROM auc", POINTS)
def auroc_macro_ovr(fx: Fixtures) -> DataFrame:
    return ev.auroc_macro(_points(fx))


@query(f"SELECT {r('avg(a)')} AS auroc FROM (SELECT x.class, y.truth, avg(CASE WHEN x.score > y.score THEN 1.0 WHEN x.score = y.score THEN 0.5 ELSE 0 END) AS a FROM (SELECT class, score FROM scores JOIN pred USING (sample_id) WHERE truth = class) x JOIN (SELECT class, score, truth FROM scores JOIN pred USING (sample_id) WHERE truth <> class) y USING (class) GROUP BY 1, 2)")
def auroc_macro_ovo(fx: Fixtures) -> DataFrame:
    return ev.auroc_ovo(fx.pred, fx.scores)


@query(f"SELECT class, {r('score')} AS score, {r('tp / (tp + fp)')} AS precision, {r('tp / pos')} AS recall FROM pts", POINTS)
def pr_curve(fx: Fixtures) -> DataFrame:
    return ev.pr_curve(_points(fx))


@query(f"SELECT class, {r('sum((tp - pt) / pos * tp / (tp + fp))')} AS average_precision FROM (SELECT *, coalesce(lag(tp) OVER (PARTITION BY class ORDER BY score DESC), 0) AS pt FROM pts) GROUP BY 1", POINTS)
def average_precision(fx: Fixtures) -> DataFrame:
    return ev.average_precision(_points(fx))


FOLDS = "fld AS (SELECT sample_id, label, ((row_number() OVER (PARTITION BY label ORDER BY md5('0|' || sample_id), sample_id) - 1) % 3)::INT AS fold FROM obs)"
CENTROID = "SELECT {by}, sample_id, label AS truth, prediction FROM (SELECT *, row_number() OVER (PARTITION BY {by}, sample_id ORDER BY d, prediction) AS k FROM (SELECT t.{by}, t.sample_id, t.label, m.prediction, round(sum((t.value - m.c) ** 2), 6) AS d FROM tst t JOIN mid m ON m.{by} = t.{by} AND m.feature_id = t.feature_id GROUP BY 1, 2, 3, 4)) WHERE k = 1"


@query(CENTROID.format(by="fold"), FOLDS, "tst AS (SELECT d.*, fold, label FROM dense d JOIN fld USING (sample_id))", "mid AS (SELECT f.fold, t.label AS prediction, t.feature_id, avg(t.value) AS c FROM tst t JOIN (SELECT unnest(range(3)) AS fold) f ON f.fold <> t.fold GROUP BY 1, 2, 3)")
def cv_centroid(fx: Fixtures) -> DataFrame:
    return ev.cross_validate(fx.dense, fx.labels, sp.stratified_kfold(fx.labels, "sample_id", "label", 3).select("sample_id", "fold"), 3)


SPLITS = "splits AS (SELECT 'even' AS split, CASE WHEN sample_id % 4 = 0 THEN 'test' ELSE 'train' END AS role, sample_id FROM obs UNION ALL SELECT 'b0', CASE WHEN batch = 'b0' THEN 'test' ELSE 'train' END, sample_id FROM obs)"


def _splits(fx: Fixtures) -> DataFrame:
    from assaymill.operators.prepare import named_splits

    return named_splits(fx.obs, {"even": V("sample_id") % 4 == 0, "b0": V("batch") == "b0"})


@query(f"SELECT split, role, label, count(*) AS n, {r('count(*) / sum(count(*)) OVER (PARTITION BY split, role)')} AS share FROM splits JOIN obs USING (sample_id) GROUP BY 1, 2, 3", SPLITS)
def split_props(fx: Fixtures) -> DataFrame:
    return ev.split_props(_splits(fx), fx.labels)


@query(CENTROID.format(by="split"), SPLITS, "tst AS (SELECT d.*, split, label FROM dense d JOIN splits USING (sample_id) JOIN obs USING (sample_id) WHERE role = 'test')", "mid AS (SELECT split, label AS prediction, feature_id, avg(value) AS c FROM dense JOIN splits USING (sample_id) JOIN obs USING (sample_id) WHERE role = 'train' GROUP BY 1, 2, 3)")
def holdout_centroid(fx: Fixtures) -> DataFrame:
    return ev.holdout(fx.dense, fx.labels, _splits(fx))


ROBUST = "acc AS (SELECT model || '-' || fold AS m, avg(CASE WHEN truth = prediction THEN 1.0 ELSE 0.0 END) AS x, avg(CASE WHEN truth = prediction AND sample_id % 7 <> 0 THEN 1.0 ELSE 0.0 END) AS y FROM pred GROUP BY 1)"


def _robust(fx: Fixtures) -> DataFrame:
    ok = V("truth") == V("prediction")
    return fx.pred.groupBy(F.concat_ws("-", "model", V("fold").cast("string")).alias("m")).agg(F.avg(ok.cast("double")).alias("x"), F.avg((ok & (V("sample_id") % 7 != 0)).cast("double")).alias("y"))


@query(f"SELECT {r('regr_slope(y, x)')} AS slope, {r('regr_intercept(y, x)')} AS intercept FROM acc", ROBUST)
def robustness_beta(fx: Fixtures) -> DataFrame:
    return ev.robustness_beta(_robust(fx), "x", "y")


@query(f"SELECT m, {r('y - (s * x + i)')} AS effective, {r('y - x')} AS relative FROM acc CROSS JOIN (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM acc)", ROBUST)
def effective_robustness(fx: Fixtures) -> DataFrame:
    return ev.effective_robustness(_robust(fx), "m", "x", "y")


@query(f"SELECT p_type, {r('avg((p_retailprice - p_size * 40) ** 2)')} AS mse, {r('sqrt(avg((p_retailprice - p_size * 40) ** 2)) / (max(p_retailprice) - min(p_retailprice))')} AS nrmse, {r('corr(p_retailprice, p_size * 40)')} AS pearson FROM part GROUP BY 1")
def regression_metrics(fx: Fixtures) -> DataFrame:
    return ev.regression_metrics(fx.read("part").withColumn("guess", V("p_size") * 40.0), "p_retailprice", "guess", ["p_type"])


@query(f"SELECT {r('(i - a * b / tt) / ((a + b) / 2 - a * b / tt)')} AS adjusted_rand FROM (SELECT (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM pred GROUP BY truth, prediction)) AS i, (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM pred GROUP BY truth)) AS a, (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM pred GROUP BY prediction)) AS b, (SELECT count(*) * (count(*) - 1) / 2 FROM pred) AS tt)")
def adjusted_rand(fx: Fixtures) -> DataFrame:
    return ev.adjusted_rand(fx.pred, "truth", "prediction")


@query(f"SELECT {r('2 * sum(n / t * ln(n * t / (a * b))) / (-sum(n / t * ln(a / t)) - sum(n / t * ln(b / t)))')} AS nmi FROM (SELECT count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY truth) AS a, sum(count(*)) OVER (PARTITION BY prediction) AS b, sum(count(*)) OVER () AS t FROM pred GROUP BY truth, prediction)")
def nmi(fx: Fixtures) -> DataFrame:
    return ev.nmi(fx.pred, "truth", "prediction")


MID = "mid AS (SELECT label, feature_id, avg(value) AS c FROM dense JOIN obs USING (sample_id) GROUP BY 1, 2)"


@query(f"SELECT {r('avg(q)')} AS davies_bouldin FROM (SELECT m.a, max((x.s + y.s) / m.d) AS q FROM (SELECT p.label AS a, q.label AS b, sqrt(sum((p.c - q.c) ** 2)) AS d FROM mid p JOIN mid q ON p.feature_id = q.feature_id AND p.label <> q.label GROUP BY 1, 2) m JOIN spr x ON x.label = m.a JOIN spr y ON y.label = m.b GROUP BY 1)", MID, "spr AS (SELECT label, avg(d) AS s FROM (SELECT o.label, d.sample_id, sqrt(sum((value - c) ** 2)) AS d FROM dense d JOIN obs o USING (sample_id) JOIN mid m ON m.label = o.label AND m.feature_id = d.feature_id GROUP BY 1, 2) GROUP BY 1)")
def davies_bouldin(fx: Fixtures) -> DataFrame:
    return ev.davies_bouldin(fx.dense, fx.labels)


@query(f"SELECT {r('b * (t - k) / (w * (k - 1))')} AS calinski_harabasz FROM (SELECT (SELECT sum(n * (c - g) ** 2) FROM mid JOIN (SELECT label, count(*) AS n FROM obs GROUP BY 1) USING (label) JOIN (SELECT feature_id, avg(value) AS g FROM dense GROUP BY 1) USING (feature_id)) AS b, (SELECT sum((value - c) ** 2) FROM dense d JOIN obs o USING (sample_id) JOIN mid m ON m.label = o.label AND m.feature_id = d.feature_id) AS w, (SELECT count(*) FROM obs) AS t, (SELECT count(DISTINCT label) FROM obs) AS k)", MID)
def calinski_harabasz(fx: Fixtures) -> DataFrame:
    return ev.calinski_harabasz(fx.dense, fx.labels)


DIST = "dis AS (SELECT a.sample_id, b.sample_id AS other, p.label, q.label AS other_label, sqrt(sum((a.value - b.value) ** 2)) AS d FROM dense a JOIN dense b ON a.feature_id = b.feature_id AND a.sample_id <> b.sample_id JOIN obs p ON p.sample_id = a.sample_id JOIN obs q ON q.sample_id = b.sample_id GROUP BY 1, 2, 3, 4)"


@query(f"SELECT {r('avg(coalesce((b - a) / nullif(greatest(a, b), 0), 0))')} AS silhouette FROM (SELECT sample_id, min(m) FILTER (WHERE label = other_label) AS a, min(m) FILTER (WHERE label <> other_label) AS b FROM (SELECT sample_id, label, other_label, avg(d) AS m FROM dis GROUP BY 1, 2, 3) GROUP BY 1)", DIST)
def silhouette(fx: Fixtures) -> DataFrame:
    return ev.silhouette(fx.dense, fx.labels)


# models and explanations -----------------------------------------------------------------------


@query("SELECT value, (dense_rank() OVER (ORDER BY value) - 1)::INT AS code FROM (SELECT DISTINCT label AS value FROM obs)")
def label_encode(fx: Fixtures) -> DataFrame:
    return mo.label_encode(fx.obs, "label")


@query(f"SELECT {r('sum(c) / sum(s)')} AS dimension FROM (SELECT sample_id, sum(ln(f / d)) AS s, count(*) AS c FROM (SELECT *, max(d) OVER (PARTITION BY sample_id) AS f FROM nn WHERE k <= 5 AND d > 0) WHERE d < f GROUP BY 1)", NEAR)
def intrinsic_dim_mle(fx: Fixtures) -> DataFrame:
    return mo.intrinsic_dimension(_near(fx, 5))


CONTRIB = "con AS (SELECT sample_id, 'c' || k AS class, feature_id, (length(feature_id) - 7 + k * 0.5) * (value - m) AS x FROM dense JOIN (SELECT feature_id, avg(value) AS m FROM dense GROUP BY 1) USING (feature_id) CROSS JOIN (SELECT unnest(range(2)) AS k)), tp AS (SELECT sample_id, label AS truth, CASE WHEN sample_id % 3 = 0 THEN 'ASIA' ELSE label END AS prediction FROM obs)"


def _contrib(fx: Fixtures) -> DataFrame:
    coefs = fx.var.select("feature_id", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("k")).select("feature_id", F.concat(F.lit("c"), V("k").cast("string")).alias("class"), (F.length("feature_id") - 7 + V("k") * 0.5).alias("coef"))
    return mo.linear_contributions(fx.dense, coefs, fx.n)


@query(f"SELECT sample_id, class, feature_id, {r('x')} AS contribution FROM con", CONTRIB)
def linear_contrib(fx: Fixtures) -> DataFrame:
    return _contrib(fx)


@query(f"SELECT class, feature_id, {r('stddev_pop(x)')} AS std, {r('max(x) - min(x)')} AS range FROM con GROUP BY 1, 2", CONTRIB)
def consistency_std(fx: Fixtures) -> DataFrame:
    return mo.consistency(_contrib(fx)).select("class", "feature_id", "std", "range")


@query(f"SELECT class, feature_id, {r('100 * count(*) FILTER (WHERE x > 0) / count(*)')} AS pct_positive, {r('100 * count(*) FILTER (WHERE x < 0) / count(*)')} AS pct_negative FROM con GROUP BY 1, 2", CONTRIB)
def consistency_signs(fx: Fixtures) -> DataFrame:
    return mo.consistency(_contrib(fx)).select("class", "feature_id", "pct_positive", "pct_negative")


@query(f"SELECT class, feature_id, {r('avg(abs(x)) FILTER (WHERE truth = prediction)')} AS \"right\", {r('avg(abs(x)) FILTER (WHERE truth <> prediction)')} AS wrong FROM con JOIN tp USING (sample_id) GROUP BY 1, 2", CONTRIB)
def global_importance(fx: Fixtures) -> DataFrame:
    pred = fx.obs.select("sample_id", V("label").alias("truth"), F.when(V("sample_id") % 3 == 0, "ASIA").otherwise(V("label")).alias("prediction"))
    return mo.global_importance(_contrib(fx), pred)


@query(f"SELECT label AS x, other_label AS y, {r('avg(d)')} AS distance FROM dis WHERE label <= other_label GROUP BY 1, 2", DIST)
def label_distance(fx: Fixtures) -> DataFrame:
    return mo.label_distance(fx.dense, fx.labels)


@query(f"SELECT sample_id, other, {r('d')} AS distance FROM dis", DIST)
def instance_distance(fx: Fixtures) -> DataFrame:
    return ev.distances(fx.dense)


@query(f"SELECT label, sample_id, {r('m')} AS mean_distance FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY m, sample_id) AS k FROM (SELECT label, sample_id, round(avg(d), 9) AS m FROM dis WHERE label = other_label GROUP BY 1, 2)) WHERE k = 1", DIST)
def class_medoids(fx: Fixtures) -> DataFrame:
    return mo.class_medoids(fx.dense, fx.labels)


@query()
def forest_holdout(fx: Fixtures) -> DataFrame:
    features = [x["feature_id"] for x in fx.var.select("feature_id").orderBy("feature_id").collect()]
    scaler = (nm.fit_scaler, lambda cells, s: nm.apply_scaler(cells, s))
    model = mo.Pipeline([scaler], mo.classifier("forest", numTrees=8, maxDepth=4), features)
    test = V("sample_id") % 4 == 0
    return model.fit(fx.dense.where(~test), fx.labels).predict(fx.dense.where(test)).join(fx.labels, "sample_id")

# contrasts -------------------------------------------------------------------------------------

from assaymill.operators import contrasts as co  # noqa: E402


def _logs(fx: Fixtures) -> DataFrame:
    return fx.dense.withColumn("value", F.log1p("value"))


def _features(fx: Fixtures) -> list[str]:
    return [x["feature_id"] for x in fx.var.select("feature_id").orderBy("feature_id").collect()]


@query(f"SELECT a.feature_id, {r('log2(a.m1 + 1) - log2(a.m2 + 1)')} AS lfc_asia, {r('log2(b.m1 + 1) - log2(b.m2 + 1)')} AS lfc_europe FROM mom a JOIN mom b ON a.feature_id = b.feature_id AND a.label = 'ASIA' AND b.label = 'EUROPE'", MOMENTS)
def ovr_consistency(fx: Fixtures) -> DataFrame:
    lfc = st.ovr_lfc(_moments(fx))
    one = lambda x: lfc.where(V("label") == x).drop("label")
    return co.joined_results(one("ASIA"), one("EUROPE"), "feature_id", ("asia", "europe"))


@query(f"SELECT feature_id, {r('a')} AS mean_a, {r('b')} AS mean_b, {r('a - b')} AS lfc FROM (SELECT feature_id, avg(ln(value + 1)) FILTER (WHERE label = 'ASIA') AS a, avg(ln(value + 1)) FILTER (WHERE label = 'EUROPE') AS b FROM dense JOIN obs USING (sample_id) GROUP BY 1)")
def group_mean_logcpm(fx: Fixtures) -> DataFrame:
    return co.group_means(_logs(fx), fx.obs, "label", "ASIA", "EUROPE")


@query(f"SELECT feature_id, label, {r('m - (sum(m) OVER w - m) / (count(*) OVER w - 1)')} AS lfc FROM (SELECT feature_id, label, avg(ln(value + 1)) AS m FROM dense JOIN obs USING (sample_id) GROUP BY 1, 2) WINDOW w AS (PARTITION BY feature_id)")
def ovr_contrast(fx: Fixtures) -> DataFrame:
    return co.ovr_contrast(_logs(fx), fx.obs, "label")


@query(f"""SELECT feature_id, batch AS label, {r('(sum(k) - count(*) * (count(*) + 1) / 2) / (count(*) * (any_value(n) - count(*)))')} AS auroc FROM (SELECT *, rank() OVER (PARTITION BY feature_id ORDER BY value) + (count(*) OVER (PARTITION BY feature_id, value) - 1) / 2.0 AS k, count(*) OVER (PARTITION BY feature_id) AS n FROM dense JOIN obs USING (sample_id) WHERE label = 'ASIA') GROUP BY 1, 2 HAVING count(*) < any_value(n)""")
def wilcoxon_two_group(fx: Fixtures) -> DataFrame:
    asia = fx.obs.where("label = 'ASIA'")
    return st.auroc(fx.cells, asia, "batch", fx.var).select("feature_id", "label", "auroc")


ROLES = "rol AS (SELECT d.*, label, CASE WHEN d.sample_id % 4 = 0 THEN 'test' ELSE 'train' END AS role FROM dense d JOIN obs USING (sample_id)), cmp AS (SELECT feature_id, label, avg(value) FILTER (WHERE role = 'test') AS t, avg(value) FILTER (WHERE role = 'train') AS n, avg(value) AS a FROM rol GROUP BY 1, 2 HAVING count(DISTINCT role) = 2)"


def _roles(fx: Fixtures) -> DataFrame:
    return fx.obs.withColumn("role", F.when(V("sample_id") % 4 == 0, "test").otherwise("train"))


@query(f"SELECT feature_id, {r('avg(t - n)')} AS shift FROM cmp GROUP BY 1", ROLES)
def split_shift(fx: Fixtures) -> DataFrame:
    return co.split_shift(fx.dense, _roles(fx), "label", "role")


@query(f"SELECT feature_id, label, {r('t - n')} AS vs_train, {r('t - a')} AS vs_all, {r('abs(t - n) - abs(t - a)')} AS gap FROM cmp", ROLES)
def split_compare(fx: Fixtures) -> DataFrame:
    return co.split_compare(fx.dense, _roles(fx), "label", "role")


@query("SELECT p_brand, CASE WHEN bool_or(p_size > 48) AND bool_or(p_retailprice > 1000) THEN 'both' WHEN bool_or(p_size > 48) THEN 'first' ELSE 'second' END AS found FROM part WHERE p_size > 48 OR p_retailprice > 1000 GROUP BY 1")
def enrichment_overlap(fx: Fixtures) -> DataFrame:
    part = fx.read("part")
    return co.set_overlap(part.where("p_size > 48"), part.where("p_retailprice > 1000"), "p_brand")


@query("SELECT x, y, sum(n)::BIGINT AS n FROM (SELECT label AS x, other_label AS y, count(*) AS n FROM nn WHERE k = 1 AND label <> other_label GROUP BY 1, 2 UNION ALL SELECT other_label, label, count(*) FROM nn WHERE k = 1 AND label <> other_label GROUP BY 1, 2) GROUP BY 1, 2", NEAR)
def tomek_matrix(fx: Fixtures) -> DataFrame:
    return co.symmetric(sp.cross_links(_near(fx, 1))[1])


@query(_metric_sql("task")[0], "both_tasks AS (SELECT 'model' AS task, truth, prediction FROM pred UNION ALL SELECT 'fold', truth, CASE WHEN fold = 0 THEN truth ELSE prediction END FROM pred)", _metric_sql("task")[1].replace("FROM pred", "FROM both_tasks"))
def multitask_metrics(fx: Fixtures) -> DataFrame:
    one = fx.pred.select(F.lit("model").alias("task"), "truth", "prediction")
    two = fx.pred.select(F.lit("fold").alias("task"), "truth", F.when(V("fold") == 0, V("truth")).otherwise(V("prediction")).alias("prediction"))
    return ev.metrics(ev.confusion(one.union(two), ["task"]), ["task"])


@query(f"SELECT class, feature_id, {r('m')} AS importance, k::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY m DESC, feature_id) AS k FROM (SELECT class, feature_id, round(avg(abs(x)), 9) AS m FROM con GROUP BY 1, 2)) WHERE k <= 5", CONTRIB)
def most_important(fx: Fixtures) -> DataFrame:
    from assaymill.operators.summaries import top_n

    m = _contrib(fx).groupBy("class", "feature_id").agg(F.round(F.avg(F.abs("contribution")), 9).alias("importance"))
    return top_n(m, [F.desc("importance"), V("feature_id")], 5, ["class"])


@query("SELECT p_type, p_brand, score, k::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY score DESC, p_brand) AS k FROM (SELECT r.*, f FROM rat r LEFT JOIN (SELECT p_brand, min(p_type) AS f FROM rat WHERE i <= 3 GROUP BY 1) USING (p_brand)) WHERE f IS NULL OR f >= p_type) WHERE k <= 3", "rat AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY score DESC, p_brand) AS i FROM (SELECT p_type, p_brand, round(sum(p_retailprice) / sum(p_size), 6) AS score FROM part WHERE p_brand <> 'Brand#1' GROUP BY 1, 2))")
def disjoint_top_n_ratio(fx: Fixtures) -> DataFrame:
    from assaymill.operators.summaries import disjoint_top_n

    ratio = fx.read("part").where("p_brand <> 'Brand#1'").groupBy("p_type", "p_brand").agg(F.round(F.sum("p_retailprice") / F.sum("p_size"), 6).alias("score"))
    return disjoint_top_n(ratio, "p_type", "p_type", "p_brand", "score", 3)


@query(f"SELECT sample_id, feature_id, {r('value - b + a')} AS value FROM (SELECT d.*, avg(value) OVER (PARTITION BY batch, feature_id) AS b, avg(CASE WHEN batch = 'b0' THEN value END) OVER (PARTITION BY feature_id) AS a FROM dense d JOIN obs USING (sample_id))")
def rbe_design(fx: Fixtures) -> DataFrame:
    design = fx.obs.select("sample_id", F.explode(F.array(F.struct(F.lit("one").alias("term"), F.lit(1.0).alias("x")), F.struct(F.lit("b1").alias("term"), (V("batch") == "b1").cast("double").alias("x")))).alias("e")).select("sample_id", "e.term", "e.x")
    return co.remove_design(fx.dense, design, ["b1"])


@query()
def quantile_batch(fx: Fixtures) -> DataFrame:
    return nb.fit(fx.cells, fx.obs, "batch", "label").adjust(fx.dense)


@query()
def plage_scores(fx: Fixtures) -> DataFrame:
    return co.plage(fx.dense, fx.sets)


def _components_sql(k: int, squarings: int = 22) -> str:
    """CTEs e1, e2, ... (x, y, c: the component's weights times each other) and l1, l2, ...: powers of the covariances by squaring, each component taken off for the next."""
    ctes = ["cov AS MATERIALIZED (SELECT a.feature_id AS x, b.feature_id AS y, covar_samp(a.value, b.value) AS c FROM dense a JOIN dense b USING (sample_id) GROUP BY 1, 2)"]
    for i in range(1, k + 1):
        base = "cov" if i == 1 else f"d{i}"
        last = base
        for j in range(squarings + 1):
            raw = last if j == 0 else f"(SELECT a.x, b.y, sum(a.c * b.c) AS c FROM {last} a JOIN {last} b ON a.y = b.x GROUP BY 1, 2)"
            ctes.append(f"p{i}_{j} AS MATERIALIZED (SELECT x, y, c / sum(CASE WHEN x = y THEN c END) OVER () AS c FROM {raw})")
            last = f"p{i}_{j}"
        ctes.append(f"l{i} AS MATERIALIZED (SELECT sum(a.c * b.c) AS l FROM {last} a JOIN cov b USING (x, y))")
        ctes.append(f"w{i} AS MATERIALIZED (SELECT x, c / sqrt((SELECT max(c) FROM {last} WHERE x = y)) AS w FROM {last} WHERE y = (SELECT x FROM {last} WHERE x = y ORDER BY c DESC, x LIMIT 1))")
        ctes.append(f"d{i + 1} AS MATERIALIZED (SELECT x, y, c - (SELECT l FROM l{i}) * p.c AS c FROM {base} JOIN {last} p USING (x, y))".replace("c - (", f"{base}.c - (", 1))
    return ", ".join(ctes)


def _components(fx: Fixtures) -> gr.Components:
    return gr.Components(fx.cells, fx.var, fx.n, 2)


@query("SELECT sample_id, " + ", ".join(r(f"sum((value - m) * w{i}.w)") + f" AS pc{i}" for i in (1, 2)) + " FROM dense JOIN (SELECT feature_id, avg(value) AS m FROM dense GROUP BY 1) USING (feature_id) JOIN w1 ON w1.x = feature_id JOIN w2 ON w2.x = feature_id GROUP BY 1", _components_sql(2))
def pca_scores(fx: Fixtures) -> DataFrame:
    return _components(fx).scores(fx.cells, fx.obs).groupBy("sample_id").agg(*[F.max(F.when(V("component") == i, V("score"))).alias(f"pc{i}") for i in (1, 2)])


@query(f"SELECT i::INT AS component, {r('l')} AS variance, {r('l / (SELECT sum(c) FROM cov WHERE x = y)')} AS share FROM (SELECT 1 AS i, l FROM l1 UNION ALL SELECT 2, l FROM l2)", _components_sql(2))
def pca_variance(fx: Fixtures) -> DataFrame:
    return _components(fx).variances


@query(f"SELECT x AS feature_id, i::INT AS component, {r('w')} AS weight FROM (SELECT x, 1 AS i, w FROM w1 UNION ALL SELECT x, 2, w FROM w2)", _components_sql(2))
def pca_loadings(fx: Fixtures) -> DataFrame:
    return _components(fx).loadings


@query()
def kmeans_clusters(fx: Fixtures) -> DataFrame:
    return co.clusters(fx.dense, _features(fx), 3)


@query()
def l1_coefficients(fx: Fixtures) -> DataFrame:
    return co.l1_coefficients(fx.dense, fx.labels, _features(fx), 0.01)


@query()
def forest_importances(fx: Fixtures) -> DataFrame:
    return co.forest_importances(fx.dense, fx.labels, _features(fx))


@query()
def alr_ensemble_holdout(fx: Fixtures) -> DataFrame:
    one = nm.impute_plus_one(fx.dense)
    test = V("sample_id") % 4 == 0
    return mo.alr_ensemble(one.where(~test), one.where(test), fx.labels, {"Brand#1": 1.0, "Brand#3": 2.0, "absent": 1.0}, _features(fx), maxIter=10)


@query()
def two_stage_holdout(fx: Fixtures) -> DataFrame:
    f, test = _features(fx), V("sample_id") % 4 == 0
    model = mo.TwoStage(mo.Pipeline([], mo.classifier("tree", maxDepth=3), f), mo.Pipeline([], mo.classifier("tree", maxDepth=4), f))
    return model.fit(fx.dense.where(~test), fx.obs.select("sample_id", V("batch").alias("label")), fx.labels).predict(fx.dense.where(test))


@query()
def per_task_holdout(fx: Fixtures) -> DataFrame:
    f, test = _features(fx), V("sample_id") % 4 == 0
    tasks = {"region": fx.labels, "batch": fx.obs.select("sample_id", V("batch").alias("label"))}
    return mo.per_task(lambda: mo.Pipeline([], mo.classifier("tree", maxDepth=3), f), fx.dense.where(~test), tasks, fx.dense.where(test))


@query("SELECT term, k::INT AS rank FROM (SELECT term, row_number() OVER (ORDER BY n DESC, term) AS k FROM (SELECT parent AS term, count(*) AS n FROM edges WHERE parent <> 'all' GROUP BY 1)) WHERE k <= 3")
def parent_terms(fx: Fixtures) -> DataFrame:
    below = hi.closure(fx.edges)
    children = hi.n_children(fx.edges).where("term <> 'all'").join(hi.levels(fx.edges), "term")
    chosen = co.greedy_parents(children, below, 3)
    return fx.spark.createDataFrame([(t, i + 1) for i, t in enumerate(chosen)], "term string, rank int")


@query()
def eliminated_features(fx: Fixtures) -> DataFrame:
    return fx.spark.createDataFrame([(f,) for f in co.eliminate(fx.dense, fx.labels, _features(fx), 8)], "feature_id string")
