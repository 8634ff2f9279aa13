"""Queries of permutation tests and of cross-validation with all that a fold learns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaymill.functions.expressions import bucket_biotype, bucket_project
from assaymill.operators import contrasts as co
from assaymill.operators import evaluation as ev
from assaymill.operators import folds as fo
from assaymill.operators import models as mo
from assaymill.operators import normalise as nm
from assaymill.operators import permutation as pm
from assaymill.operators import prepare as pr
from assaymill.operators import sampling as sp
from assaymill.operators import selection as se
from assaymill.plans.fixtures import Fixtures
from assaymill.plans.model_queries import FOLDS, GINIS
from assaymill.plans.registry import query, r

V = F.col
ROUNDS = 100

PERMUTED = f"""prm AS (SELECT k, sample_id, row_number() OVER (PARTITION BY k ORDER BY md5('0|' || k || '|' || sample_id), sample_id) <= (SELECT count(*) FROM obs WHERE label = 'ASIA') AS i FROM obs CROSS JOIN (SELECT unnest(range(1, {ROUNDS + 1})) AS k) UNION ALL SELECT 0, sample_id, label = 'ASIA' FROM obs),
wlc AS MATERIALIZED (SELECT k, feature_id, round((s1 / n1 - s2 / n2) / nullif(sqrt(greatest((q1 - s1 * s1 / n1) / (n1 - 1) / n1 + (q2 - s2 * s2 / n2) / (n2 - 1) / n2, 0)), 0), 9) AS t FROM (SELECT k, feature_id, count(*) FILTER (WHERE i)::DOUBLE AS n1, count(*) FILTER (WHERE NOT i)::DOUBLE AS n2, sum(CASE WHEN i THEN value ELSE 0 END) AS s1, sum(CASE WHEN i THEN 0 ELSE value END) AS s2, sum(CASE WHEN i THEN value * value ELSE 0 END) AS q1, sum(CASE WHEN i THEN 0 ELSE value * value END) AS q2 FROM dense JOIN prm USING (sample_id) GROUP BY 1, 2)),
see AS (SELECT feature_id, t FROM wlc WHERE k = 0), prd AS (SELECT * FROM wlc WHERE k > 0)"""


@query(f"SELECT feature_id, {r('t')} AS t, {r(f'(1 + (SELECT count(*) FROM prd d WHERE d.feature_id = see.feature_id AND abs(d.t) >= abs(see.t))) / {ROUNDS + 1}.0')} AS p, {r(f'(1 + (SELECT count(*) FROM (SELECT k, max(abs(t)) AS m FROM prd GROUP BY 1) WHERE m >= abs(see.t))) / {ROUNDS + 1}.0')} AS p_max FROM see", PERMUTED)
def permuted_max_t(fx: Fixtures) -> DataFrame:
    return pm.max_t(*pm.permuted_t(fx.cells, fx.obs, "label", "ASIA", ROUNDS))


@query(f"SELECT set_name, {r('m')} AS mean_t, {r(f'(1 + count(*) FILTER (WHERE abs(d.x) >= abs(m))) / {ROUNDS + 1}.0')} AS p FROM (SELECT set_name, round(avg(t), 9) AS m FROM see JOIN sets USING (feature_id) GROUP BY 1) JOIN (SELECT set_name, k, round(avg(t), 9) AS x FROM prd JOIN sets USING (feature_id) GROUP BY 1, 2) d USING (set_name) GROUP BY 1, 2", PERMUTED)
def set_mean_diff_p(fx: Fixtures) -> DataFrame:
    return pm.set_mean_p(*pm.permuted_t(fx.cells, fx.obs, "label", "ASIA", ROUNDS), fx.sets)


_TRAIN = "trn AS (SELECT f.fold, fld.sample_id, label FROM fld JOIN (SELECT unnest(range(3))::INT AS fold) f ON f.fold <> fld.fold)"
_UNDER = "und AS (SELECT fold, sample_id, label FROM (SELECT *, min(n) OVER (PARTITION BY fold) AS least FROM (SELECT *, count(*) OVER (PARTITION BY fold, label) AS n, row_number() OVER (PARTITION BY fold, label ORDER BY md5('0|' || fold || '|' || sample_id), sample_id) AS i FROM trn)) WHERE i <= least)"
_SCALE = "scl AS (SELECT a.fold, d.feature_id, avg(d.value) AS m, stddev_pop(d.value) AS s FROM und a JOIN dense d USING (sample_id) GROUP BY 1, 2), val AS MATERIALIZED (SELECT w.fold, d.sample_id, d.feature_id, w.label, coalesce((d.value - m) / nullif(s, 0), 0) AS value FROM und w JOIN dense d USING (sample_id) JOIN scl ON scl.fold = w.fold AND scl.feature_id = d.feature_id), tst AS MATERIALIZED (SELECT fld.fold, d.sample_id, d.feature_id, coalesce((d.value - m) / nullif(s, 0), 0) AS value FROM fld JOIN dense d USING (sample_id) JOIN scl ON scl.fold = fld.fold AND scl.feature_id = d.feature_id)"
_BEST = "fst AS (SELECT fold, feature_id, row_number() OVER (PARTITION BY fold ORDER BY f DESC, feature_id) AS place FROM (SELECT fold, feature_id, round(coalesce(sum(n * (m - g) ** 2) * (sum(n) - count(*)) / nullif(sum(n * v) * (count(*) - 1), 0), CASE WHEN sum(n * (m - g) ** 2) > 1e-12 THEN 'inf'::DOUBLE ELSE 0 END), 9) AS f FROM (SELECT *, sum(n * m) OVER w / sum(n) OVER w AS g FROM (SELECT fold, feature_id, label, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM val GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY fold, feature_id)) GROUP BY 1, 2))"
_BAYES = "prd AS (SELECT fold, sample_id, label AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY fold, sample_id ORDER BY d, label) AS i FROM (SELECT t.fold, t.sample_id, c.label, round(sum((t.value - c.m) ** 2 / c.v + ln(c.v)) - 2 * ln(max(c.n)), 6) AS d FROM tst t JOIN fst ON fst.fold = t.fold AND fst.feature_id = t.feature_id AND place <= 10 JOIN (SELECT fold, label, feature_id, avg(value) AS m, var_pop(value) + 1e-3 AS v, count(*) AS n FROM val GROUP BY 1, 2, 3) c ON c.fold = t.fold AND c.feature_id = t.feature_id GROUP BY 1, 2, 3)) WHERE i = 1)"
_CURVE = "crv AS (SELECT n_features, fold, avg((label = prediction)::INT) AS accuracy FROM (SELECT *, row_number() OVER (PARTITION BY n_features, fold, sample_id ORDER BY d, prediction) AS i FROM (SELECT n.n_features, t.fold, t.sample_id, c.label AS prediction, round(sum((t.value - c.m) ** 2), 6) AS d FROM tst t JOIN fst ON fst.fold = t.fold AND fst.feature_id = t.feature_id JOIN (SELECT unnest([2, 5, 10, 25]) AS n_features) n ON place <= n.n_features JOIN (SELECT fold, label, feature_id, avg(value) AS m FROM val GROUP BY 1, 2, 3) c ON c.fold = t.fold AND c.feature_id = t.feature_id GROUP BY 1, 2, 3, 4)) JOIN obs USING (sample_id) WHERE i = 1 GROUP BY 1, 2)"


def _folds(fx: Fixtures) -> DataFrame:
    return sp.stratified_kfold(fx.labels, "sample_id", "label", 3).select("sample_id", "fold")


@query("SELECT fold, sample_id, label AS truth, prediction FROM prd JOIN obs USING (sample_id)", FOLDS, _TRAIN, _UNDER, _SCALE, _BEST, _BAYES)
def cv_pipeline(fx: Fixtures) -> DataFrame:
    """Balance, scaling, the ten best features and a Gaussian model, all learned fold by fold."""
    return fo.cross_validate(fx.dense, fx.labels, _folds(fx), 3, [fo.undersampled(), fo.scaled, fo.selected(10)], "gaussian")


@query(f"SELECT n_features::INT AS n_features, fold, {r('accuracy')} AS accuracy FROM crv", FOLDS, _TRAIN, _UNDER, _SCALE, _BEST, _CURVE)
def cv_feature_curve(fx: Fixtures) -> DataFrame:
    return fo.feature_curve(fx.dense, fx.labels, _folds(fx), 3, [2, 5, 10, 25], [fo.undersampled(), fo.scaled])


@query(f"SELECT n_features::INT AS n_features, {r('a')} AS accuracy FROM (SELECT n_features, round(avg(accuracy), 9) AS a FROM crv GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)", FOLDS, _TRAIN, _UNDER, _SCALE, _BEST, _CURVE)
def cv_best_size(fx: Fixtures) -> DataFrame:
    return fo.best_size(fo.feature_curve(fx.dense, fx.labels, _folds(fx), 3, [2, 5, 10, 25], [fo.undersampled(), fo.scaled]))


_NEAREST = "prd AS (SELECT fold, sample_id, label AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY fold, sample_id ORDER BY d, label) AS i FROM (SELECT t.fold, t.sample_id, c.label, round(sum((t.value - c.m) ** 2), 6) AS d FROM tst t JOIN fst ON fst.fold = t.fold AND fst.feature_id = t.feature_id AND place <= 8 JOIN (SELECT fold, label, feature_id, avg(value) AS m FROM val GROUP BY 1, 2, 3) c ON c.fold = t.fold AND c.feature_id = t.feature_id GROUP BY 1, 2, 3)) WHERE i = 1)"
_SPEC_SCALE = _SCALE.replace("JOIN dense d", "JOIN (SELECT sample_id, feature_id, ln(1 + CASE WHEN value = 0 THEN 1.0 ELSE value END) AS value FROM dense WHERE feature_id <> 'Brand#1') d")


@query("SELECT fold, sample_id, label AS truth, prediction FROM prd JOIN obs USING (sample_id)", FOLDS, _TRAIN, _UNDER, _SPEC_SCALE, _BEST, _NEAREST)
def cv_from_spec(fx: Fixtures) -> DataFrame:
    """A whole pipeline from its description."""
    spec = {"blacklist": ["Brand#1"], "impute": "replace_one", "transform": "log1p", "balance": "undersample", "scale": True, "features": 8, "model": "centroid"}
    return fo.from_spec(spec)(fx.dense, fx.labels, _folds(fx), 3)


# prototypes, curves, ranges and small tools ------------------------------------------------------

def _prototype_sql(rounds: int) -> str:
    ctes = ["bal AS MATERIALIZED (SELECT a.sample_id, b.sample_id AS other, p.label, p.label <> q.label AS far FROM dense a JOIN dense b USING (feature_id) JOIN obs p ON p.sample_id = a.sample_id JOIN obs q ON q.sample_id = b.sample_id GROUP BY 1, 2, 3, 4 HAVING round(sqrt(sum((a.value - b.value) ** 2)), 9) <= 200)", "pri AS (SELECT sample_id, label, count(*) FILTER (WHERE far) AS price FROM bal GROUP BY 1, 2)", "u1 AS (SELECT * FROM bal WHERE NOT far)"]
    for i in range(1, rounds + 1):
        ctes.append(f"c{i} AS MATERIALIZED (SELECT label, sample_id, {i} AS rank, gain FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY gain DESC, sample_id) AS k FROM (SELECT label, sample_id, count(*) - any_value(price) AS gain FROM u{i} JOIN pri USING (sample_id, label) GROUP BY 1, 2) WHERE gain > 0) WHERE k = 1)")
        ctes.append(f"u{i + 1} AS MATERIALIZED (SELECT * FROM u{i} WHERE other NOT IN (SELECT other FROM bal JOIN c{i} USING (sample_id) WHERE NOT far))")
    return ", ".join(ctes)


@query("SELECT label, sample_id, rank::INT AS rank, gain FROM (" + " UNION ALL ".join(f"SELECT * FROM c{i}" for i in (1, 2, 3)) + ")", _prototype_sql(3))
def class_prototypes(fx: Fixtures) -> DataFrame:
    return mo.prototypes(fx.cells, fx.obs, "label", 200.0)


@query(f"SELECT class, {r('avg(a)')} AS mean, {r('min(a)')} AS least, {r('max(a)')} AS largest, count(*) AS n FROM (SELECT fold, class, avg(CASE WHEN x.score > y.score THEN 1.0 WHEN x.score = y.score THEN 0.5 ELSE 0 END) AS a FROM (SELECT fold, class, score FROM scores JOIN pred USING (sample_id) WHERE truth = class) x JOIN (SELECT fold, class, score FROM scores JOIN pred USING (sample_id) WHERE truth <> class) y USING (fold, class) GROUP BY 1, 2) GROUP BY 1")
def auroc_folds(fx: Fixtures) -> DataFrame:
    """Mean, least and largest area under the curves of the folds."""
    return ev.auroc_spread(ev.curve_points(fx.pred, fx.scores, ["fold"]), "fold")


@query(f"SELECT feature_id, count(*) AS n_intervals, {r('avg(gini)')} AS mean_gini FROM gns WHERE gini < 0.6 GROUP BY 1", GINIS)
def informative_gini(fx: Fixtures) -> DataFrame:
    return co.informative_gini(se.pure_intervals(se.range_gini(fx.cells, fx.obs, "label", 7), 0.6))


_DRAW = "sqrt(-2 * ln((('0x' || md5('0|a|' || sample_id)[1:8])::BIGINT + 1) / 4294967297.0)) * cos(2 * pi() * ('0x' || md5('0|b|' || sample_id)[1:8])::BIGINT / 4294967296.0)"


@query(f"SELECT d.sample_id, d.feature_id, {r('log2(d.value + 1) - log2(e.value + 1) + 0.5 * x.z + log2(3.0)')} AS value FROM dense d JOIN dense e ON e.sample_id = d.sample_id AND e.feature_id = 'Brand#1' JOIN (SELECT sample_id, {_DRAW} AS z FROM obs) x ON x.sample_id = d.sample_id WHERE d.feature_id <> 'Brand#1'")
def alr_scaled(fx: Fixtures) -> DataFrame:
    return nm.alr_scaled(nm.impute_plus_one(fx.dense), "Brand#1", fx.obs.select("sample_id", F.lit(3.0).alias("scale")), 0.5)


@query("SELECT CASE WHEN p_type LIKE 'PROMO%' THEN 'offer' ELSE p_type END AS p_type, count(*) AS n FROM part GROUP BY 1")
def replace_values(fx: Fixtures) -> DataFrame:
    kinds = fx.read("part").select("p_type").distinct().where(V("p_type").startswith("PROMO")).select(V("p_type").alias("old"), F.lit("offer").alias("new"))
    return pr.replace_values(fx.read("part").select("p_partkey", "p_type"), "p_type", kinds).groupBy("p_type").agg(F.count("*").alias("n"))


@query(f"SELECT p_partkey, CASE WHEN p_size = 25 THEN NULL ELSE {r('1.0 / (p_size - 25)')} END AS value FROM part")
def null_infinite(fx: Fixtures) -> DataFrame:
    odd = fx.read("part").select("p_partkey", F.when(V("p_size") == 25, float("inf")).otherwise(F.try_divide(F.lit(1.0), V("p_size") - 25)).alias("value"))
    return pr.null_infinite(odd)[0]


@query("SELECT CASE WHEN starts_with(id, 'TCGA') THEN 'TCGA' WHEN starts_with(id, 'GSE') THEN 'GSE' ELSE 'other' END AS project, count(*) AS n FROM (SELECT CASE c_nationkey % 3 WHEN 0 THEN 'TCGA-' WHEN 1 THEN 'GSE' ELSE 'own' END || c_custkey AS id FROM customer) GROUP BY 1")
def bucket_projects(fx: Fixtures) -> DataFrame:
    kind = F.when(V("c_nationkey") % 3 == 0, "TCGA-").when(V("c_nationkey") % 3 == 1, "GSE").otherwise("own")
    return fx.read("customer").select(bucket_project(F.concat(kind, V("c_custkey").cast("string"))).alias("project")).groupBy("project").agg(F.count("*").alias("n"))


@query("SELECT CASE p_size % 4 WHEN 0 THEN 'protein_coding' WHEN 1 THEN 'pseudogene' WHEN 2 THEN 'lncRNA' ELSE 'other' END AS biotype, count(*) AS n FROM part GROUP BY 1")
def bucket_biotypes(fx: Fixtures) -> DataFrame:
    kind = F.when(V("p_size") % 4 == 0, "protein_coding").when(V("p_size") % 4 == 1, "processed_pseudogene").when(V("p_size") % 4 == 2, "lincRNA").otherwise("TEC")
    return fx.read("part").select(bucket_biotype(kind).alias("biotype")).groupBy("biotype").agg(F.count("*").alias("n"))
