"""Queries of files, encodings, tables of trials and curves, bootstrap batches and chained selection."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaymill.operators import contrasts as co
from assaymill.operators import evaluation as ev
from assaymill.operators import models as mo
from assaymill.operators import negbin as nb
from assaymill.operators import normalise as nm
from assaymill.operators import prepare as pr
from assaymill.operators import sampling as sp
from assaymill.operators import selection as se
from assaymill.operators import summaries as sm
from assaymill.plans.fixtures import Fixtures
from assaymill.plans.matrix_queries import BULK, _bulk
from assaymill.plans.model_queries import CONTRIB, _contrib, _features
from assaymill.plans.registry import query, r
from assaymill.sources import counts as src
from assaymill.storage import scratch_dir

V = F.col

# files -----------------------------------------------------------------------------------------


def _folder(fx: Fixtures) -> str:
    return f"{scratch_dir(fx.spark)}/files-{uuid.uuid4().hex}"


@query("SELECT feature_id, sum(value) AS value FROM bulk GROUP BY 1", BULK)
def read_count_files(fx: Fixtures) -> DataFrame:
    """One tab-separated count file per region, written from the cells with a summary row, and read together."""
    path = _folder(fx)
    number = V("value").cast("long")
    rows = _bulk(fx).select(V("feature_id").alias("gene_id"), V("sample_id").alias("gene_name"), F.lit("brand").alias("gene_type"), number.alias("unstranded"), number.alias("stranded_first"), number.alias("stranded_second"), F.lit(0.0).alias("tpm_unstranded"))
    summary = rows.limit(1).withColumns({"gene_id": F.lit("N_unmapped"), "unstranded": F.lit(10**6).cast("long")})
    rows.union(summary).write.csv(path, sep="\t", header=True)
    return src.read_count_files(fx.spark, path).groupBy("feature_id").agg(F.sum("value").alias("value"))


@query("SELECT feature_id, count(*) AS n FROM sets GROUP BY 1")
def read_feature_lists(fx: Fixtures) -> DataFrame:
    path = _folder(fx)
    src.write_table(fx.sets.select(V("feature_id").alias("value")), path, "text")
    return src.read_feature_lists(fx.spark, path).groupBy("feature_id").agg(F.count("*").alias("n"))


@query(f"SELECT model, fold, metric, {r('value')} AS value FROM results")
def gather_results(fx: Fixtures) -> DataFrame:
    """One folder of result files per model, the models of a comparison being few."""
    path = _folder(fx)
    wide = fx.results.groupBy("model", "fold").pivot("metric", ["accuracy", "error"]).agg(F.first("value"))
    for model in ("m0", "m1", "m2", "m3"):
        src.write_table(wide.where(V("model") == model).select("fold", "accuracy", "error"), f"{path}/{model}", "csv")
    return src.gather_results(fx.spark, f"{path}/*/*.csv", "fold int, accuracy double, error double", ["accuracy", "error"])


@query("SELECT p_partkey, p_brand, p_size FROM part")
def read_mapping(fx: Fixtures) -> DataFrame:
    path = _folder(fx)
    fx.read("part").select("p_partkey", "p_brand", "p_size").write.csv(path, sep="\t", header=True)
    return src.read_mapping(fx.spark, path, "p_partkey long, p_brand string, p_size int")


@query("SELECT s_suppkey AS id, s_name AS name, s_nationkey AS nation FROM supplier UNION ALL SELECT c_custkey, c_name, c_nationkey FROM customer")
def harmonise(fx: Fixtures) -> DataFrame:
    one, two = {"s_suppkey": "id", "s_name": "name", "s_nationkey": "nation"}, {"c_custkey": "id", "c_name": "name", "c_nationkey": "nation"}
    return src.harmonise([(fx.read("supplier").withColumnsRenamed(one), {}), (fx.read("customer").withColumnsRenamed(two), {})], "id").select("id", "name", "nation")


@query("SELECT n_nationkey, k::INT AS round FROM nation CROSS JOIN (SELECT unnest(range(2)) AS k)")
def cached_rounds(fx: Fixtures) -> DataFrame:
    return src.cached_rounds(fx.spark, _folder(fx), 2, lambda i: fx.read("nation").select("n_nationkey")).select("n_nationkey", "round")


# encodings and masks ---------------------------------------------------------------------------

PAIRS = "prs AS (SELECT DISTINCT a.feature_id AS x, b.feature_id AS y FROM sets a JOIN sets b ON a.set_name = b.set_name AND a.feature_id < b.feature_id)"


@query("SELECT o.sample_id, x, y, (coalesce(a.value, 0) > coalesce(b.value, 0))::INT AS value FROM obs o CROSS JOIN prs LEFT JOIN cells a ON a.sample_id = o.sample_id AND a.feature_id = x LEFT JOIN cells b ON b.sample_id = o.sample_id AND b.feature_id = y", PAIRS)
def encode_pairs(fx: Fixtures) -> DataFrame:
    """All pairs of features that share a set."""
    one = fx.sets.select("set_name", V("feature_id").alias("x"))
    return nm.encode_pairs(fx.cells, fx.obs, one.join(one.withColumnRenamed("x", "y"), "set_name").where("x < y").select("x", "y").distinct())


@query(f"SELECT class, d.sample_id, d.feature_id, {r('CASE WHEN x < 0 THEN 0.0 ELSE value END')} AS value FROM dense d JOIN con USING (sample_id, feature_id)", CONTRIB)
def mask_negative(fx: Fixtures) -> DataFrame:
    return pr.mask_negative(fx.dense, _contrib(fx), ["class"])


@query(f"SELECT sample_id, feature_id, {r('ln(value + 2)')} AS value FROM dense")
def chained_steps(fx: Fixtures) -> DataFrame:
    return nm.chain(fx.dense, [nm.impute_plus_one, lambda d: d.withColumn("value", F.log1p("value"))])


# summaries -------------------------------------------------------------------------------------


@query("SELECT p_type AS set_name, count(DISTINCT p_brand) AS size, arg_min(p_name, p_partkey) AS source FROM part GROUP BY 1")
def set_metadata(fx: Fixtures) -> DataFrame:
    return sm.set_metadata(fx.read("part").select(V("p_type").alias("set_name"), V("p_brand").alias("feature_id"), V("p_name").alias("source"), "p_partkey"), "p_partkey")


@query(f"SELECT c_custkey AS n, c_mktsegment AS segment, c_nationkey::VARCHAR AS nation, {r('c_acctbal')} AS objective FROM customer")
def trial_table(fx: Fixtures) -> DataFrame:
    each = F.explode(F.array(F.struct(F.lit("segment").alias("param"), V("c_mktsegment").alias("value")), F.struct(F.lit("nation").alias("param"), V("c_nationkey").cast("string").alias("value"))))
    return sm.trial_table(fx.read("customer").select(V("c_custkey").alias("n"), V("c_acctbal").alias("objective"), each.alias("p")).select("n", "objective", "p.*"), ["segment", "nation"])


STEPS = "stp AS (SELECT o_orderpriority, o_custkey, o_orderkey, o_totalprice / 1000 AS o_totalprice, row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_orderkey)::INT AS step FROM orders)"


def _steps(fx: Fixtures) -> DataFrame:
    return sm.curve_steps(fx.read("orders").select("o_orderpriority", "o_custkey", "o_orderkey", (V("o_totalprice") / 1000).alias("o_totalprice")), ["o_orderpriority", "o_custkey"], ["o_orderkey"])


@query(f"SELECT o_orderkey, step, {r('o_totalprice')} AS o_totalprice FROM stp", STEPS)
def curve_steps(fx: Fixtures) -> DataFrame:
    return _steps(fx).select("o_orderkey", "step", "o_totalprice")


@query(f"SELECT o_orderpriority, step, {r('avg(o_totalprice)')} AS mean, {r('var_samp(o_totalprice)')} AS var, count(*) AS n FROM stp GROUP BY 1, 2", STEPS)
def average_curves(fx: Fixtures) -> DataFrame:
    return sm.average_curves(_steps(fx), ["o_orderpriority"], "o_totalprice")


@query(f"SELECT p_brand, {r('(a - avg(a) OVER ()) / stddev_samp(a) OVER ()')} AS size, {r('(b - avg(b) OVER ()) / stddev_samp(b) OVER ()')} AS price FROM (SELECT p_brand, sum(p_size)::DOUBLE AS a, sum(p_retailprice) AS b FROM part GROUP BY 1)")
def z_columns(fx: Fixtures) -> DataFrame:
    return sm.z_columns(fx.read("part").groupBy("p_brand").agg(F.sum("p_size").cast("double").alias("size"), F.sum("p_retailprice").alias("price")), "p_brand", ["size", "price"])


@query(f"SELECT p_brand, {r('avg(p_retailprice)')} AS mean, {r('sum(p_retailprice)')} AS sum, {r('median(p_retailprice)')} AS median, {r('stddev_samp(p_retailprice)')} AS std, {r('var_samp(p_retailprice)')} AS var, {r('min(p_retailprice)')} AS min, {r('max(p_retailprice)')} AS max, count(p_retailprice) AS count FROM part GROUP BY 1")
def aggregate_by_name(fx: Fixtures) -> DataFrame:
    return sm.aggregate_by_name(fx.read("part"), ["p_brand"], "p_retailprice", list(sm.AGGREGATES))


OUTLIERS = "mid AS (SELECT median(c_acctbal) AS m FROM customer), md AS (SELECT median(abs(c_acctbal - m)) AS d, any_value(m) AS m FROM customer, mid), fl AS (SELECT c_custkey AS sample_id FROM customer, md WHERE abs(c_acctbal - m) > 1.7 * d), spl AS (SELECT 'asia' AS split, CASE WHEN label = 'ASIA' THEN 'test' ELSE 'train' END AS role, sample_id, label FROM obs UNION ALL SELECT 'b0', CASE WHEN batch = 'b0' THEN 'test' ELSE 'train' END, sample_id, label FROM obs)"


@query("SELECT split, role, label, count(*) FILTER (WHERE sample_id IN (SELECT sample_id FROM fl)) AS outliers, count(*) AS n FROM spl GROUP BY 1, 2, 3", OUTLIERS)
def outlier_table(fx: Fixtures) -> DataFrame:
    flags = se.mad_outliers(fx.read("customer").withColumnRenamed("c_custkey", "sample_id"), "sample_id", ["c_acctbal"], 1.7)
    return sm.outlier_table(flags, pr.named_splits(fx.obs, {"asia": V("label") == "ASIA", "b0": V("batch") == "b0"}), fx.obs, "label")


@query("SELECT p_partkey, rank() OVER (ORDER BY p_size DESC)::INT AS rank FROM part")
def rank_by(fx: Fixtures) -> DataFrame:
    return se.rank_by(fx.read("part"), [F.desc("p_size")]).select("p_partkey", "rank")


@query("SELECT l_orderkey, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem) WHERE k = 1")
def keep_first(fx: Fixtures) -> DataFrame:
    return sm.keep_first(fx.read("lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_partkey")


@query(f"SELECT model || '_' || fold AS name, {r('value')} AS accuracy FROM results WHERE metric = 'accuracy' AND NOT (model = 'm0' AND fold = 0)")
def make_grid(fx: Fixtures) -> DataFrame:
    """The grid of models and folds without a forbidden pair, and what each scored."""
    grid = ev.parameter_grid(fx.spark, {"model": ["m0", "m1", "m2", "m3"], "fold": list(range(5))}, (V("model") == "m0") & (V("fold") == 0))
    scored = fx.results.where("metric = 'accuracy'").select("model", "fold", V("value").alias("accuracy"))
    return grid.join(scored, ["model", "fold"]).select("name", "accuracy")


@query(f"SELECT label, feature_id, {r('i')} AS inside, {r('o')} AS outside, {r('i / o')} AS ratio, {r('i - o')} AS difference FROM (SELECT label, feature_id, avg(value) FILTER (WHERE batch = 'b0') AS i, avg(value) FILTER (WHERE batch = 'b1') AS o FROM dense JOIN obs USING (sample_id) GROUP BY 1, 2 HAVING sum(value) > 0)")
def type_ratios(fx: Fixtures) -> DataFrame:
    return co.type_ratios(fx.cells, fx.obs, "label", "batch", "b0")


# ranges ----------------------------------------------------------------------------------------

HIGH = "hgh AS (SELECT label, feature_id, count(*) AS n FROM cells JOIN obs USING (sample_id) WHERE value >= 60 GROUP BY 1, 2), ttl AS (SELECT label, count(*) AS t FROM obs GROUP BY 1), kpt AS (SELECT hgh.* FROM hgh JOIN ttl USING (label) WHERE n >= 0.12 * t)"


def _kept_ranges(fx: Fixtures) -> DataFrame:
    ranges = fx.cells.where("value >= 60").join(fx.labels, "sample_id").groupBy("label", "feature_id").agg(F.count("*").alias("n"))
    return co.reject_ranges(ranges, fx.obs.groupBy("label").agg(F.count("*").alias("n")), 0.12)


@query("SELECT label, feature_id, n FROM kpt", HIGH)
def reject_ranges(fx: Fixtures) -> DataFrame:
    return _kept_ranges(fx).select("label", "feature_id", "n")


@query("SELECT label, string_agg(feature_id, ',' ORDER BY feature_id) AS features, count(*) AS n_ranges FROM kpt GROUP BY 1", HIGH)
def informative_ranges(fx: Fixtures) -> DataFrame:
    return co.informative(_kept_ranges(fx))


@query()
def range_mask_holdout(fx: Fixtures) -> DataFrame:
    """A model that sees values inside their feature's range alone."""
    ranges = fx.var.select("feature_id", F.lit(45.0).alias("lo"), F.lit(120.0).alias("hi"))
    test = V("sample_id") % 4 == 0
    model = mo.Pipeline([mo.masked(ranges, "mean")], mo.classifier("svc", maxIter=5), _features(fx))
    return model.fit(fx.cells.where(~test), fx.labels).predict(fx.cells.where(test))


@query()
def boosted_holdout(fx: Fixtures) -> DataFrame:
    test = V("sample_id") % 4 == 0
    batches = fx.obs.select("sample_id", V("batch").alias("label"))
    return mo.Pipeline([], mo.classifier("boosted", maxIter=3, maxDepth=3), _features(fx)).fit(fx.cells.where(~test), batches).predict(fx.cells.where(test))


# selection and samples -------------------------------------------------------------------------

COEFS = "cof AS (SELECT l_returnflag AS class, l_suppkey AS feature_id, round(avg(l_discount) - 0.05, 9) AS coef FROM lineitem GROUP BY 1, 2)"


def _coefs(fx: Fixtures) -> DataFrame:
    return fx.read("lineitem").groupBy(V("l_returnflag").alias("class"), V("l_suppkey").alias("feature_id")).agg(F.round(F.avg("l_discount") - 0.05, 9).alias("coef"))


@query(f"SELECT feature_id, {r('s')} AS score FROM (SELECT feature_id, avg(abs(coef)) AS s FROM cof GROUP BY 1) ORDER BY s DESC, feature_id LIMIT 5", COEFS)
def top_l1(fx: Fixtures) -> DataFrame:
    return se.top_l1(_coefs(fx), 5)


@query(f"SELECT class, feature_id, {r('coef')} AS coef FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY abs(coef) DESC, feature_id) AS k FROM cof WHERE coef <> 0) WHERE k <= 3", COEFS)
def top_l1_per_class(fx: Fixtures) -> DataFrame:
    return se.top_l1(_coefs(fx), 3, per_class=True)


@query(f"SELECT class, feature_id, {r('coef')} AS importance FROM cof WHERE coef > 0", COEFS)
def nonzero_importance(fx: Fixtures) -> DataFrame:
    return se.nonzero_importance(_coefs(fx).withColumnRenamed("coef", "importance"))


@query("SELECT feature_id FROM (SELECT feature_id, sum(value) AS s FROM cells WHERE feature_id IN (SELECT feature_id FROM (SELECT feature_id, round(var_pop(value), 6) AS v FROM dense GROUP BY 1) ORDER BY v DESC, feature_id LIMIT 15) GROUP BY 1) ORDER BY s DESC, feature_id LIMIT 8")
def chained_selectors(fx: Fixtures) -> DataFrame:
    spread = lambda c: se.variances(c, fx.n).select("feature_id", F.round("variance", 6).alias("score"))
    total = lambda c: c.groupBy("feature_id").agg(F.sum("value").alias("score"))
    return se.chain_selectors(fx.cells, [(spread, 15), (total, 8)])


@query("SELECT c_custkey, batch, copy::INT AS copy FROM (SELECT c_custkey, b::INT AS batch, unnest(range(1, 1 + list_count(list_filter([0.22313016, 0.557825401, 0.808846832, 0.934357546, 0.981424064, 0.99554402, 0.999074009, 0.999830435, 0.999972265, 0.999995903, 0.999999449, 0.999999932, 0.999999992, 0.999999999], lambda t: t <= ('0x' || left(md5('0|' || b || '|' || c_custkey), 8))::BIGINT / 4294967296.0)))) AS copy FROM customer CROSS JOIN (SELECT unnest(range(3)) AS b))")
def poisson_batches(fx: Fixtures) -> DataFrame:
    return sp.poisson_batches(fx.read("customer").select("c_custkey"), "c_custkey", 3, 1.5)


@query()
def near_candidates(fx: Fixtures) -> DataFrame:
    return sp.near_candidates(nm.into_ranks(fx.dense), fx.obs)


@query()
def quantile_batch_mean(fx: Fixtures) -> DataFrame:
    return nb.fit(fx.cells, fx.obs, "batch", to_mean=True).adjust(fx.dense)


@query("SELECT batch, grp, feature_id, " + r("s / n") + " AS mean FROM (SELECT batch, '' AS grp, feature_id, sum(value) AS s, count(*) AS n, min(sum(value)) OVER (PARTITION BY feature_id) AS least FROM dense JOIN obs USING (sample_id) GROUP BY 1, 2, 3) WHERE least > 0")
def batch_means(fx: Fixtures) -> DataFrame:
    """Fitted means without groups are the batches' own."""
    return nb.fit(fx.cells, fx.obs, "batch").means.select("batch", "grp", "feature_id", V("mu").alias("mean"))
