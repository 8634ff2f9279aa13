"""Queries of sources, filters, normalisation, correction, summaries and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaymill.functions.expressions import clean_label
from assaymill.operators import normalise as nm
from assaymill.operators import prepare as pr
from assaymill.operators import summaries as sm
from assaymill.plans.fixtures import Fixtures
from assaymill.plans.registry import query, r
from assaymill.sources import counts as src

V = F.col
VALUE = f"SELECT sample_id, feature_id, {r('x')} AS value FROM "

# sources ---------------------------------------------------------------------------------------


@query("SELECT sample_id, feature_id, value, label, batch FROM cells JOIN obs USING (sample_id)")
def collect_counts(fx: Fixtures) -> DataFrame:
    files = fx.cells.withColumn("file", V("sample_id").cast("string"))
    sheet = fx.obs.select(V("sample_id").cast("string").alias("file"), V("nation").alias("case_id"), "batch").distinct()
    cases = fx.obs.select(V("nation").alias("case_id"), "label").distinct()
    return src.collect_counts(files, sheet, cases)[0].select("sample_id", "feature_id", "value", "label", "batch")


@query("SELECT label AS sample_id, feature_id, sum(value) AS value FROM dense JOIN obs USING (sample_id) GROUP BY 1, 2")
def wide_to_long(fx: Fixtures) -> DataFrame:
    regions = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    wide = fx.cells.join(fx.labels, "sample_id").groupBy("feature_id").pivot("label", regions).agg(F.sum("value")).fillna(0.0)
    return src.wide_to_long(wide, "feature_id", regions).select("sample_id", "feature_id", "value")


REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
BULK = "bulk AS (SELECT label AS sample_id, feature_id, sum(value) AS value FROM cells JOIN obs USING (sample_id) GROUP BY 1, 2)"


def _bulk(fx: Fixtures) -> DataFrame:
    return src.pseudobulk(fx.cells, fx.obs, V("label")).withColumnRenamed("group_id", "sample_id")


@query("SELECT feature_id, " + ", ".join(f"coalesce(max(value) FILTER (WHERE sample_id = '{x}'), 0.0) AS s{i}" for i, x in enumerate(REGIONS)) + " FROM bulk GROUP BY 1", BULK)
def long_to_wide(fx: Fixtures) -> DataFrame:
    return src.long_to_wide(_bulk(fx), REGIONS).toDF("feature_id", *[f"s{i}" for i in range(5)])


@query("SELECT feature_id, " + ", ".join(f"max(value) FILTER (WHERE sample_id = '{x}') AS \"region_{x}\"" for x in REGIONS) + " FROM bulk GROUP BY 1", BULK)
def wide_export(fx: Fixtures) -> DataFrame:
    projects = fx.obs.select(V("label").alias("sample_id"), F.lit("region").alias("project")).distinct()
    return src.wide_export(_bulk(fx), projects, "project", "feature_id", [f"region_{x}" for x in REGIONS])


@query("""SELECT case_key, CASE WHEN b AND c THEN 'BC' WHEN b THEN 'B' WHEN c THEN 'C' ELSE 'none' END AS available, n_files FROM (
  SELECT regexp_replace(regexp_replace(p_name || '#' || p_brand || p_size, '^[^#]*#', ''), '[0-9]+$', '') AS case_key, bool_or(regexp_matches(p_brand || p_size, '[0-4]$')) AS b, bool_or(regexp_matches(p_brand || p_size, '[5-9]$')) AS c, count(*) AS n_files FROM part GROUP BY 1)""")
def sample_inventory(fx: Fixtures) -> DataFrame:
    return src.sample_inventory(fx.read("part").select(F.concat("p_name", F.lit("#"), "p_brand", V("p_size").cast("string")).alias("name")))


@query("SELECT label AS group_id, feature_id, sum(value) AS value FROM cells JOIN obs USING (sample_id) GROUP BY 1, 2")
def pseudobulk_sum(fx: Fixtures) -> DataFrame:
    return src.pseudobulk(fx.cells, fx.obs, V("label"))


@query(f"SELECT label AS group_id, feature_id, {r('sum(value) / any_value(k)')} AS value FROM cells JOIN obs USING (sample_id) JOIN (SELECT label, count(*) AS k FROM obs GROUP BY 1) USING (label) GROUP BY 1, 2")
def pseudobulk_mean(fx: Fixtures) -> DataFrame:
    return src.pseudobulk(fx.cells, fx.obs, V("label"), "mean")


@query("SELECT l_suppkey AS sample_id, sum(l_quantity) AS l_quantity, sum(l_linenumber)::BIGINT AS l_linenumber FROM lineitem GROUP BY 1")
def strand_totals(fx: Fixtures) -> DataFrame:
    return src.strand_totals(fx.read("lineitem").withColumnRenamed("l_suppkey", "sample_id"), ["l_quantity", "l_linenumber"])


# filters ---------------------------------------------------------------------------------------


@query("SELECT c_custkey FROM (SELECT c_custkey, count(*) OVER (PARTITION BY c_mktsegment) AS a, count(*) OVER (PARTITION BY c_nationkey) AS b FROM customer) WHERE a >= 60 AND a < 100000 AND b >= 60 AND b < 100000")
def filter_levels(fx: Fixtures) -> DataFrame:
    return pr.filter_levels(fx.read("customer"), ["c_mktsegment", "c_nationkey"], 60, 100000)[0].select("c_custkey")


@query("SELECT 'c_nationkey' AS key, c_nationkey::VARCHAR AS level, count(*) AS n FROM customer GROUP BY 2 HAVING count(*) < 60")
def discarded_levels(fx: Fixtures) -> DataFrame:
    return pr.filter_levels(fx.read("customer"), ["c_nationkey"], 60)[1]


@query("SELECT c.* FROM cells c JOIN (SELECT sample_id FROM cells GROUP BY 1 HAVING sum(value) >= 700 AND count(*) >= 8) USING (sample_id)")
def filter_samples_qc(fx: Fixtures) -> DataFrame:
    return pr.filter_samples(fx.cells, 700, 8)


@query("SELECT c.* FROM cells c JOIN (SELECT feature_id FROM cells GROUP BY 1 HAVING count(*) >= 0.5 * (SELECT n FROM sizes) AND sum(value) >= 3000) USING (feature_id)")
def filter_features_qc(fx: Fixtures) -> DataFrame:
    return pr.filter_features(fx.cells, fx.n, 0.5, 3000)


LIST = "list AS (SELECT unnest(['Brand#3', 'Brand#1', 'Brand#99']) AS feature_id, unnest([0, 1, 2]) AS position)"


def feature_list(fx: Fixtures) -> DataFrame:
    return fx.spark.createDataFrame([("Brand#3", 0), ("Brand#1", 1), ("Brand#99", 2)], "feature_id string, position int")


@query("SELECT o.sample_id, l.feature_id, l.position, coalesce(c.value, 0.0) AS value FROM obs o CROSS JOIN list l LEFT JOIN cells c ON c.sample_id = o.sample_id AND c.feature_id = l.feature_id", LIST)
def feature_subset(fx: Fixtures) -> DataFrame:
    return pr.subset_features(fx.cells, fx.obs, feature_list(fx))


@query("SELECT feature_id FROM list WHERE feature_id NOT IN (SELECT feature_id FROM cells)", LIST)
def missing_features(fx: Fixtures) -> DataFrame:
    return pr.missing_features(fx.cells, feature_list(fx))


@query("SELECT * FROM cells WHERE feature_id NOT IN (SELECT feature_id FROM list)", LIST)
def blacklist_features(fx: Fixtures) -> DataFrame:
    return pr.drop_features(fx.cells, feature_list(fx))


SPEC = {"label": {"ASIA": "exact"}, "nation": {"^NATION_1": "contains"}}


@query("SELECT sample_id, CASE WHEN label = 'ASIA' OR regexp_matches(nation, '^NATION_1') THEN 'test' ELSE 'train' END AS role FROM obs")
def spec_split_or(fx: Fixtures) -> DataFrame:
    return pr.spec_split(fx.obs, SPEC, True).select("sample_id", "role")


@query("SELECT sample_id, CASE WHEN label = 'ASIA' AND regexp_matches(nation, '^NATION_1') THEN 'test' ELSE 'train' END AS role FROM obs")
def spec_split_and(fx: Fixtures) -> DataFrame:
    return pr.spec_split(fx.obs, SPEC, False).select("sample_id", "role")


NAMED = "splits AS (SELECT 'asia' AS split, CASE WHEN label = 'ASIA' THEN 'test' ELSE 'train' END AS role, sample_id FROM obs UNION ALL SELECT 'b0', CASE WHEN batch = 'b0' THEN 'test' ELSE 'train' END, sample_id FROM obs)"


@query("SELECT * FROM splits", NAMED)
def named_splits(fx: Fixtures) -> DataFrame:
    return pr.named_splits(fx.obs, {"asia": V("label") == "ASIA", "b0": V("batch") == "b0"})


MAPPING = "mapping AS (SELECT p_brand AS symbol, CASE WHEN min(p_size) % 2 = 1 THEN min(p_name) END AS ensembl FROM part GROUP BY 1)"


def _mapping(fx: Fixtures) -> DataFrame:
    m = fx.read("part").groupBy(V("p_brand").alias("symbol")).agg(F.min("p_size").alias("_s"), F.min("p_name").alias("ensembl"), F.lit("Brand#7").alias("synonym"))
    return m.select("symbol", F.when(V("_s") % 2 == 1, V("ensembl")).alias("ensembl"))


@query("SELECT v.feature_id, m.ensembl AS new_id FROM (SELECT feature_id FROM var UNION SELECT 'Brand#77') v JOIN mapping m ON m.symbol = v.feature_id WHERE m.ensembl IS NOT NULL", MAPPING)
def rename_passed(fx: Fixtures) -> DataFrame:
    more = fx.var.select("feature_id").union(fx.spark.sql("SELECT 'Brand#77'"))
    return pr.rename_features(more, _mapping(fx), "symbol", "ensembl")[0]


@query("SELECT v.feature_id FROM (SELECT feature_id FROM var UNION SELECT 'Brand#77') v LEFT JOIN mapping m ON m.symbol = v.feature_id WHERE m.ensembl IS NULL", MAPPING)
def rename_failed(fx: Fixtures) -> DataFrame:
    more = fx.var.select("feature_id").union(fx.spark.sql("SELECT 'Brand#77'"))
    return pr.rename_features(more, _mapping(fx), "symbol", "ensembl")[1]


@query("SELECT p_partkey, CASE WHEN p_type LIKE 'PROMO%' THEN 'promo' WHEN p_size > 40 THEN 'large' WHEN regexp_matches(p_name, '^small') THEN 'small ring' ELSE lower(p_type) END AS class FROM part")
def classify_case(fx: Fixtures) -> DataFrame:
    rules = [(V("p_type").startswith("PROMO"), "promo"), (V("p_size") > 40, "large"), (V("p_name").rlike("^small"), "small ring")]
    return fx.read("part").select("p_partkey", pr.first_match(rules, F.lower("p_type")).alias("class"))


@query("SELECT DISTINCT replace(regexp_replace(lower(p_name), '[ -]', '_', 'g'), ',', '') AS label FROM part")
def clean_labels(fx: Fixtures) -> DataFrame:
    return fx.read("part").select(clean_label(V("p_name")).alias("label")).distinct()


@query("SELECT event_id, CASE WHEN regexp_matches(props, '\"k\": [0-4][0-9]?}') THEN 'immune (' || regexp_extract(props, '([0-9]+)', 1) || ')' WHEN contains(event_type, 'err') THEN 'err+' ELSE replace(event_type, '-positive', '+') END AS label FROM events")
def harmonise_labels(fx: Fixtures) -> DataFrame:
    rules = [(V("props").rlike('"k": [0-4][0-9]?}'), F.concat(F.lit("immune ("), F.regexp_extract("props", "([0-9]+)", 1), F.lit(")"))), (V("event_type").contains("err"), "err+")]
    return fx.read("events").select("event_id", pr.first_match(rules, F.regexp_replace("event_type", "-positive", "+")).alias("label"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), 's$', '') || CASE WHEN p_size > 25 THEN '-tme' ELSE '' END || '@' || p_brand AS set_name FROM part")
def collate_markers(fx: Fixtures) -> DataFrame:
    snake = F.regexp_replace(F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "_"), "s$", "")
    return fx.read("part").select("p_partkey", F.concat(snake, F.when(V("p_size") > 25, "-tme").otherwise(""), F.lit("@"), V("p_brand")).alias("set_name"))


@query(f"SELECT feature_id, {r('length / 100')} AS length, biotype FROM (SELECT DISTINCT feature_id FROM cells) JOIN var USING (feature_id)")
def annotate_features(fx: Fixtures) -> DataFrame:
    return pr.annotate_features(fx.cells.select("feature_id").distinct(), fx.var, ["length"])


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey = 3 AND c_acctbal > 0")
def compound_filter(fx: Fixtures) -> DataFrame:
    return fx.read("customer").where(V("c_mktsegment").isin("BUILDING", "MACHINERY") & (V("c_nationkey") == 3) & (V("c_acctbal") > 0)).select("c_custkey")


@query("SELECT p_partkey, CASE WHEN a >= 0.5 AND b >= 0.5 THEN 'both' WHEN a >= 0.5 OR b >= 0.5 THEN 'one' ELSE 'none' END AS class FROM (SELECT p_partkey, p_size / 50.0 AS a, p_retailprice / 2000.0 AS b FROM part)")
def effect_class(fx: Fixtures) -> DataFrame:
    return fx.read("part").select("p_partkey", pr.effect_class(V("p_size") / 50, V("p_retailprice") / 2000, 0.5).alias("class"))


@query("SELECT sample_id, CASE WHEN sample_id = 5 THEN 'manual' WHEN label = 'ASIA' THEN 'a' WHEN label = 'EUROPE' THEN 'e' ELSE 'other' END AS label FROM obs")
def relabel(fx: Fixtures) -> DataFrame:
    over = fx.spark.sql("SELECT 5L AS sample_id, 'manual' AS label")
    return pr.relabel(fx.obs, "label", {"ASIA": "a", "EUROPE": "e"}, over).select("sample_id", "label")


def _parted(fx: Fixtures) -> dict[str, DataFrame]:
    """The cells of the two batches; the second lacks the features of one type's set."""
    tagged = fx.cells.join(fx.obs.select("sample_id", "batch"), "sample_id")
    lacking = fx.sets.where("set_name = 'ECONOMY'").select("feature_id")
    return {"x": tagged.where("batch = 'b0'").drop("batch"), "y": tagged.where("batch = 'b1'").drop("batch").join(lacking, "feature_id", "left_anti")}


TWO = "two AS (SELECT c.*, CASE WHEN batch = 'b0' THEN 'x' ELSE 'y' END AS source FROM cells c JOIN obs USING (sample_id) WHERE batch = 'b0' OR feature_id NOT IN (SELECT feature_id FROM sets WHERE set_name = 'ECONOMY'))"


@query("SELECT feature_id FROM two WHERE source = 'x' INTERSECT SELECT feature_id FROM two WHERE source = 'y'", TWO)
def common_features(fx: Fixtures) -> DataFrame:
    return pr.common_features(*_parted(fx).values())


@query("SELECT sample_id, feature_id, value, source FROM two", TWO)
def concat_outer(fx: Fixtures) -> DataFrame:
    return pr.concat_cells(_parted(fx)).select("sample_id", "feature_id", "value", "source")


@query("SELECT sample_id, feature_id, value, source FROM two WHERE feature_id IN (SELECT feature_id FROM two GROUP BY 1 HAVING count(DISTINCT source) = 2)", TWO)
def concat_inner(fx: Fixtures) -> DataFrame:
    return pr.concat_cells(_parted(fx), "inner").select("sample_id", "feature_id", "value", "source")


RANGES = "rng AS (SELECT feature_id, unnest([45.0, 130.0]) AS lo, unnest([60.0, 200.0]) AS hi FROM var)"


def _ranges(fx: Fixtures) -> DataFrame:
    return fx.var.select("feature_id", F.explode(F.array(F.struct(F.lit(45.0).alias("lo"), F.lit(60.0).alias("hi")), F.struct(F.lit(130.0).alias("lo"), F.lit(200.0).alias("hi")))).alias("x")).select("feature_id", "x.lo", "x.hi")


@query("SELECT c.sample_id, c.feature_id, CASE WHEN EXISTS (SELECT 1 FROM rng g WHERE g.feature_id = c.feature_id AND c.value BETWEEN lo AND hi) THEN 1.0 ELSE 0.0 END AS value FROM cells c", RANGES)
def range_mask_binary(fx: Fixtures) -> DataFrame:
    return pr.in_ranges(fx.cells, _ranges(fx))


for _how, _fn in (("mean", "avg"), ("median", "median")):

    def _mask(fx: Fixtures, how: str = _how) -> DataFrame:
        return pr.in_ranges(fx.cells, _ranges(fx), how)

    _mask.__name__ = f"range_mask_{_how}"
    query(f"SELECT c.sample_id, c.feature_id, {r('coalesce(s.stat, 0.0)')} AS value FROM cells c LEFT JOIN (SELECT g.feature_id, lo, hi, {_fn}(value) AS stat FROM rng g JOIN cells k ON k.feature_id = g.feature_id AND value BETWEEN lo AND hi GROUP BY 1, 2, 3) s ON s.feature_id = c.feature_id AND c.value BETWEEN s.lo AND s.hi", RANGES)(_mask)

# normalisation ---------------------------------------------------------------------------------


@query("SELECT sample_id, feature_id, value + 1 AS value FROM dense")
def impute_plus_one(fx: Fixtures) -> DataFrame:
    return nm.impute_plus_one(fx.dense)


@query("SELECT sample_id, feature_id, CASE WHEN value = 0 THEN 1.0 ELSE value END AS value FROM dense")
def impute_replace_one(fx: Fixtures) -> DataFrame:
    return nm.impute_replace_one(fx.dense)


@query(VALUE + "(SELECT *, CASE WHEN value = 0 THEN 1.0 / (p * p) ELSE value / t * (1 - z / (p * p)::DOUBLE) END + 1e-10 AS x FROM (SELECT *, sum(value) OVER w AS t, count(*) OVER w AS p, count(*) FILTER (WHERE value = 0) OVER w AS z FROM dense WINDOW w AS (PARTITION BY sample_id)))")
def impute_multi_replace(fx: Fixtures) -> DataFrame:
    """Moved by 1e-10, as one value lies on the edge of two roundings."""
    return nm.impute_multi_replace(fx.dense).withColumn("value", F.col("value") + 1e-10)


@query(VALUE + "(SELECT d.sample_id, d.feature_id, CASE WHEN d.value = 0 THEN m.mid ELSE d.value END AS x FROM dense d JOIN obs o USING (sample_id) JOIN (SELECT label, feature_id, median(value) AS mid FROM dense JOIN obs USING (sample_id) GROUP BY 1, 2) m ON m.label = o.label AND m.feature_id = d.feature_id)")
def impute_labelled_median(fx: Fixtures) -> DataFrame:
    return nm.impute_labelled_median(fx.dense, fx.obs, "label")


@query(VALUE + "(SELECT sample_id, feature_id, CASE WHEN value = 0 THEN coalesce(mid, 0.0) ELSE value END AS x FROM dense LEFT JOIN (SELECT feature_id, median(value) AS mid FROM cells GROUP BY 1) USING (feature_id))")
def impute_feature_median(fx: Fixtures) -> DataFrame:
    return nm.impute_feature_median(fx.dense)


CLR = "clr AS (SELECT sample_id, feature_id, ln(value + 1) - sum(ln(value + 1)) OVER (PARTITION BY sample_id) / (SELECT p FROM sizes) AS x FROM dense)"


@query(VALUE + "clr", CLR)
def clr(fx: Fixtures) -> DataFrame:
    return nm.clr(fx.cells, fx.obs, fx.var)


@query(VALUE + "(SELECT *, ln(value + 1) - sum(CASE WHEN feature_id IN (SELECT feature_id FROM list) THEN ln(value + 1) ELSE 0 END) OVER (PARTITION BY sample_id) / 3 AS x FROM dense)", LIST)
def clr_subset(fx: Fixtures) -> DataFrame:
    return nm.clr(fx.cells, fx.obs, fx.var, subset=feature_list(fx))


@query(VALUE + "(SELECT *, CASE WHEN value > 0 THEN ln(CASE WHEN value > 0 THEN value END) - avg(ln(CASE WHEN value > 0 THEN value END)) OVER (PARTITION BY sample_id) ELSE 0 END AS x FROM dense)")
def robust_clr(fx: Fixtures) -> DataFrame:
    return nm.robust_clr(fx.dense)


@query(VALUE + "(SELECT sample_id, feature_id, x / ln(2) + log2(2.0) + 0.1 * sqrt(-2 * ln(u)) * cos(2 * pi() * v) AS x FROM clr JOIN (SELECT sample_id, (('0x' || left(md5('0|a|' || sample_id), 8))::BIGINT + 1) / 4294967297.0::DOUBLE AS u, ('0x' || left(md5('0|b|' || sample_id), 8))::BIGINT / 4294967296.0::DOUBLE AS v FROM obs) USING (sample_id))", CLR)
def clr_scaled(fx: Fixtures) -> DataFrame:
    return nm.clr_scaled(fx.cells, fx.obs, fx.var, fx.obs.select("sample_id", F.lit(2.0).alias("scale")))


@query(VALUE + "(SELECT d.sample_id, d.feature_id, ln(d.value + 1) - ln(f.value + 1) AS x FROM dense d JOIN dense f ON f.sample_id = d.sample_id AND f.feature_id = 'Brand#3' WHERE d.feature_id <> 'Brand#3')")
def alr(fx: Fixtures) -> DataFrame:
    return nm.alr(nm.impute_plus_one(fx.dense), "Brand#3")


@query(VALUE + "(SELECT sample_id, feature_id, value / (length * t) * 1e9 AS x FROM (SELECT *, sum(value) OVER (PARTITION BY sample_id) AS t FROM cells) JOIN var USING (feature_id))")
def fpkm(fx: Fixtures) -> DataFrame:
    return nm.fpkm(fx.cells, fx.var)


@query(VALUE + "(SELECT sample_id, feature_id, q / sum(q) OVER (PARTITION BY sample_id) * 1e6 AS x FROM (SELECT *, value / length AS q FROM cells JOIN var USING (feature_id)))")
def tpm(fx: Fixtures) -> DataFrame:
    return nm.tpm(fx.cells, fx.var)


TMM = (
    "sized AS (SELECT *, sum(value) OVER (PARTITION BY sample_id) AS t FROM cells)",
    "upq AS (SELECT sample_id, quantile_cont(value / t, 0.75) AS q FROM sized GROUP BY 1)",
    "rf AS (SELECT sample_id FROM (SELECT *, avg(q) OVER () AS m FROM upq) ORDER BY abs(q - m), sample_id LIMIT 1)",
    "rv AS (SELECT feature_id, value AS rv, t AS rt FROM sized WHERE sample_id = (SELECT sample_id FROM rf))",
    "ma AS (SELECT sample_id, log2(value / t / (rv / rt)) AS m, (log2(value / t) + log2(rv / rt)) / 2 AS a, 1 / ((t - value) / t / value + (rt - rv) / rt / rv) AS w FROM sized JOIN rv USING (feature_id))",
    "rk AS (SELECT *, count(*) OVER (PARTITION BY sample_id) AS n, rank() OVER (PARTITION BY sample_id ORDER BY m) + (count(*) OVER (PARTITION BY sample_id, m) - 1) / 2.0 AS rm, rank() OVER (PARTITION BY sample_id ORDER BY a) + (count(*) OVER (PARTITION BY sample_id, a) - 1) / 2.0 AS ra FROM ma)",
    "raw AS (SELECT sample_id, pow(2, sum(m * w) / sum(w)) AS f FROM rk WHERE rm BETWEEN floor(n * 0.3) + 1 AND n - floor(n * 0.3) AND ra BETWEEN floor(n * 0.05) + 1 AND n - floor(n * 0.05) GROUP BY 1)",
    "fac AS (SELECT sample_id, total, f / exp(avg(ln(f)) OVER ()) AS factor FROM (SELECT s.sample_id, s.total, coalesce(raw.f, 1.0) AS f FROM (SELECT sample_id, sum(value) AS total FROM cells GROUP BY 1) s LEFT JOIN raw USING (sample_id)))",
)


@query(f"SELECT sample_id, total, {r('factor')} AS factor FROM fac", *TMM)
def tmm_factors(fx: Fixtures) -> DataFrame:
    return nm.tmm_factors(fx.cells)


@query(VALUE + "(SELECT sample_id, feature_id, log2((value + pri) / (lib + 2 * pri) * 1e6) AS x FROM dense JOIN (SELECT sample_id, total * factor AS lib, 2.0 * total * factor / avg(total * factor) OVER () AS pri FROM fac) USING (sample_id))", *TMM)
def tmm_logcpm(fx: Fixtures) -> DataFrame:
    return nm.logcpm(fx.cells, nm.tmm_factors(fx.cells), fx.var)


@query(VALUE + "(SELECT *, ln(1 + value / sum(value) OVER (PARTITION BY sample_id) * 1e4) AS x FROM cells)")
def normalize_total_log1p(fx: Fixtures) -> DataFrame:
    return nm.normalize_total_log1p(fx.cells)


@query(VALUE + "(SELECT *, ln(1 + value / (1 + sample_id % 3)) AS x FROM cells)")
def apply_size_factors(fx: Fixtures) -> DataFrame:
    return nm.apply_size_factors(fx.cells, fx.obs.select("sample_id", (1 + V("sample_id") % 3).alias("factor")))


@query(f"SELECT sample_id, {r('exp(median(ln(x) - m))')} AS factor FROM (SELECT sample_id, value + 1 AS x, avg(ln(value + 1)) OVER (PARTITION BY feature_id) AS m FROM dense) GROUP BY 1")
def median_of_ratios(fx: Fixtures) -> DataFrame:
    return nm.median_of_ratios(nm.impute_plus_one(fx.dense), fx.n)


@query(VALUE + "(SELECT *, coalesce((value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0), 0) AS x FROM dense WINDOW w AS (PARTITION BY feature_id))")
def standard_scale(fx: Fixtures) -> DataFrame:
    return nm.apply_scaler(fx.dense, nm.fit_scaler(fx.dense))


@query(VALUE + "(SELECT *, coalesce((value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0), 0) AS x FROM dense WINDOW w AS (PARTITION BY feature_id))")
def minmax_scale(fx: Fixtures) -> DataFrame:
    return nm.apply_scaler(fx.dense, nm.fit_scaler(fx.dense, "minmax"))


@query(VALUE + "(SELECT *, coalesce((value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0), 0) AS x FROM dense JOIN obs USING (sample_id) WINDOW w AS (PARTITION BY batch, feature_id))")
def scale_by_batch(fx: Fixtures) -> DataFrame:
    return nm.scale_by_batch(fx.dense, fx.obs, "batch")


RANKED = "(rank() OVER (PARTITION BY sample_id ORDER BY value) + (count(*) OVER (PARTITION BY sample_id, value) - 1) / 2.0)::DOUBLE"


@query(f"SELECT sample_id, feature_id, {RANKED} AS value FROM dense")
def into_ranks(fx: Fixtures) -> DataFrame:
    return nm.into_ranks(fx.dense)


@query("SELECT sample_id, feature_id, floor(greatest(exp(l - m + avg_m) - 1, 0) + 1e-9) AS value FROM (SELECT sample_id, d.feature_id, ln(1 + value) AS l, m, avg_m FROM dense d JOIN obs o USING (sample_id) JOIN (SELECT *, avg(m) OVER (PARTITION BY feature_id) AS avg_m FROM (SELECT batch, feature_id, avg(ln(1 + value)) AS m FROM dense JOIN obs USING (sample_id) GROUP BY 1, 2)) k ON k.batch = o.batch AND k.feature_id = d.feature_id)")
def rbe_one_batch(fx: Fixtures) -> DataFrame:
    return nm.remove_batch(fx.dense, fx.obs, "batch")


@query(VALUE + "(SELECT sample_id, feature_id, CASE WHEN batch = 'b0' THEN value / q ELSE value * q END AS x FROM (SELECT *, CASE WHEN a > 0 AND b > 0 THEN sqrt(a / b) ELSE 1 END AS q FROM (SELECT d.*, batch, avg(CASE WHEN batch = 'b0' THEN value END) OVER w AS a, avg(CASE WHEN batch = 'b1' THEN value END) OVER w AS b FROM dense d JOIN obs USING (sample_id) WINDOW w AS (PARTITION BY feature_id))))")
def lfc_batch_scale(fx: Fixtures) -> DataFrame:
    return nm.lfc_batch_scale(fx.dense, fx.obs, "batch", "b0", "b1")


@query(f"SELECT batch, feature_id, {r('m')} AS mean, {r('greatest(coalesce((s - m) / nullif(m * m, 0), 0), 0)')} AS dispersion FROM (SELECT batch, feature_id, avg(value) AS m, var_samp(value) AS s FROM dense JOIN obs USING (sample_id) GROUP BY 1, 2)")
def batch_dispersion(fx: Fixtures) -> DataFrame:
    return nm.batch_dispersion(fx.dense, fx.obs, "batch")


@query("SELECT a.batch, count(DISTINCT a.label) AS n_groups, count(DISTINCT b.batch) - 1 AS n_linked, count(DISTINCT b.batch) = 1 AS confounded FROM obs a JOIN obs b ON a.label = b.label GROUP BY 1")
def batch_confounding(fx: Fixtures) -> DataFrame:
    return nm.batch_confounding(fx.obs, "batch", "label")


AUDIT = "audit AS (SELECT c.sample_id, c.feature_id, c.value AS a, c.value / v.length * 1000 AS b FROM cells c JOIN var v USING (feature_id))"


def _after(fx: Fixtures) -> DataFrame:
    return fx.cells.join(fx.var, "feature_id").select("sample_id", "feature_id", (V("value") / V("length") * 1000).alias("value"))


for _by in ("feature", "sample"):

    def _audit(fx: Fixtures, by: str = _by) -> DataFrame:
        return nm.correction_audit(fx.cells, _after(fx), f"{by}_id")

    _audit.__name__ = f"correction_audit_{'gene' if _by == 'feature' else 'sample'}"
    query(f"SELECT {_by}_id, {r('avg(b - a)')} AS mean_diff, {r('avg(abs(b - a))')} AS mean_abs_diff, {r('stddev_samp(b - a)')} AS sd_diff, {r('avg(b / a)')} AS mean_fold FROM audit GROUP BY 1", AUDIT)(_audit)


@query(VALUE + "(SELECT c.sample_id, c.feature_id, c.value / f AS x FROM cells c JOIN (SELECT feature_id, avg(a / b) AS f FROM audit GROUP BY 1) USING (feature_id))", AUDIT)
def fc_mean_adjust(fx: Fixtures) -> DataFrame:
    return nm.mean_adjust(fx.cells, _after(fx), fx.cells)


TECH = "tech AS (SELECT feature_id, sum(k * (m - gm) ** 2) AS effect FROM (SELECT *, sum(s) OVER w / sum(k) OVER w AS gm FROM (SELECT feature_id, label, batch, count(*) AS k, avg(value) AS m, sum(value) AS s FROM dense JOIN obs USING (sample_id) GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY feature_id, label)) GROUP BY 1), cum AS (SELECT *, sum(effect) OVER (ORDER BY effect DESC, feature_id) / sum(effect) OVER () AS upto, effect / sum(effect) OVER () AS own FROM tech)"


@query(f"SELECT feature_id, {r('effect')} AS effect, {r('upto')} AS upto FROM cum", TECH)
def tech_effect(fx: Fixtures) -> DataFrame:
    return nm.technical_effect(fx.dense, fx.obs, "label", "batch").select("feature_id", "effect", "upto")


@query("SELECT feature_id FROM cum WHERE upto - own < 0.9", TECH)
def high_batch_genes(fx: Fixtures) -> DataFrame:
    return nm.technical_effect(fx.dense, fx.obs, "label", "batch").where("high").select("feature_id")


# summaries -------------------------------------------------------------------------------------


@query("SELECT label, count(*) AS n FROM obs GROUP BY 1")
def level_counts(fx: Fixtures) -> DataFrame:
    return sm.level_counts(fx.obs, "label")


@query("SELECT label, batch, count(*) AS n FROM obs GROUP BY 1, 2")
def crosstab_long(fx: Fixtures) -> DataFrame:
    return sm.crosstab_long(fx.obs, "label", "batch")


@query(f"SELECT sample_id, sum(value) AS total_counts, count(*) AS n_features, {r('ln(1 + sum(value))')} AS log1p_total_counts FROM cells GROUP BY 1")
def qc_samples(fx: Fixtures) -> DataFrame:
    return sm.qc_samples(fx.cells)


@query(f"SELECT feature_id, count(*) AS n_cells, {r('sum(value) / any_value(n)')} AS mean_counts, {r('100 * (1 - count(*) / any_value(n))')} AS pct_dropout_by_counts, sum(value) AS total_counts FROM cells CROSS JOIN sizes GROUP BY 1")
def qc_features(fx: Fixtures) -> DataFrame:
    return sm.qc_features(fx.cells, fx.n)


@query(f"SELECT label AS grp, feature_id, {r('avg(value)')} AS mean, {r('avg(CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END)')} AS fraction FROM dense JOIN obs USING (sample_id) GROUP BY 1, 2 HAVING sum(value) > 0")
def dotplot_table(fx: Fixtures) -> DataFrame:
    return sm.dotplot(fx.cells, fx.obs, "label")


GINI = "gin AS (SELECT c_nationkey AS cluster, sum(c) AS n, sum(c / t * (1 - c / t)) AS gini FROM (SELECT c_nationkey, c_mktsegment, count(*) AS c, sum(count(*)) OVER (PARTITION BY c_nationkey) AS t FROM customer GROUP BY 1, 2) GROUP BY 1)"


@query(f"SELECT cluster, n::BIGINT AS n, {r('gini')} AS gini FROM gin", GINI)
def cluster_gini(fx: Fixtures) -> DataFrame:
    return sm.cluster_gini(fx.read("customer"), "c_nationkey", "c_mktsegment")


@query(f"SELECT {r('sum(n * gini) / sum(n)')} AS total_gini FROM gin", GINI)
def total_gini(fx: Fixtures) -> DataFrame:
    return sm.total_gini(sm.cluster_gini(fx.read("customer"), "c_nationkey", "c_mktsegment"))


@query(f"SELECT {r('-sum(c / t * log2(c / t))')} AS entropy FROM (SELECT count(*) AS c, sum(count(*)) OVER () AS t FROM customer GROUP BY c_mktsegment)")
def label_entropy(fx: Fixtures) -> DataFrame:
    return sm.label_entropy(fx.read("customer"), "c_mktsegment")


@query("SELECT nation AS x, min(label) AS y FROM obs GROUP BY 1 HAVING count(DISTINCT label) = 1")
def confounded_pairs(fx: Fixtures) -> DataFrame:
    return sm.confounded(fx.obs, "nation", "label")


@query("SELECT c_nationkey, c_mktsegment AS mode, n FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS k FROM customer GROUP BY 1, 2) WHERE k = 1")
def string_mode(fx: Fixtures) -> DataFrame:
    return sm.string_mode(fx.read("customer"), "c_nationkey", "c_mktsegment")


@query("SELECT set_name, string_agg(feature_id, ',' ORDER BY feature_id) AS members, count(*) AS n FROM sets GROUP BY 1 HAVING count(*) >= 2")
def group_sets(fx: Fixtures) -> DataFrame:
    return sm.group_sets(fx.sets, "set_name", "feature_id", 2)


@query(f"SELECT sample_id, set_name, {r('sum(value) / any_value(k)')} AS value FROM cells JOIN sets USING (feature_id) JOIN (SELECT set_name, count(*) AS k FROM sets WHERE feature_id IN (SELECT feature_id FROM cells) GROUP BY 1) USING (set_name) GROUP BY 1, 2")
def gene_set_average(fx: Fixtures) -> DataFrame:
    return sm.gene_set_average(fx.cells, fx.sets)


FRACTION = "frac AS (SELECT sample_id, set_name, count(*) / any_value(k)::DOUBLE AS fraction FROM cells JOIN sets USING (feature_id) JOIN (SELECT set_name, count(*) AS k FROM sets GROUP BY 1) USING (set_name) GROUP BY 1, 2)"


@query(f"SELECT sample_id, set_name, {r('fraction')} AS fraction FROM frac", FRACTION)
def set_nonzero_fraction(fx: Fixtures) -> DataFrame:
    return sm.set_nonzero_fraction(fx.cells, fx.sets)


@query("SELECT set_name, count(*) FILTER (WHERE fraction >= 0.5) AS n_passing FROM frac GROUP BY 1 HAVING count(*) FILTER (WHERE fraction >= 0.5) >= 0.4 * (SELECT n FROM sizes)", FRACTION)
def set_filter(fx: Fixtures) -> DataFrame:
    return sm.set_filter(sm.set_nonzero_fraction(fx.cells, fx.sets), fx.n, 0.5, 0.4)


@query("SELECT set_name, level, round(avg(fraction), 3) AS fraction FROM (SELECT sample_id, 'label-' || label AS level FROM obs UNION ALL SELECT sample_id, 'batch-' || batch FROM obs) JOIN frac USING (sample_id) GROUP BY 1, 2", FRACTION)
def set_fraction_by_meta(fx: Fixtures) -> DataFrame:
    return sm.fraction_by_meta(sm.set_nonzero_fraction(fx.cells, fx.sets), fx.obs, ["label", "batch"])


@query("SELECT p_type, count(*) FILTER (WHERE p_size % 2 = 0) AS even, count(*) FILTER (WHERE p_size % 2 = 1) AS odd FROM part WHERE p_retailprice / 20000.0 < 0.05 GROUP BY 1")
def enrichment_summary(fx: Fixtures) -> DataFrame:
    part = fx.read("part").withColumn("a", F.when(V("p_size") % 2 == 0, "even").otherwise("odd"))
    return sm.enrichment_summary(part, "p_type", "a", ["even", "odd"], V("p_retailprice") / 20000)


@query(f"SELECT p_brand, {r('avg(x)')} AS mean, {r('median(x)')} AS median, {r('var_samp(x)')} AS var, min(x)::DOUBLE AS min, max(x)::DOUBLE AS max, {r('stddev_samp(x)')} AS sd, count(*) FILTER (WHERE p_retailprice > 1000) AS n_sig FROM (SELECT *, abs(p_size - 25)::DOUBLE AS x FROM part) GROUP BY 1")
def lfc_summary(fx: Fixtures) -> DataFrame:
    return sm.effect_summary(fx.read("part").withColumn("e", (V("p_size") - 25).cast("double")), "p_brand", "e", V("p_retailprice") > 1000)


@query(f"SELECT model, metric, {r('avg(value)')} AS mean, {r('median(value)')} AS median, {r('stddev_samp(value)')} AS std FROM results GROUP BY 1, 2")
def bootstrap_summary(fx: Fixtures) -> DataFrame:
    return sm.metric_summary(fx.results, ["model", "metric"])


@query("SELECT set_name, string_agg(feature_id, ';' ORDER BY feature_id) AS joined, min(feature_id) AS first FROM sets GROUP BY 1")
def joined_comparisons(fx: Fixtures) -> DataFrame:
    return sm.joined_list(fx.sets, "set_name", "feature_id", "feature_id", "feature_id")


@query(f"SELECT truth, model, count(*) AS total, count(*) FILTER (WHERE truth <> prediction) AS misses, {r('count(*) FILTER (WHERE truth <> prediction) / count(*)')} AS frequency FROM pred GROUP BY 1, 2")
def miss_frequency(fx: Fixtures) -> DataFrame:
    return sm.miss_frequency(fx.pred, ["truth", "model"])


@query(f"SELECT model, {r('m')} AS mean, {r('m - min(m) OVER ()')} AS gain FROM (SELECT model, avg(value) AS m FROM results WHERE metric = 'error' GROUP BY 1)")
def strategy_gain(fx: Fixtures) -> DataFrame:
    return sm.strategy_gain(fx.results.where("metric = 'error'"), "model", "value")


CM = "cm AS (SELECT fold, truth, prediction, count(*) AS n FROM pred GROUP BY 1, 2, 3), total AS (SELECT truth, prediction, sum(n)::BIGINT AS n FROM cm GROUP BY 1, 2)"


def _cm(fx: Fixtures) -> DataFrame:
    return fx.pred.groupBy("fold", "truth", "prediction").agg(F.count("*").alias("n"))


@query("SELECT * FROM total", CM)
def cm_total(fx: Fixtures) -> DataFrame:
    return sm.cm_total(_cm(fx))


@query(f"SELECT truth, (sum(n) FILTER (WHERE truth = prediction))::BIGINT AS hits, sum(n)::BIGINT AS total, {r('sum(n) FILTER (WHERE truth = prediction) / sum(n)')} AS accuracy, {r('sum(n) / (SELECT sum(n) FROM total)')} AS share FROM total GROUP BY 1", CM)
def cm_correctness(fx: Fixtures) -> DataFrame:
    return sm.cm_correctness(sm.cm_total(_cm(fx)))


@query(f"SELECT truth, prediction, {r('sum(n) / 5')} AS mean, {r('sqrt(greatest(sum(n * n) / 5 - (sum(n) / 5) ** 2, 0))')} AS std FROM cm GROUP BY 1, 2", CM)
def cm_std(fx: Fixtures) -> DataFrame:
    return sm.cm_spread(_cm(fx), 5)


@query(f"SELECT truth, prediction, {r('sum(n) / 5')} AS mean FROM cm GROUP BY 1, 2", CM)
def cm_mean(fx: Fixtures) -> DataFrame:
    return sm.cm_spread(_cm(fx), 5).select("truth", "prediction", "mean")


@query(f"SELECT l_returnflag, l_linenumber, {r('stddev_pop(l_discount)')} AS std, {r('var_pop(l_discount)')} AS var FROM lineitem GROUP BY 1, 2")
def coef_spread(fx: Fixtures) -> DataFrame:
    return sm.coef_spread(fx.read("lineitem"), ["l_returnflag", "l_linenumber"], "l_discount")


UPSET = "combos AS (SELECT feature_id, string_agg(DISTINCT set_name, '&' ORDER BY set_name) AS combo FROM sets GROUP BY 1)"


@query("SELECT combo, count(*) AS n FROM combos GROUP BY 1", UPSET)
def upset_counts(fx: Fixtures) -> DataFrame:
    return sm.upset(fx.sets, "feature_id", "set_name").select("combo", "n")


@query("SELECT combo, string_agg(feature_id, ',' ORDER BY feature_id) AS members FROM combos GROUP BY 1", UPSET)
def upset_members(fx: Fixtures) -> DataFrame:
    return sm.upset(fx.sets, "feature_id", "set_name").select("combo", "members")


@query("SELECT feature_id, min(set_name) AS set_name FROM sets GROUP BY 1 HAVING count(*) = 1")
def unique_members(fx: Fixtures) -> DataFrame:
    return sm.unique_members(fx.sets, "feature_id", "set_name")


@query(f"SELECT model, metric, {r('avg(value)')} AS mean FROM results GROUP BY 1, 2")
def mean_curve(fx: Fixtures) -> DataFrame:
    return sm.metric_summary(fx.results, ["model", "metric"]).select("model", "metric", "mean")


@query(f"SELECT label, feature_id, {r('var_samp(value)')} AS variance FROM dense JOIN obs USING (sample_id) GROUP BY 1, 2 HAVING sum(value) > 0")
def label_variance(fx: Fixtures) -> DataFrame:
    return sm.label_variance(fx.cells, fx.obs, "label")


PRICE = "ranked AS (SELECT p_type, p_brand, sum(p_retailprice) AS a, sum(p_size)::DOUBLE AS b FROM part GROUP BY 1, 2)"


def _ranked(fx: Fixtures, name: str) -> DataFrame:
    return fx.read("part").groupBy("p_type", "p_brand").agg(F.sum(name).cast("double").alias("score"))


@query("SELECT t.p_type, coalesce(c, 0) / 5.0 AS overlap FROM (SELECT DISTINCT p_type FROM part) t LEFT JOIN (SELECT p_type, count(*) AS c FROM (SELECT p_type, p_brand, row_number() OVER (PARTITION BY p_type ORDER BY a DESC, p_brand) AS i, row_number() OVER (PARTITION BY p_type ORDER BY b DESC, p_brand) AS j FROM ranked) WHERE i <= 5 AND j <= 5 GROUP BY 1) x USING (p_type)", PRICE)
def topn_overlap(fx: Fixtures) -> DataFrame:
    return sm.topn_overlap(_ranked(fx, "p_retailprice"), _ranked(fx, "p_size"), "p_type", "p_brand", "score", 5)


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def top_n_features(fx: Fixtures) -> DataFrame:
    return sm.top_n(fx.read("part"), [F.desc("p_retailprice"), V("p_partkey")], 20).select("p_partkey", "p_retailprice")


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice, p_partkey LIMIT 20")
def bottom_n_features(fx: Fixtures) -> DataFrame:
    return sm.top_n(fx.read("part"), [V("p_retailprice"), V("p_partkey")], 20).select("p_partkey", "p_retailprice")


@query("SELECT p_type, p_brand, b AS score, k::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY abs(b) DESC, p_brand) AS k FROM ranked) WHERE k <= 3", PRICE)
def top_n_per_class(fx: Fixtures) -> DataFrame:
    return sm.top_n(_ranked(fx, "p_size"), [F.desc(F.abs("score")), V("p_brand")], 3, ["p_type"])


@query("SELECT nation, label, n, k::INT AS rank FROM (SELECT nation, label, count(*) AS n, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, nation) AS k FROM obs GROUP BY 1, 2) WHERE k <= 3")
def top_per_tissue(fx: Fixtures) -> DataFrame:
    return sm.top_n(fx.obs.groupBy("nation", "label").agg(F.count("*").alias("n")), [F.desc("n"), V("nation")], 3, ["label"])


@query("SELECT p_type, p_brand, b AS score, k::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY b DESC, p_brand) AS k FROM (SELECT r.*, f FROM raw r LEFT JOIN (SELECT p_brand, min(p_type) AS f FROM raw WHERE i <= 4 GROUP BY 1) USING (p_brand)) WHERE f IS NULL OR f >= p_type) WHERE k <= 4", PRICE, "raw AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY b DESC, p_brand) AS i FROM ranked)")
def disjoint_top_n(fx: Fixtures) -> DataFrame:
    return sm.disjoint_top_n(_ranked(fx, "p_size"), "p_type", "p_type", "p_brand", "score", 4)


@query("(SELECT p_brand, 'a' AS side FROM x ORDER BY a DESC, p_brand LIMIT 5) UNION ALL (SELECT p_brand, 'b' FROM x WHERE p_brand NOT IN (SELECT p_brand FROM x ORDER BY a DESC, p_brand LIMIT 5) ORDER BY b DESC, p_brand LIMIT 5)", "x AS (SELECT p_brand, sum(p_retailprice) AS a, sum(p_size) AS b FROM part GROUP BY 1)")
def half_half(fx: Fixtures) -> DataFrame:
    one = lambda c: fx.read("part").groupBy("p_brand").agg(F.sum(c).alias("score"))
    return sm.half_half(one("p_retailprice"), one("p_size"), "score", "p_brand", 10)


@query("SELECT feature_id, length, ntile(10) OVER (ORDER BY length, feature_id)::INT AS bin FROM var")
def ratio_bins(fx: Fixtures) -> DataFrame:
    return sm.ratio_bins(fx.var.select("feature_id", "length"), "length", "feature_id")


NOISY = "under AS (SELECT feature_id, label, m, q FROM grp JOIN (SELECT label, quantile_cont(m, 0.5) AS q FROM grp GROUP BY 1) USING (label))", "grp AS (SELECT label, feature_id, sum(value) AS m FROM cells JOIN obs USING (sample_id) GROUP BY 1, 2)"


def _noisy(fx: Fixtures, how: str) -> DataFrame:
    grp = fx.cells.join(fx.labels, "sample_id").groupBy("label", "feature_id").agg(F.sum("value").alias("m"))
    return sm.noisy_features(grp, "label", "feature_id", "m", 0.5, how)


@query("SELECT feature_id FROM under GROUP BY 1 HAVING bool_or(m < q)", NOISY[1], NOISY[0])
def noisy_any(fx: Fixtures) -> DataFrame:
    return _noisy(fx, "any")


@query("SELECT feature_id FROM under GROUP BY 1 HAVING bool_and(m < q)", NOISY[1], NOISY[0])
def noisy_all(fx: Fixtures) -> DataFrame:
    return _noisy(fx, "all")


@query("SELECT feature_id FROM under GROUP BY 1 HAVING median(m) < median(q)", NOISY[1], NOISY[0])
def noisy_median(fx: Fixtures) -> DataFrame:
    return _noisy(fx, "median")


@query("SELECT p_type, p_partkey, p_size, p_retailprice FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_type = a.p_type AND (b.p_size > a.p_size AND b.p_retailprice >= a.p_retailprice OR b.p_size = a.p_size AND (b.p_retailprice > a.p_retailprice OR b.p_retailprice = a.p_retailprice AND b.p_partkey < a.p_partkey)))")
def pareto_front(fx: Fixtures) -> DataFrame:
    return sm.pareto_front(fx.read("part"), "p_size", "p_retailprice", "p_partkey", ["p_type"]).select("p_type", "p_partkey", "p_size", "p_retailprice")


@query(f"SELECT feature_id, ntile(10) OVER (ORDER BY length DESC, feature_id)::INT AS decile, {r('sum(length) OVER (ORDER BY length DESC, feature_id) / sum(length) OVER ()')} AS cumulative FROM var")
def cumulative_effect(fx: Fixtures) -> DataFrame:
    return sm.cumulative_effect(fx.var, "length", "feature_id")


@query(f"SELECT sample_id, class AS prediction, {r('score')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, class) AS k FROM scores) WHERE k = 1")
def argmax_class(fx: Fixtures) -> DataFrame:
    return sm.argmax_class(fx.scores)


WIN = "win AS (SELECT metric, fold, model FROM (SELECT *, row_number() OVER (PARTITION BY metric, fold ORDER BY CASE WHEN metric = 'error' THEN value ELSE -value END, model) AS k FROM results) WHERE k = 1)"


@query("SELECT metric, fold, model FROM win", WIN)
def rank_winners(fx: Fixtures) -> DataFrame:
    return sm.rank_winners(fx.results, ["error"])


@query("SELECT metric, model, count(*) AS wins FROM win GROUP BY 1, 2", WIN)
def rank_table(fx: Fixtures) -> DataFrame:
    return sm.rank_table(sm.rank_winners(fx.results, ["error"]))


PAIRS = "prs AS (SELECT a.s AS x, b.s AS y, (SELECT count(*) FROM sets p JOIN sets q USING (feature_id) WHERE p.set_name = a.s AND q.set_name = b.s) AS n, a.k AS a, b.k AS b FROM (SELECT set_name AS s, count(*) AS k FROM sets GROUP BY 1) a JOIN (SELECT set_name AS s, count(*) AS k FROM sets GROUP BY 1) b ON a.s < b.s)"


@query("SELECT x, y, n FROM prs", PAIRS)
def pairwise_overlaps(fx: Fixtures) -> DataFrame:
    return sm.pairwise_overlaps(fx.sets)


@query(f"SELECT x, y, {r('1 - n / (a + b - n)')} AS distance FROM prs", PAIRS)
def jaccard_distance(fx: Fixtures) -> DataFrame:
    return sm.jaccard_distance(fx.sets)


@query("SELECT set_name, feature_id FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY k, set_name) AS i FROM (SELECT *, count(*) OVER (PARTITION BY set_name) AS k FROM sets)) WHERE i = 1")
def resolve_overlaps(fx: Fixtures) -> DataFrame:
    return sm.resolve_overlaps(fx.sets)


@query("SELECT feature_id FROM sets GROUP BY 1 HAVING count(DISTINCT set_name) = (SELECT count(DISTINCT set_name) FROM sets)")
def intersect_all_groups(fx: Fixtures) -> DataFrame:
    return sm.in_all_groups(fx.sets, "feature_id", "set_name")


FLAGS = "p_size % 7 = 0 AS wrong_neg, p_size % 5 = 0 AS right_neg, p_size % 3 = 0 AS train_neg, p_partkey % 60 = 0 AS pos"


@query(f"SELECT p_brand FROM (SELECT p_brand, bool_or(wrong_neg) AS w, bool_or(right_neg) AS r, bool_or(train_neg) AS t, bool_or(pos) AS p FROM (SELECT p_brand, {FLAGS} FROM part) GROUP BY 1) WHERE w AND (r OR t) AND NOT p")
def neg_contributions(fx: Fixtures) -> DataFrame:
    return sm.negative_contributions(fx.read("part").selectExpr("p_brand", *FLAGS.split(", ")), "p_brand")


@query("SELECT DISTINCT least(truth, prediction) AS x, greatest(truth, prediction) AS y FROM pred WHERE truth <> prediction")
def distinct_orderings(fx: Fixtures) -> DataFrame:
    return sm.distinct_orderings(fx.pred, "truth", "prediction")
