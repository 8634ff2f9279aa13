"""The tables that the registered queries read, cast as cells, obs, var, sets, edges and predictions.

``SQL`` holds the same definitions for the independent check.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assaymill.storage import materialize

# The market segments, in order.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")

SQL = """
cells AS (SELECT o_custkey AS sample_id, p_brand AS feature_id, sum(l_quantity) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
obs AS (SELECT c_custkey AS sample_id, r_name AS label, n_name AS nation, CASE WHEN c_mktsegment < 'G' THEN 'b0' ELSE 'b1' END AS batch FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
var AS (SELECT p_brand AS feature_id, sum(p_size)::DOUBLE AS length, min(p_type) AS biotype FROM part GROUP BY 1),
dense AS (SELECT o.sample_id, v.feature_id, coalesce(c.value, 0.0) AS value FROM obs o CROSS JOIN var v LEFT JOIN cells c ON c.sample_id = o.sample_id AND c.feature_id = v.feature_id),
sizes AS (SELECT (SELECT count(*) FROM obs) AS n, (SELECT count(*) FROM var) AS p),
sets AS (SELECT set_name, feature_id FROM (SELECT p_type AS set_name, p_brand AS feature_id, sum(p_size) AS size, avg(sum(p_size)) OVER (PARTITION BY p_type) AS usual FROM part GROUP BY 1, 2) WHERE size > usual),
edges AS (SELECT 'all' AS parent, r_name AS child FROM region UNION SELECT r_name, n_name FROM region JOIN nation ON n_regionkey = r_regionkey),
pred AS (SELECT c_custkey AS sample_id, c_mktsegment AS truth, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment ELSE ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'][c_nationkey % 5 + 1] END AS prediction,
  'm' || (c_nationkey % 4)::VARCHAR AS model, (c_custkey % 5)::INT AS fold FROM customer),
scores AS (SELECT sample_id, k.class, ((sample_id * (k.i * 7 + 3)) % 101) / 101.0::DOUBLE + CASE WHEN k.class = truth THEN 0.3 ELSE 0.0 END AS score FROM pred CROSS JOIN (SELECT unnest(range(5)) AS i, unnest(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY']) AS class) k),
results AS (SELECT model, fold, unnest(['accuracy', 'error']) AS metric, unnest([a, 1 - a]) AS value FROM (SELECT model, fold, avg(CASE WHEN truth = prediction THEN 1.0 ELSE 0.0 END) AS a FROM pred GROUP BY 1, 2))
"""


class Fixtures:
    """The tables of one scale folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def cells(self) -> DataFrame:
        sold = self.read("lineitem").join(self.read("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(self.read("part"), F.col("l_partkey") == F.col("p_partkey"))
        cells = sold.groupBy(F.col("o_custkey").alias("sample_id"), F.col("p_brand").alias("feature_id")).agg(F.sum("l_quantity").alias("value"))
        return materialize(cells, "cells")  # most queries read them several times

    @cached_property
    def obs(self) -> DataFrame:
        c = self.read("customer").join(self.read("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(self.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return c.select(F.col("c_custkey").alias("sample_id"), F.col("r_name").alias("label"), F.col("n_name").alias("nation"), F.when(F.col("c_mktsegment") < "G", "b0").otherwise("b1").alias("batch"))

    @cached_property
    def labels(self) -> DataFrame:
        return self.obs.select("sample_id", "label")

    @cached_property
    def var(self) -> DataFrame:
        return self.read("part").groupBy(F.col("p_brand").alias("feature_id")).agg(F.sum("p_size").cast("double").alias("length"), F.min("p_type").alias("biotype"))

    @cached_property
    def dense(self) -> DataFrame:
        from assaymill.operators.normalise import densify

        return densify(self.cells, self.obs, self.var)

    @cached_property
    def n(self) -> int:
        return self.obs.count()

    @cached_property
    def p(self) -> int:
        return self.var.count()

    @cached_property
    def sets(self) -> DataFrame:
        """Per type the brands whose parts are larger in sum than those of the type's usual brand."""
        sizes = self.read("part").groupBy(F.col("p_type").alias("set_name"), F.col("p_brand").alias("feature_id")).agg(F.sum("p_size").alias("size"))
        usual = F.avg("size").over(Window.partitionBy("set_name"))
        return sizes.withColumn("usual", usual).where("size > usual").select("set_name", "feature_id")

    @cached_property
    def edges(self) -> DataFrame:
        region = self.read("region")
        nation = region.join(self.read("nation"), F.col("n_regionkey") == F.col("r_regionkey"))
        return region.select(F.lit("all").alias("parent"), F.col("r_name").alias("child")).union(nation.select("r_name", "n_name")).distinct()

    @cached_property
    def pred(self) -> DataFrame:
        other = F.element_at(F.array(*map(F.lit, SEGMENTS)), (F.col("c_nationkey") % 5 + 1).cast("int"))
        return self.read("customer").select(
            F.col("c_custkey").alias("sample_id"), F.col("c_mktsegment").alias("truth"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).otherwise(other).alias("prediction"),
            F.concat(F.lit("m"), (F.col("c_nationkey") % 4).cast("string")).alias("model"), (F.col("c_custkey") % 5).cast("int").alias("fold"),
        )

    @cached_property
    def scores(self) -> DataFrame:
        each = self.pred.select("sample_id", "truth", F.posexplode(F.array(*map(F.lit, SEGMENTS))).alias("i", "class"))
        return each.select("sample_id", "class", (((F.col("sample_id") * (F.col("i") * 7 + 3)) % 101) / 101.0 + F.when(F.col("class") == F.col("truth"), 0.3).otherwise(0.0)).alias("score"))

    @cached_property
    def results(self) -> DataFrame:
        a = self.pred.groupBy("model", "fold").agg(F.avg((F.col("truth") == F.col("prediction")).cast("double")).alias("accuracy"))
        return a.withColumn("error", 1 - F.col("accuracy")).unpivot(["model", "fold"], ["accuracy", "error"], "metric", "value")
