"""Gene sets and ontologies held as edges (parent, child)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assaymill.functions.expressions import average_rank
from assaymill.storage import lookup, materialize

V = F.col


def recode(cells: DataFrame, sets: DataFrame, how: str = "sum") -> DataFrame:
    """Sum, or mean over its members, of a set's features per sample."""
    out = cells.join(sets, "feature_id").groupBy("sample_id", "set_name").agg(F.sum("value").alias("value"))
    if how == "sum":
        return out
    size = sets.groupBy("set_name").agg(F.count("*").alias("_n"))
    return out.join(size, "set_name").select("sample_id", "set_name", (V("value") / V("_n")).alias("value"))


def best_evidence(df: DataFrame, gene: str, term: str, code: str, ratings: Mapping[str, int]) -> DataFrame:
    """One row per gene and term: the evidence of the lowest rating, then the first code."""
    rating = F.coalesce(F.create_map(*[F.lit(x) for kv in ratings.items() for x in kv])[V(code)], F.lit(max(ratings.values()) + 1))
    w = Window.partitionBy(gene, term).orderBy("rating", code)
    return df.withColumn("rating", rating).withColumn("_r", F.row_number().over(w)).where("_r = 1").select(gene, term, code, "rating")


def closure(edges: DataFrame) -> DataFrame:
    """(ancestor, descendant, depth): every reachable pair with its least depth, by frontier joins; cycles end."""
    step = edges.select(V("parent").alias("ancestor"), V("child").alias("descendant")).distinct()
    known = materialize(step.withColumn("depth", F.lit(1)), "closure")
    frontier, depth = known, 1
    while True:
        depth += 1
        new = frontier.join(edges, V("descendant") == V("parent")).select("ancestor", V("child").alias("descendant")).distinct()
        new = materialize(new.join(known, ["ancestor", "descendant"], "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if new.isEmpty():
            return known
        known, frontier = known.unionByName(new), new


def levels(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(term, level): least depth below a root; roots have 0. ``known`` is the closure, where there is one already."""
    root = roots(edges)
    below = (closure(edges) if known is None else known).join(root.select(V("term").alias("ancestor")), "ancestor").groupBy(V("descendant").alias("term")).agg(F.min("depth").alias("level"))
    return root.select("term", F.lit(0).alias("level")).unionByName(below)


def roots(edges: DataFrame) -> DataFrame:
    return edges.select(V("parent").alias("term")).distinct().join(edges.select(V("child").alias("term")), "term", "left_anti")


def n_children(edges: DataFrame) -> DataFrame:
    return edges.distinct().groupBy(V("parent").alias("term")).agg(F.count("*").alias("n_children"))


def acyclic(edges: DataFrame) -> DataFrame:
    return closure(edges).agg((F.count_if(V("ancestor") == V("descendant")) == 0).alias("acyclic"))


def subset(edges: DataFrame, terms: DataFrame) -> DataFrame:
    """Edges among the terms and their ancestors."""
    up = closure(edges).join(terms.select(V("term").alias("descendant")), "descendant").select(V("ancestor").alias("term"))
    keep = up.union(terms.select("term")).distinct()
    return edges.join(keep.toDF("parent"), "parent", "left_semi").join(keep.toDF("child"), "child", "left_semi").select("parent", "child")


def aggregate_to_level(values: DataFrame, edges: DataFrame, level: int, how: str = "sum") -> DataFrame:
    """(sample_id, term, value): each term down to a level with itself and all below it."""
    known = closure(edges)
    upper = levels(edges, known).where(V("level") <= level).select("term")
    pairs = known.select(V("ancestor").alias("term"), V("descendant").alias("member")).union(upper.select("term", V("term").alias("member")))
    pairs = pairs.join(upper, "term", "left_semi")
    out = values.withColumnRenamed("term", "member").join(pairs, "member").groupBy("sample_id", "term")
    return out.agg((F.sum("value") if how == "sum" else F.avg("value")).alias("value"))


def top_level_map(edges: DataFrame, level: int) -> DataFrame:
    """(term, top): ancestors at the level."""
    known = closure(edges)
    tops = levels(edges, known).where(V("level") == level).select(V("term").alias("ancestor"))
    return known.join(tops, "ancestor").select(V("descendant").alias("term"), V("ancestor").alias("top"))


def parent_vote(items: DataFrame, item: str, terms: str, parents: DataFrame, priority: DataFrame) -> DataFrame:
    """Most frequent parent of an item's ``;`` list of terms; ties by (parent, priority); without a parent ``unknown``."""
    each = items.select(item, F.explode(F.split(terms, ";")).alias("term"))
    votes = each.join(parents, "term").groupBy(item, "parent").agg(F.count("*").alias("n")).join(priority, "parent", "left")
    w = Window.partitionBy(item).orderBy(F.desc("n"), F.coalesce("priority", F.lit(10**6)), "parent")
    best = votes.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(item, "parent", "n")
    return items.select(item).join(best, item, "left").select(item, F.coalesce("parent", F.lit("unknown")).alias("parent"), F.coalesce("n", F.lit(0)).alias("n"))


def root_family(edges: DataFrame) -> DataFrame:
    """(term, root): the nearest root, then the first by name."""
    pairs = closure(edges).join(roots(edges).select(V("term").alias("ancestor")), "ancestor")
    w = Window.partitionBy("descendant").orderBy("depth", "ancestor")
    return pairs.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(V("descendant").alias("term"), V("ancestor").alias("root"))


def rank_set_score(dense: DataFrame, sets: DataFrame) -> DataFrame:
    """Running-sum score per sample and set: largest excess of the members' rank-weighted steps over the others'."""
    ranked = dense.withColumn("_rank", average_rank(V("value"), "sample_id"))
    grid = ranked.crossJoin(sets.select("set_name").distinct()).join(sets.withColumn("_in", F.lit(1)), ["set_name", "feature_id"], "left")
    w = Window.partitionBy("sample_id", "set_name")
    grid = grid.withColumns({"_hit": F.when(V("_in") == 1, V("_rank")).otherwise(0.0), "_miss": F.when(V("_in") == 1, 0.0).otherwise(1.0)})
    o = w.orderBy(F.desc("_rank"), "feature_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    walk = F.coalesce(F.try_divide(F.sum("_hit").over(o), F.sum("_hit").over(w)), F.lit(0.0)) - F.coalesce(F.try_divide(F.sum("_miss").over(o), F.sum("_miss").over(w)), F.lit(0.0))
    return grid.withColumn("_walk", walk).groupBy("sample_id", "set_name").agg((F.greatest(F.max("_walk"), F.lit(0.0)) + F.least(F.min("_walk"), F.lit(0.0))).alias("score"))


def mean_z_score(dense: DataFrame, sets: DataFrame) -> DataFrame:
    spread = dense.groupBy("feature_id").agg(F.avg("value").alias("_mean"), F.stddev_pop("value").alias("_sd"), F.count("*").alias("_rows"))
    z = lookup(dense, spread, ["feature_id"], "_rows").withColumn("_z", F.coalesce(F.try_divide(V("value") - V("_mean"), V("_sd")), F.lit(0.0)))
    return z.join(sets, "feature_id").groupBy("sample_id", "set_name").agg(F.avg("_z").alias("score"))


def build_gene_sets(df: DataFrame, exclude: list[str], low: int, high: int) -> DataFrame:
    """(set_name, feature_id) pairs without some evidence codes, of sets within the size bounds."""
    kept = df.where(~V("code").isin(*exclude)).select("set_name", "feature_id").distinct()
    return kept.withColumn("_n", F.count("*").over(Window.partitionBy("set_name"))).where(V("_n").between(low, high)).drop("_n")


def pair_classifier(cells: DataFrame, pairs: DataFrame, intercept: float, positive: str, negative: str) -> DataFrame:
    """Score, probability and class from (a, b, coef): the intercept plus the coefficients of pairs with a above b; absent genes are 0."""
    samples = cells.select("sample_id").distinct()
    grid = samples.crossJoin(pairs)
    a, b = cells.select("sample_id", V("feature_id").alias("a"), V("value").alias("_a")), cells.select("sample_id", V("feature_id").alias("b"), V("value").alias("_b"))
    both = grid.join(a, ["sample_id", "a"], "left").join(b, ["sample_id", "b"], "left")
    over = F.coalesce("_a", F.lit(0.0)) > F.coalesce("_b", F.lit(0.0))
    out = both.groupBy("sample_id").agg((intercept + F.sum(F.when(over, V("coef")).otherwise(0.0))).alias("score"))
    p = 1 / (1 + F.exp(-V("score")))
    return out.withColumn("probability", p).withColumn("class", F.when(V("probability") >= 0.5, positive).otherwise(negative))
