"""Column expressions that several operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def average_rank(order: Column, *by: str) -> Column:
    """Rank from 1 within ``by``, tied values sharing the mean of their ranks."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(order)) + (F.count("*").over(w.partitionBy(*by, order)) - 1) / 2


def hash_order(key: str, seed: int) -> Column:
    """Reproducible random order: md5 of the seed and the key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))


def gini(counts: list[Column] | Column, total: Column) -> Column:
    """Impurity term p(1 - p) of a count."""
    p = counts / total
    return p * (1 - p)


def running(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def bucket_project(project: Column) -> Column:
    """Project family from its id's prefix."""
    out = F.lit("other")
    for name in ("CHULA", "GSE", "CGCI", "CPTAC", "TARGET", "TCGA"):
        out = F.when(project.startswith(name), F.lit(name)).otherwise(out)
    return out


def bucket_biotype(biotype: Column) -> Column:
    """Coarse gene biotype."""
    return (
        F.when(biotype == "protein_coding", "protein_coding")
        .when(biotype.rlike("pseudogene"), "pseudogene")
        .when(biotype.rlike("(?i)lnc|lincRNA|antisense"), "lncRNA")
        .when(biotype.rlike("(?i)RNA"), "ncRNA")
        .otherwise("other")
    )


def clean_label(label: Column) -> Column:
    """Lower case, blanks and hyphens as underscores, no commas."""
    return F.regexp_replace(F.regexp_replace(F.lower(label), "[ -]", "_"), ",", "")


def hash_rank(df: DataFrame, key: str, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``_r``, the row's place in hash order within its group, and ``_n``, the group's rows.

    Rows are ordered within the first three digits of their hash, 4096 parts of a group, and the parts' counts give
    what comes before: no task orders a whole group, however few groups there are.
    """
    marked = df.withColumns({"_hash": hash_order(key, seed), "_part": F.substring(hash_order(key, seed), 1, 3)})
    group = [f"_by{i}" for i in range(len(by))]
    counts = marked.groupBy(*[F.col(c).alias(g) for c, g in zip(by, group, strict=True)], F.col("_part").alias("_at")).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*group)
    before = F.coalesce(F.sum("_c").over(w.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*group, "_at", before.alias("_before"), F.sum("_c").over(w).alias("_n"))
    same = F.col("_part") == F.col("_at")
    for c, g in zip(by, group, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(g))
    nth = F.row_number().over(Window.partitionBy(*by, "_part").orderBy("_hash", key))
    return marked.join(counts, same).withColumn("_r", F.col("_before") + nth).select(*df.columns, "_r", "_n")


def value_ranks(df: DataFrame, value: str, parts: int = 64) -> DataFrame:
    """(value, rank, n): the mean rank from 1 of each distinct value over all rows, and its rows.

    Equal values are counted first; distinct values are ordered within ranges whose edges are approximate quantiles.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("value")).agg(F.count("*").alias("n"))
    edges = counts.agg(F.percentile_approx("value", [i / parts for i in range(1, parts)], 10_000)).first()[0] or []
    part = sum((F.col("value") >= e).cast("int") for e in sorted(set(edges))) if edges else F.lit(0)
    counts = counts.withColumn("_part", part)
    totals = counts.groupBy("_part").agg(F.sum("n").alias("_c"))
    totals = totals.select(F.col("_part").alias("_at"), F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    upto = F.sum("n").over(Window.partitionBy("_part").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = counts.join(totals, F.col("_part") == F.col("_at")).withColumn("_upto", F.col("_before") + upto)
    return out.select("value", (F.col("_upto") - (F.col("n") - 1) / 2).alias("rank"), "n")
