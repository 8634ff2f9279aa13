"""Orders over all rows, or over groups of any size, without a task that holds them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assaymill.storage import materialize


def same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``a`` with the columns that ``b`` (one row per key) adds; null keys are equal."""
    other = b.withColumnsRenamed({k: f"_same_{i}" for i, k in enumerate(keys)})
    met = F.lit(True)
    for i, k in enumerate(keys):
        met = met & a[k].eqNullSafe(other[f"_same_{i}"])
    return a.join(other, met).drop(*[f"_same_{i}" for i in range(len(keys))])


def ordered(df: DataFrame, order: Sequence[Column | str], by: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``_nth`` and ``_rank`` (ties share it) of each row in its group, ``_rows`` of the group, and ``_part``.

    Rows are range-partitioned by group and order, so parts are in order, rows of equal order share one, and a group of any size is dealt
    to many. What earlier parts hold of a group is added from one row per group and part. The parts are
    written, since a range partitioning drawn anew might differ.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    part = df.repartitionByRange(*[F.asc_nulls_first(c) for c in by], *keys).withColumn("_part", F.spark_partition_id())
    w = Window.partitionBy("_part", *by).orderBy(*keys)
    found = materialize(part.withColumns({"_nth": F.row_number().over(w).cast("long"), "_rank": F.rank().over(w).cast("long")}), "ordered")
    held = found.groupBy(*by, "_part").agg(F.count("*").alias("_here"))
    group = Window.partitionBy(*by)
    held = held.select(*by, "_part", carried(F.sum("_here"), by).alias("_before"), F.sum("_here").over(group).alias("_rows"))
    out = same(found, held, [*by, "_part"])
    return out.withColumns({"_nth": F.col("_nth") + F.coalesce("_before", F.lit(0)), "_rank": F.col("_rank") + F.coalesce("_before", F.lit(0))}).drop("_before")


def carried(what: Column, by: Sequence[str] = (), later: bool = False) -> Column:
    """An aggregate over the parts of ``ordered`` before a row's own (or after it); null where there is none. For tables of one row per group and part."""
    w = Window.partitionBy(*by).orderBy("_part")
    return what.over(w.rowsBetween(1, Window.unboundedFollowing) if later else w.rowsBetween(Window.unboundedPreceding, -1))


def running_sum(df: DataFrame, value: str, order: Sequence[Column | str]) -> DataFrame:
    """``ordered`` with ``_upto``, the sum of ``value`` up to each row, and ``_total``, over all rows."""
    rows = ordered(df, order)
    parts = rows.groupBy("_part").agg(F.sum(value).alias("_sum"))
    parts = parts.select("_part", F.coalesce(carried(F.sum("_sum")), F.lit(0)).alias("_earlier"), F.sum("_sum").over(Window.partitionBy()).alias("_total"))
    inside = F.sum(value).over(Window.partitionBy("_part").orderBy("_nth").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return same(rows, parts, ["_part"]).withColumn("_upto", inside + F.col("_earlier"))


def tile(n: int) -> Column:
    """Which of ``n`` tiles as equal as can be, the larger ones first, holds a row of ``ordered``."""
    each, more = F.floor(F.col("_rows") / n), F.col("_rows") % n
    first = more * (each + 1)
    return F.when(F.col("_nth") <= first, F.ceil(F.col("_nth") / (each + 1))).otherwise(more + F.ceil((F.col("_nth") - first) / F.greatest(each, F.lit(1)))).cast("int")
