"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Tables of so many narrow rows are broadcast whole, after a count.
SMALL = 10_000
_local: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a local one stands in where none is configured and all runs on one machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _local:
            _local.append("file://" + tempfile.mkdtemp(prefix="assaymill-"))
        folder = _local[0]
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: short lineage, nothing lost with an executor."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lookup(left: DataFrame, table: DataFrame, keys: list[str], rows: str, inner: bool = False) -> DataFrame:
    """Left-join ``table`` (one row per key; column ``rows``: its rows in ``left``) where a key may hold a third of ``left``.

    ``inner`` drops rows of ``left`` that the table lacks.

    Keys with over a thousandth of the rows are fewer than 1000, so their part of the table is
    broadcast under a proven bound; the other keys are joined through a shuffle. A table of SMALL rows
    at most is broadcast as it is.
    """
    total, size = table.agg(F.sum(rows), F.count("*")).first()
    value = [c for c in table.columns if c not in keys and c != rows]
    if size <= SMALL:
        return left.join(F.broadcast(table.select(*keys, *value)), keys, "inner" if inner else "left").select(*left.columns, *value)
    least = max(1000, total // 1000)
    if inner:
        often, seldom = (table.where(c).select(*keys, *value) for c in (F.col(rows) >= least, F.col(rows) < least))
        rest = left.join(F.broadcast(often.select(*keys)), keys, "left_anti").join(seldom, keys)
        return left.join(F.broadcast(often), keys).unionByName(rest).select(*left.columns, *value)
    hot = table.where(F.col(rows) >= least).select(*keys, *[F.col(c).alias(f"_hot_{c}") for c in value], F.lit(True).alias("_hot"))
    cold = table.where(F.col(rows) < least).select(*keys, *value, F.lit(True).alias("_cold"))
    out = left.join(F.broadcast(hot), keys, "left")
    # Rows served by the broadcast, and rows without a key, go to the shuffle under a hash of all they hold.
    spread = F.when(F.col("_hot") | F.concat(*[F.col(k).cast("string") for k in keys]).isNull(), F.xxhash64(*left.columns)).otherwise(F.lit(-1))
    out = out.withColumn("_spread", spread.cast("long")).join(cold.withColumn("_spread", F.lit(-1).cast("long")), [*keys, "_spread"], "left")
    picked = [F.when(F.col("_hot"), F.col(f"_hot_{c}")).otherwise(F.col(c)).alias(c) for c in value]
    return out.select(*left.columns, *picked)
