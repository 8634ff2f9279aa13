"""Readers and writers of count tables, mappings, gene sets and result files."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Summary rows of count files.
SUMMARY_ROWS = ("N_unmapped", "N_multimapping", "N_noFeature", "N_ambiguous")
COUNT_COLUMNS = "gene_id string, gene_name string, gene_type string, unstranded long, stranded_first long, stranded_second long, tpm_unstranded double"


def read_count_files(spark: SparkSession, paths: str | Sequence[str], count_col: str = "unstranded", schema: str = COUNT_COLUMNS, blacklist: Sequence[str] = SUMMARY_ROWS) -> DataFrame:
    """Tab-separated count files with comment lines as (file, feature_id, value); many files are one read."""
    raw = spark.read.csv(paths if isinstance(paths, str) else list(paths), sep="\t", comment="#", header=True, schema=schema)
    return raw.where(~F.col("gene_id").isin(*blacklist)).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("gene_id").alias("feature_id"), F.col(count_col).cast("double").alias("value"))


def collect_counts(cells: DataFrame, sheet: DataFrame, cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells (file, feature_id, value) with their sample and case attached, and the sheet's files that are missing.

    In long form the outer join of many one-sample files by gene is a union.
    """
    known = cells.join(sheet, "file").join(cases, "case_id", "left")
    return known, sheet.join(cells.select("file").distinct(), "file", "left_anti")


def wide_to_long(wide: DataFrame, id_col: str, samples: Sequence[str]) -> DataFrame:
    """A genes-by-samples frame as (feature_id, sample_id, value)."""
    return wide.unpivot([id_col], list(samples), "sample_id", "value").withColumnRenamed(id_col, "feature_id")


def long_to_wide(cells: DataFrame, samples: Sequence, feature: str = "feature_id", sample: str = "sample_id", value: str = "value") -> DataFrame:
    """One row per feature and one column per sample; absent cells are 0."""
    return cells.groupBy(feature).pivot(sample, list(samples)).agg(F.first(value)).fillna(0.0)


def wide_export(cells: DataFrame, obs: DataFrame, project: str, symbol: str, columns: Sequence[str]) -> DataFrame:
    """Features by ``project_sample`` columns, without null symbols."""
    named = cells.join(obs, "sample_id").where(F.col(symbol).isNotNull()).withColumn("_name", F.concat_ws("_", F.col(project), F.col("sample_id").cast("string")))
    return named.groupBy(symbol).pivot("_name", list(columns)).agg(F.first("value"))


def read_mapping(spark: SparkSession, path: str, schema: str, sep: str = "\t") -> DataFrame:
    """Id mappings, ontology and family tables, under a declared schema."""
    return spark.read.csv(path, sep=sep, header=True, schema=schema)


def gene_sets(spark: SparkSession, sets: Mapping[str, Sequence[str]]) -> DataFrame:
    """A mapping of set name to members as (set_name, feature_id)."""
    return spark.createDataFrame([(k, list(v)) for k, v in sets.items()], "set_name string, members array<string>").select("set_name", F.explode("members").alias("feature_id"))


def read_feature_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Text files of one id a line as (list, feature_id)."""
    return spark.read.text(folder).where(F.trim("value") != "").select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1).alias("list"), F.trim("value").alias("feature_id"))


def gather_results(spark: SparkSession, pattern: str, schema: str, values: Sequence[str], keys: Sequence[str] = ("fold",)) -> DataFrame:
    """Result files of many models as one long table; the model is the file's folder."""
    raw = spark.read.csv(pattern, header=True, schema=schema).withColumn("model", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))
    return raw.unpivot(["model", *keys], list(values), "metric", "value")


def harmonise(sources: Sequence[tuple[DataFrame, Mapping[str, str]]], id_col: str) -> DataFrame:
    """Union of sources over their shared columns after renaming; rows with null or repeated ids are dropped."""
    renamed = [df.select(*[F.col(c).alias(names.get(c, c)) for c in df.columns]).where(F.col(names.get(id_col, id_col)).isNotNull()).dropDuplicates([id_col]) for df, names in sources]
    shared = [c for c in renamed[0].columns if all(c in df.columns for df in renamed)]
    return reduce(DataFrame.unionByName, [df.select(*shared) for df in renamed])


def sample_inventory(names: DataFrame, name: str = "name") -> DataFrame:
    """Per case, which kinds of samples its file names show: B, C or BC, and how many files."""
    case = F.regexp_replace(F.regexp_replace(F.col(name), r"^[^#]*#", ""), r"[0-9]+$", "")
    kind = lambda digits: F.bool_or(F.col(name).rlike(f"[{digits}]$"))
    out = names.withColumn("case_key", case).groupBy("case_key").agg(kind("0-4").alias("b"), kind("5-9").alias("c"), F.count("*").alias("n_files"))
    return out.select("case_key", F.when(F.col("b") & F.col("c"), "BC").when(F.col("b"), "B").when(F.col("c"), "C").otherwise("none").alias("available"), "n_files")


def cached(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; computed and written first if it is not there."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    there = hadoop.Path(f"{path}/_SUCCESS")
    if not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def cached_rounds(spark: SparkSession, path: str, rounds: int, compute: Callable[[int], DataFrame]) -> DataFrame:
    """The union of ``rounds`` results with their number; rounds already written are not computed again."""
    parts = [cached(spark, f"{path}/round={i}", lambda i=i: compute(i)).withColumn("round", F.lit(i)) for i in range(rounds)]
    return reduce(DataFrame.unionByName, parts)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", by: Sequence[str] = ()) -> None:
    """Write as parquet, csv (with a header) or text, partitioned if asked."""
    writer = df.write.mode("overwrite").partitionBy(*by) if by else df.write.mode("overwrite")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def strand_totals(counts: DataFrame, columns: Sequence[str], sample: str = "sample_id") -> DataFrame:
    """Totals of the count columns per sample: which strand protocol a file follows."""
    return counts.groupBy(sample).agg(*[F.sum(c).alias(c) for c in columns])


def pseudobulk(cells: DataFrame, obs: DataFrame, group: Column, how: str = "sum") -> DataFrame:
    """Cells summed or averaged per group of samples; the mean divides by the group's samples, so absent cells count as 0."""
    tagged = obs.select("sample_id", group.alias("group_id"))
    out = cells.join(tagged, "sample_id").groupBy("group_id", "feature_id").agg(F.sum("value").alias("value"))
    if how == "sum":
        return out
    sizes = tagged.groupBy("group_id").agg(F.count("*").alias("_n"))
    return out.join(sizes, "group_id").select("group_id", "feature_id", (F.col("value") / F.col("_n")).alias("value"))
