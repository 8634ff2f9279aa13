"""Filters, renames and joins on cells (sample_id, feature_id, value), obs and var."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def filter_levels(obs: DataFrame, keys: Sequence[str], low: int, high: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows whose level of every key has ``low`` to under ``high`` rows, and the levels left out (key, level, n)."""
    inside = lambda n: (n >= low) & (n < high if high is not None else F.lit(True))
    out = obs
    for k in keys:
        out = out.withColumn(f"_n_{k}", F.count("*").over(Window.partitionBy(k)))
    kept = out.where(reduce(lambda a, b: a & b, [inside(F.col(f"_n_{k}")) for k in keys])).drop(*[f"_n_{k}" for k in keys])
    gone = [obs.groupBy(F.col(k).cast("string").alias("level")).agg(F.count("*").alias("n")).where(~inside(F.col("n"))).select(F.lit(k).alias("key"), "level", "n") for k in keys]
    return kept, reduce(DataFrame.unionByName, gone)


def filter_samples(cells: DataFrame, min_counts: float = 0, min_features: int = 0) -> DataFrame:
    """Cells of samples with enough counts and features."""
    good = cells.groupBy("sample_id").agg(F.sum("value").alias("t"), F.count_if(F.col("value") > 0).alias("f"))
    return cells.join(good.where((F.col("t") >= min_counts) & (F.col("f") >= min_features)), "sample_id", "left_semi")


def filter_features(cells: DataFrame, n_samples: int, min_share: float = 0.1, min_counts: float = 0) -> DataFrame:
    """Cells of features seen in a share of the samples and with enough counts."""
    good = cells.groupBy("feature_id").agg(F.sum("value").alias("t"), F.count_if(F.col("value") > 0).alias("n"))
    return cells.join(good.where((F.col("n") >= min_share * n_samples) & (F.col("t") >= min_counts)), "feature_id", "left_semi")


def subset_features(cells: DataFrame, samples: DataFrame, features: DataFrame) -> DataFrame:
    """Every sample by every listed feature in the list's order (feature_id, position); absent cells are 0.

    The list is a model's feature list; the dense result is what is asked for.
    """
    grid = samples.select("sample_id").crossJoin(F.broadcast(features.select("feature_id", "position")))
    return grid.join(cells, ["sample_id", "feature_id"], "left").select("sample_id", "feature_id", "position", F.coalesce("value", F.lit(0.0)).alias("value"))


def missing_features(cells: DataFrame, features: DataFrame) -> DataFrame:
    return features.join(cells.select("feature_id").distinct(), "feature_id", "left_anti").select("feature_id")


def drop_features(cells: DataFrame, blacklist: DataFrame) -> DataFrame:
    return cells.join(blacklist.select("feature_id"), "feature_id", "left_anti")


def spec_mask(spec: Mapping[str, Mapping[str, str]], any_of: bool) -> Column:
    """A mask from {column: {value: exact | contains}}, joined by OR or AND."""
    parts = [(F.col(c) == v) if how == "exact" else F.col(c).rlike(v) for c, values in spec.items() for v, how in values.items()]
    return F.coalesce(reduce((lambda a, b: a | b) if any_of else (lambda a, b: a & b), parts), F.lit(False))


def spec_split(obs: DataFrame, spec: Mapping[str, Mapping[str, str]], any_of: bool = True) -> DataFrame:
    """Rows with ``role``: test where the mask holds, else train."""
    return obs.withColumn("role", F.when(spec_mask(spec, any_of), "test").otherwise("train"))


def named_splits(obs: DataFrame, splits: Mapping[str, Column], key: str = "sample_id") -> DataFrame:
    """(split, role, id) of several hold-outs, in one pass over ``obs``."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("split"), F.when(F.coalesce(m, F.lit(False)), "test").otherwise("train").alias("role")) for n, m in splits.items()]))
    return obs.select(key, each.alias("s")).select("s.split", "s.role", key)


def rename_features(features: DataFrame, mapping: DataFrame, old: str, new: str, synonym: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(feature_id, new_id) that the mapping knows, and the ids it does not; version suffixes are ignored."""
    bare = features.withColumn("_bare", F.regexp_replace(F.col("feature_id").cast("string"), r"\..*", ""))
    first = lambda c: mapping.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("_bare")).agg(F.min(new).alias(f"_{c}"))
    out = bare.join(first(old), "_bare", "left")
    new_id = F.col(f"_{old}")
    if synonym:
        out = out.join(first(synonym), "_bare", "left")
        new_id = F.coalesce(new_id, F.col(f"_{synonym}"))
    out = out.select("feature_id", new_id.alias("new_id"))
    return out.where("new_id is not null"), out.where("new_id is null").select("feature_id")


def replace_values(df: DataFrame, column: str, mapping: DataFrame, misses: str = "keep") -> DataFrame:
    """Replace by (old, new); values without a mapping are kept, dropped, or reported by an error."""
    out = df.join(mapping.select(F.col("old").alias(column), F.col("new").alias("_new")), column, "left")
    if misses == "error" and not out.where("_new is null").isEmpty():
        raise ValueError(f"{column}: values without a replacement")
    out = out.where("_new is not null") if misses == "drop" else out
    return out.withColumn(column, F.coalesce("_new", column)).select(*df.columns)


def first_match(rules: Sequence[tuple[Column, Column | str]], otherwise: Column | str | None = None) -> Column:
    """Ordered rules: the value of the first that holds."""
    out = F.lit(otherwise) if otherwise is None or isinstance(otherwise, str) else otherwise
    for test, value in reversed(list(rules)):
        out = F.when(test, value).otherwise(out)
    return out


def null_infinite(df: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Infinities as null, and how many there were."""
    bad = F.abs(column) == F.lit(float("inf"))
    return df.withColumn(column, F.when(bad, None).otherwise(F.col(column))), df.agg(F.count_if(bad).alias("n_infinite"))


def annotate_features(features: DataFrame, var: DataFrame, percent: Sequence[str] = ()) -> DataFrame:
    """Features with their metadata; percentages become fractions."""
    out = features.join(var, "feature_id", "left")
    return out.withColumns({c: F.col(c) / 100 for c in percent}) if percent else out


def concat_cells(sources: Mapping[str, DataFrame], how: str = "outer") -> DataFrame:
    """Union of cells tagged by ``source``; inner keeps features that every source has."""
    out = reduce(DataFrame.unionByName, [df.select("sample_id", "feature_id", "value", F.lit(n).alias("source")) for n, df in sources.items()])
    if how == "outer":
        return out
    return out.join(common_features(*sources.values()), "feature_id", "left_semi")


def common_features(*frames: DataFrame) -> DataFrame:
    """Features that all frames have; an error if there is none."""
    return reduce(DataFrame.intersect, [df.select("feature_id").distinct() for df in frames])


def relabel(obs: DataFrame, column: str, keep: Mapping[str, str], overrides: DataFrame | None = None) -> DataFrame:
    """Keep and rename some classes, call the rest ``other``; overrides (sample_id, label) win."""
    new = F.lit("other")
    for old, name in keep.items():
        new = F.when(F.col(column) == old, name).otherwise(new)
    if overrides is None:
        return obs.withColumn("label", new)
    return obs.join(overrides.select("sample_id", F.col("label").alias("_over")), "sample_id", "left").withColumn("label", F.coalesce("_over", new)).drop("_over")


def effect_class(a: Column, b: Column, t: float) -> Column:
    """Three-way class from two standardised effects."""
    return F.when((a >= t) & (b >= t), "both").when((a >= t) | (b >= t), "one").otherwise("none")


def in_ranges(cells: DataFrame, ranges: DataFrame, how: str = "binary") -> DataFrame:
    """Cells inside one of their feature's ranges (feature_id, lo, hi) as 1, or as the range's mean or median; others as 0.

    Ranges are few per feature: a feature's are one row, which its cells look through, so cells are joined by feature alone.
    """
    if how == "binary":
        given = ranges.select("feature_id", "lo", "hi", F.lit(1.0).alias("_new"))
    else:
        hit = (cells["feature_id"] == ranges["feature_id"]) & cells["value"].between(ranges["lo"], ranges["hi"])
        inside = cells.join(ranges, hit).select(cells["feature_id"], "value", "lo")
        stat = inside.groupBy("feature_id", "lo").agg((F.avg("value") if how == "mean" else F.median("value")).alias("_new"))
        given = ranges.select("feature_id", "lo", "hi").join(stat, ["feature_id", "lo"])
    held = given.groupBy("feature_id").agg(F.collect_list(F.struct("lo", "hi", "_new")).alias("_ranges"))
    met = F.filter("_ranges", lambda r: F.col("value").between(r["lo"], r["hi"]))
    return cells.join(held, "feature_id", "left").select("sample_id", "feature_id", F.coalesce(F.array_min(F.transform(met, lambda r: r["_new"])), F.lit(0.0)).alias("value"))


def mask_negative(cells: DataFrame, contributions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cells whose contribution (sample_id, feature_id, contribution) is below 0 become 0; cells without one stay. With ``by`` (a class, a model) there is one result per value of it."""
    grid = cells.crossJoin(contributions.select(*by).distinct()) if by else cells
    keys = [*by, "sample_id", "feature_id"]
    out = grid.join(contributions.select(*keys, F.col("contribution").alias("_c")), keys, "left")
    return out.select(*keys, F.when(F.col("_c") < 0, 0.0).otherwise(F.col("value")).alias("value"))
