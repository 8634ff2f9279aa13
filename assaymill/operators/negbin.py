"""Batch correction of counts by negative binomials: a fitted model, and counts mapped by quantiles to the reference batch or to the mean of all.

A feature's mean in a batch and group is the product of a batch and a group factor. A batch has one dispersion for all features, by Newton's
steps on its likelihood over counts of equal value, so each step is a sum. What a value becomes is worked out once for each distinct
(feature, batch, group, value), by the distribution function as an incomplete beta function and its inverse by halving.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaymill.functions.tails import digamma, ln_beta_tail, trigamma
from assaymill.storage import materialize

V = F.col
#: Sizes (inverse dispersions) are kept within these.
LEAST_SIZE, MOST_SIZE = 1e-3, 1e4
#: A batch factor this far (in logarithms) under the reference's is not scaled past the reference's largest mean.
CAP = -0.2
#: Values whose distribution function is within this of 1 stay as they are.
OUTLIER = 1e-6
#: Distinct values that a task maps.
TASK_VALUES = 500


def _by(names: list[str], values: list[float], of: Column) -> Column:
    """A number for each of a few names."""
    return F.create_map(*[F.lit(x) for pair in zip(names, map(float, values), strict=True) for x in pair])[of]


def checked(obs: DataFrame, batch: str, group: str | None) -> tuple[DataFrame, list]:
    """((sample_id, batch, grp), rows of batch, grp and n), or an error: a batch of one sample, or groups confounded with batches."""
    tagged = obs.select("sample_id", V(batch).cast("string").alias("batch"), (F.lit("") if group is None else V(group).cast("string")).alias("grp")).where("batch IS NOT NULL AND grp IS NOT NULL")
    rows = tagged.groupBy("batch", "grp").agg(F.count("*").alias("n")).orderBy("batch", "grp").collect()
    sizes: dict[str, int] = {}
    for r in rows:
        sizes[r["batch"]] = sizes.get(r["batch"], 0) + r["n"]
    if alone := [b for b, n in sizes.items() if n < 2]:
        raise ValueError(f"batches of one sample: {', '.join(alone)}")
    # Factors can be told apart where every batch is linked to every other by shared groups.
    linked, left = {rows[0]["batch"]} if rows else set(), set(sizes)
    while True:
        groups = {r["grp"] for r in rows if r["batch"] in linked}
        more = {r["batch"] for r in rows if r["grp"] in groups}
        if more == linked:
            break
        linked = more
    if left - linked:
        raise ValueError(f"groups are confounded with batches: {', '.join(sorted(left - linked))} share none with the others")
    return tagged, rows


def _factors(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batch and group factors of each feature by iterative scaling: fitted sums equal the data's by batch and by group."""
    for pdf in pdfs:
        out = []
        for feature, cells in zip(pdf["feature_id"], pdf["cells"], strict=True):
            names = [[c[k] for c in cells] for k in ("batch", "grp")]
            (b, bs), (g, gs) = (pd.factorize(np.array(x, object), sort=True) for x in names)
            n, s = np.zeros((len(bs), len(gs))), np.zeros((len(bs), len(gs)))
            n[b, g], s[b, g] = [c["n"] for c in cells], [c["s"] for c in cells]
            one, two = np.ones(len(bs)), np.ones(len(gs))
            for _ in range(500):
                last = one
                one = s.sum(1) / np.maximum((n * two).sum(1), 1e-300)
                two = s.sum(0) / np.maximum((n * one[:, None]).sum(0), 1e-300)
                if np.abs(one / np.maximum(last, 1e-300) - 1).max() < 1e-12:
                    break
            scale = two.mean() if two.mean() > 0 else 1.0
            out.append(pd.DataFrame({"feature_id": feature, "batch": bs[b], "grp": gs[g], "mu": np.maximum((one[:, None] * two)[b, g], 1e-4), "ln_a": np.log(one[b] * scale), "c": two[g] / scale}))
        yield pd.concat(out) if out else pd.DataFrame({"feature_id": [], "batch": [], "grp": [], "mu": [], "ln_a": [], "c": []})


def ln_cdf(value: Column, mu: Column, size: Column) -> Column:
    """ln P(X <= value) of a negative binomial with mean ``mu`` and variance mu + mu ** 2 / size."""
    return F.when(value < 0, F.lit(float("-inf"))).otherwise(ln_beta_tail(size / (size + mu), mu / (size + mu), size, value + 1.0))


def quantile(ln_p: Column, mu: Column, size: Column) -> Column:
    """The least whole number whose distribution function reaches exp(ln_p), below 1 - OUTLIER: by halving below a bound of Cantelli's inequality."""
    top = F.ceil(mu + F.sqrt((mu + mu * mu / size) / OUTLIER)).cast("long") + 1
    start = F.struct(F.lit(-1).cast("long").alias("low"), top.alias("high"))

    def half(s: Column, _: Column) -> Column:
        mid = F.floor((s["low"] + s["high"]) / 2).cast("long")
        reached = ln_cdf(mid.cast("double"), mu, size) >= ln_p - 1e-9
        return F.when(s["high"] - s["low"] <= 1, s).when(reached, F.struct(s["low"].alias("low"), mid.alias("high"))).otherwise(F.struct(mid.alias("low"), s["high"].alias("high")))

    return F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(top + 2.0)).cast("int")), start, half)["high"]


@dataclass
class BatchModel:
    """``means`` (feature_id, batch, grp, mu, ln_a, c), ``sizes`` by batch, and the reference batch (None: the mean of all)."""

    tagged: DataFrame
    counts: DataFrame
    means: DataFrame
    sizes: dict[str, float]
    samples: dict[str, int]
    reference: str | None

    def mapping(self) -> DataFrame:
        """(feature_id, batch, grp, value, new) of every distinct value of the fitted counts."""
        names = list(self.sizes)
        if self.reference is None:
            target = self.means.select("feature_id", "batch", "ln_a").distinct().groupBy("feature_id").agg(F.sum(V("ln_a") * _by(names, [self.samples[b] for b in names], V("batch"))).alias("_to"))
            target = target.withColumn("_to", V("_to") / sum(self.samples.values())).withColumn("_most", F.lit(float("inf")))
            size = 1 / (sum(1 / x for x in self.sizes.values()) / len(self.sizes))
        else:
            own = self.means.where(V("batch") == self.reference)
            target, size = own.groupBy("feature_id").agg(F.first("ln_a").alias("_to"), F.max("mu").alias("_most")), self.sizes[self.reference]
        rows = self.counts.join(self.means, ["feature_id", "batch", "grp"]).join(target, "feature_id").withColumn("_gamma", V("ln_a") - V("_to"))
        # A given number is not coalesced: the work is in the halvings, not in the bytes.
        rows = rows.repartition(max(1, min(2000, -(-self.counts.count() // TASK_VALUES))), "feature_id", "batch", "grp", "value")
        new_mu = F.greatest(V("mu") * F.exp(-V("_gamma")), F.lit(1e-12))
        new_mu = F.when(V("_gamma") < CAP, F.least(new_mu, V("_most"))).otherwise(new_mu)
        rows = rows.withColumns({"_new_mu": new_mu, "_ln_p": ln_cdf(V("value").cast("double"), V("mu"), _by(names, list(self.sizes.values()), V("batch")))})
        stays = (V("batch") == self.reference) if self.reference is not None else F.lit(False)
        new = F.when(stays | (V("_ln_p") > log(1 - OUTLIER)), V("value")).otherwise(quantile(V("_ln_p"), V("_new_mu"), F.lit(size)))
        return rows.select("feature_id", "batch", "grp", "value", new.alias("new"))

    def adjust(self, dense: DataFrame) -> DataFrame:
        """The counts that were fitted, mapped; ``dense`` has every feature of every sample, so that zeros are mapped too. Features that were left out stay as they are."""
        rows = dense.join(self.tagged, "sample_id", "left").withColumn("_value", F.round("value").cast("long"))
        table = materialize(self.mapping(), "mapping").withColumnsRenamed({"value": "_value", "new": "_new"})
        return rows.join(table, ["feature_id", "batch", "grp", "_value"], "left").select("sample_id", "feature_id", F.coalesce(V("_new").cast("double"), V("value")).alias("value"))


def fit(cells: DataFrame, obs: DataFrame, batch: str, group: str | None = None, reference: str | None = None, to_mean: bool = False, steps: int = 40) -> BatchModel:
    """A model of counts (absent cells are 0; rounded). The batch of least dispersion is the reference unless one is named, or all go ``to_mean``.

    Features without a count in some batch are left out. A batch of one sample and groups confounded with batches are errors. Of the data, the driver sees one row per batch and group.
    """
    tagged, rows = checked(obs, batch, group)
    names = sorted({r["batch"] for r in rows})
    if reference is not None and reference not in names:
        raise ValueError(f"no batch {reference}")
    samples = {b: sum(r["n"] for r in rows if r["batch"] == b) for b in names}
    held = cells.join(tagged, "sample_id").withColumn("value", F.round("value").cast("long")).where("value > 0").groupBy("feature_id", "batch", "grp", "value").agg(F.count("*").alias("n"))
    held = materialize(held, "counts")
    everywhere = held.groupBy("feature_id").agg(F.count_distinct("batch").alias("_b")).where(V("_b") == len(names)).select("feature_id")
    held = held.join(everywhere, "feature_id", "left_semi")
    spark = cells.sparkSession
    grid = everywhere.crossJoin(spark.createDataFrame([(r["batch"], r["grp"], r["n"]) for r in rows], "batch string, grp string, _all long"))
    sums = held.groupBy("feature_id", "batch", "grp").agg(F.sum("n").alias("_n"), F.sum(V("n") * V("value")).alias("_s"))
    grid = materialize(grid.join(sums, ["feature_id", "batch", "grp"], "left").fillna(0, ["_n", "_s"]), "sums")
    zeros = grid.where("_all > _n").select("feature_id", "batch", "grp", F.lit(0).cast("long").alias("value"), (V("_all") - V("_n")).alias("n"))
    counts = materialize(held.unionByName(zeros), "counts")
    cell = F.struct("batch", "grp", V("_all").cast("double").alias("n"), V("_s").cast("double").alias("s"))
    means = grid.groupBy("feature_id").agg(F.collect_list(cell).alias("cells"))  # as many as there are batches by groups
    means = materialize(means.mapInPandas(_factors, f"feature_id {dict(cells.dtypes)['feature_id']}, batch string, grp string, mu double, ln_a double, c double"), "means")
    data = materialize(counts.join(means, ["feature_id", "batch", "grp"]).select("batch", V("value").cast("double").alias("v"), "mu", "n"), "likelihood")

    start = data.groupBy("batch").agg(F.sum(V("n") * V("mu") * V("mu")).alias("a"), F.sum(V("n") * ((V("v") - V("mu")) * (V("v") - V("mu")) - V("mu"))).alias("b")).collect()
    at = {r["batch"]: log(min(max(r["a"] / max(r["b"], 1e-9), LEAST_SIZE), MOST_SIZE)) for r in start}
    for _ in range(steps):
        if not at:
            break
        r = _by(list(at), [exp(x) for x in at.values()], V("batch"))
        slope = digamma(V("v") + V("_r")) - digamma(V("_r")) + F.ln(V("_r") / (V("_r") + V("mu"))) + 1 - (V("v") + V("_r")) / (V("_r") + V("mu"))
        bend = trigamma(V("v") + V("_r")) - trigamma(V("_r")) + 1 / V("_r") - 1 / (V("_r") + V("mu")) - (V("mu") - V("v")) / ((V("_r") + V("mu")) * (V("_r") + V("mu")))
        found, far = data.withColumn("_r", r).groupBy("batch").agg(F.sum(V("n") * slope).alias("s"), F.sum(V("n") * bend).alias("b")).collect(), 0.0
        for row in found:
            size = exp(at[row["batch"]])
            g, h = size * row["s"], size * row["s"] + size * size * row["b"]
            move = max(-1.0, min(1.0, -g / h)) if h < 0 else (0.5 if g > 0 else -0.5)
            new = min(max(at[row["batch"]] + move, log(LEAST_SIZE)), log(MOST_SIZE))
            far, at[row["batch"]] = max(far, abs(new - at[row["batch"]])), new
        if far < 1e-9:
            break
    sizes = {b: exp(at.get(b, log(MOST_SIZE))) for b in names}
    return BatchModel(tagged, counts, means, sizes, samples, None if to_mean else reference or max(names, key=lambda b: (round(sizes[b], 9), [-ord(c) for c in b])))
