"""Products of features over all samples, block by block, and what follows from them: proportionality and principal components.

Features are dealt to blocks and samples to slices by hash. A cell goes to the pairs of blocks that its own block is part
of, so a task multiplies two small matrices, one slice of two blocks, and no row holds a pair of features of one sample. Cells
stay sparse: an absent cell is 0 and adds nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaymill.storage import materialize

V = F.col
#: Features of a block and samples of a slice, about.
BLOCK, SLICE = 512, 4096
#: Features whose covariances the driver may hold (8 MB).
MOST_FEATURES = 1024


def gram(cells: DataFrame, features: DataFrame, n_samples: int, block: int = BLOCK, rows: int = SLICE) -> DataFrame:
    """(x, y, product): the sum over samples of the product of two features' values, for all x <= y of ``features``; ``cells`` of others are left out."""
    p, kind = features.select("feature_id").distinct().count(), dict(features.dtypes)["feature_id"]
    blocks, slices = -(-max(p, 1) // block), -(-max(n_samples, 1) // rows)
    own = F.pmod(F.xxhash64("feature_id"), F.lit(blocks)).cast("int")
    known = features.select("feature_id").distinct()
    held = cells.join(known, "feature_id", "left_semi").where("value <> 0").select("feature_id", V("value").cast("double").alias("value"), F.xxhash64("sample_id").alias("row"), F.pmod(F.xxhash64("sample_id", F.lit(1)), F.lit(slices)).cast("int").alias("slice"))
    # one zero of each feature, so that pairs that never meet have a product too
    held = held.unionByName(known.select("feature_id", F.lit(0.0).alias("value"), F.lit(0).cast("long").alias("row"), F.lit(0).alias("slice")))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = held.withColumn("own", own).withColumn("_other", other).select("slice", F.least("own", "_other").alias("i"), F.greatest("own", "_other").alias("j"), "own", "feature_id", "row", "value")

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        row, samples = pd.factorize(pdf["row"])
        sides = []
        for b in (i, j):
            part = (pdf["own"] == b).to_numpy()
            at, names = pd.factorize(pdf["feature_id"][part])
            m = np.zeros((len(samples), len(names)))
            np.add.at(m, (row[part], at), pdf["value"].to_numpy()[part])
            sides.append((m, np.asarray(names)))
        (a, x), (b, y) = sides
        product = a.T @ b
        x, y, product = np.repeat(x, len(y)), np.tile(y, len(x)), product.ravel()
        if i == j:
            keep = x <= y
            x, y, product = x[keep], y[keep], product[keep]
        swap = x > y
        return pd.DataFrame({"x": np.where(swap, y, x), "y": np.where(swap, x, y), "product": product})

    parts = dealt.groupBy("slice", "i", "j").applyInPandas(multiply, f"x {kind}, y {kind}, product double")
    return parts.groupBy("x", "y").agg(F.sum("product").alias("product"))


def covariances(cells: DataFrame, features: DataFrame, n_samples: int) -> tuple[DataFrame, DataFrame]:
    """((x, y, cov) for all x <= y, (feature_id, mean)): sample covariances, absent cells as 0."""
    sums = features.select("feature_id").distinct().join(cells.groupBy("feature_id").agg(F.sum("value").cast("double").alias("_s")), "feature_id", "left")
    mean = sums.select("feature_id", (F.coalesce("_s", F.lit(0.0)) / n_samples).alias("mean"))
    g = gram(cells, features, n_samples)
    g = g.join(mean.toDF("x", "_mx"), "x").join(mean.toDF("y", "_my"), "y")
    return g.select("x", "y", ((V("product") - n_samples * V("_mx") * V("_my")) / max(n_samples - 1, 1)).alias("cov")), mean


def proportionality(cells: DataFrame, n_samples: int | None = None, features: DataFrame | None = None) -> DataFrame:
    """(x, y, phi, rho, corr) for pairs x < y of features of log values; phi divides by the variance of x. An absent cell is 0."""
    n = cells.select("sample_id").distinct().count() if n_samples is None else n_samples
    cov, _ = covariances(cells, cells if features is None else features, n)
    cov = materialize(cov, "covariances")
    spread = cov.where("x = y").select(V("x").alias("feature_id"), F.greatest("cov", F.lit(0.0)).alias("_v"))
    p = cov.where("x < y").join(spread.toDF("x", "_va"), "x").join(spread.toDF("y", "_vb"), "y")
    return p.select("x", "y", F.try_divide(V("_va") + V("_vb") - 2 * V("cov"), V("_va")).alias("phi"), F.try_divide(2 * V("cov"), V("_va") + V("_vb")).alias("rho"), F.try_divide("cov", F.sqrt(V("_va") * V("_vb"))).alias("corr"))


class Components:
    """Principal components of cells: ``variances`` (component, variance, share), ``loadings`` (feature_id, component, weight), ``scores``.

    Covariances are block products; only their square of at most MOST_FEATURES features is decomposed on the driver, so select features
    first where there are more. A component's sign makes its largest weight positive (the first by name of equal ones).
    """

    def __init__(self, cells: DataFrame, features: DataFrame, n_samples: int, k: int):
        p = features.select("feature_id").distinct().count()
        if p > MOST_FEATURES:
            raise ValueError(f"{p} features; select at most {MOST_FEATURES}")
        spark = cells.sparkSession
        cov, mean = covariances(cells, features, n_samples)
        found = cov.toPandas()
        names = sorted(set(found["x"]) | set(found["y"]))
        at = {f: i for i, f in enumerate(names)}
        square = np.zeros((len(names), len(names)))
        i, j = found["x"].map(at).to_numpy(int), found["y"].map(at).to_numpy(int)
        square[i, j] = square[j, i] = found["cov"]
        value, vector = np.linalg.eigh(square)
        value, vector = np.maximum(value[::-1][:k], 0.0), vector[:, ::-1][:, :k]
        top = np.abs(np.round(vector, 9)).argmax(0) if len(names) else []
        vector = vector * np.sign(vector[top, np.arange(vector.shape[1])])
        total = float(np.trace(square))
        self.variances = spark.createDataFrame([(c + 1, float(v), float(v) / total if total > 0 else None) for c, v in enumerate(value)], "component int, variance double, share double")
        kind = dict(features.dtypes)["feature_id"]
        self.loadings = spark.createDataFrame([(f, c + 1, float(vector[i, c])) for i, f in enumerate(names) for c in range(vector.shape[1])], f"feature_id {kind}, component int, weight double")
        self.mean = mean

    def scores(self, cells: DataFrame, samples: DataFrame) -> DataFrame:
        """(sample_id, component, score) of all ``samples``, centred by the fitted means; also of samples that were not fitted."""
        centre = self.loadings.join(self.mean, "feature_id").groupBy("component").agg(F.sum(V("weight") * V("mean")).alias("_c"))
        found = cells.join(self.loadings, "feature_id").groupBy("sample_id", "component").agg(F.sum(V("value") * V("weight")).alias("_s"))
        return samples.select("sample_id").crossJoin(centre).join(found, ["sample_id", "component"], "left").select("sample_id", "component", (F.coalesce("_s", F.lit(0.0)) - V("_c")).alias("score"))
