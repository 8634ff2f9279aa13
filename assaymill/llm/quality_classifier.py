"""Quality classifier: hierarchical empirical Bayes over a text classifier and the sites of its documents.

A linear classifier on hashed words and a few text statistics is fitted in numpy on a bounded sample of
labelled rows and calibrated on a part set aside; its calibrated log-odds less the sample's own are a
document's evidence. Sites form two levels, host and path. A host's share of good documents is
shrunk towards the global share, a path's towards its host's, by Beta priors whose strength comes
from the spread between sites (moments); so sparse sites follow the level above. A document's
posterior adds its evidence to the log-odds of its path; it is itself left out of its path, its host and
the global share. Sites are summed by
grouped aggregation, and looked up so that a host with a third of the rows stays spread.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaymill.llm._words import blocks, words
from assaymill.storage import lookup, materialize

BUCKETS, STATISTICS = 1 << 15, 6
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per block: bucket of each word, words' bounds of each text, and the texts' statistics."""
    for a, b, data, offsets in blocks(texts):
        w = words(data, offsets)
        n = np.maximum(np.diff(w.bounds), 1)
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[offsets])
        size = np.maximum(np.diff(offsets), 1)
        letters = np.bincount(w.docs(), w.end - w.start, b - a)
        code = w.hashes()
        distinct = np.array([len(np.unique(code[p:q])) for p, q in zip(w.bounds[:-1], w.bounds[1:], strict=True)])
        stats = np.stack([np.log(n), letters / n / 5, np.log1p(100 * total(_SYMBOL[data]) / size), total(data == 10) / n * 10, distinct / n, total((data >= 48) & (data < 58)) / size * 10], 1)
        yield (code >> np.uint64(49)).astype(np.int64), w.bounds, stats


@dataclass
class QualityModel:
    weights: np.ndarray
    linear: np.ndarray
    bias: float
    center: np.ndarray
    spread: np.ndarray
    slope: float = 1.0
    offset: float = 0.0
    prior: float = 0.0

    def raw(self, texts: pa.Array) -> np.ndarray:
        out = []
        for bucket, bounds, stats in features(texts):
            # Each text is summed by itself, so its evidence does not depend on the texts beside it.
            n = np.diff(bounds)
            bag = np.add.reduceat(np.append(self.weights[bucket], 0.0), bounds[:-1]) * (n > 0) / np.sqrt(np.maximum(n, 1))
            out.append(bag + ((stats - self.center) / self.spread).clip(-5, 5) @ self.linear + self.bias)
        return np.concatenate(out) if out else np.zeros(0)

    def evidence(self, texts: pa.Array) -> np.ndarray:
        """Calibrated log-odds of good quality, less those of the sample."""
        return (self.slope * self.raw(texts) + self.offset - self.prior).clip(-15, 15)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z.clip(-30, 30)))


def fit(texts: list[str], labels: list[int], epochs: int = 12) -> QualityModel:
    """Stochastic gradient descent with a penalty on the word weights; a fifth is set aside for calibration."""
    rng = np.random.default_rng(3)
    y = np.array(labels, float)
    parts = [(x, b, s) for x, b, s in features(pa.array(texts, pa.string()))]
    bags = [x[p:q] for x, b, _ in parts for p, q in zip(b[:-1], b[1:], strict=True)]
    stats = np.concatenate([s for *_, s in parts]) if parts else np.zeros((0, STATISTICS))
    aside = np.arange(len(y)) % 5 == 4
    learn = np.flatnonzero(~aside)
    m = QualityModel(np.zeros(BUCKETS), np.zeros(STATISTICS), 0.0, stats[learn].mean(0) if len(learn) else np.zeros(STATISTICS), stats[learn].std(0) + 1e-3 if len(learn) else np.ones(STATISTICS))
    if len(set(labels)) < 2:
        return m
    z = ((stats - m.center) / m.spread).clip(-5, 5)
    rate0, seen = 0.3, 0
    for _ in range(epochs):
        for i in rng.permutation(learn).tolist():
            rate = rate0 / (1 + seen / (4 * len(learn)))
            seen += 1
            root = np.sqrt(max(1, len(bags[i])))
            p = _logistic(np.array(m.weights[bags[i]].sum() / root + z[i] @ m.linear + m.bias))
            g = float(p - y[i])
            np.subtract.at(m.weights, bags[i], rate * 0.1 * g / root)
            m.weights[bags[i]] *= 1 - rate * 1e-3
            m.linear -= rate * 0.1 * g * z[i]
            m.bias -= rate * 0.1 * g
    held = np.flatnonzero(aside)
    raw, target = m.raw(pa.array([texts[i] for i in held], pa.string())), y[held]
    a, b = 1.0, 0.0
    for _ in range(300 if len(held) else 0):  # Platt scaling, drawn slightly to the uncalibrated scale
        p = _logistic(a * raw + b)
        a -= 0.5 * (((p - target) * raw).mean() / (1 + (raw**2).mean()) + 1e-3 * (a - 1))
        b -= 0.5 * (p - target).mean()
    share = (y.sum() + 1) / (len(y) + 2)
    m.slope, m.offset, m.prior = float(a), float(b), float(np.log(share / (1 - share)))
    return m


def train(docs: DataFrame, labels: DataFrame, rows: int = 4000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Fit on at most about ``rows`` labelled ids, chosen by hash; null texts and labels take no part.

    Of several labels of an id the least counts, of several texts the first by code points. With one label
    only, or none, there is no evidence; with fewer than five rows none is left to calibrate on.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.min("y").alias("y"))
    n = known.count()
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1_000_000)) < int(1_000_000 * min(1.0, rows / max(n, 1))))
    sample = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null").join(F.broadcast(chosen), "doc_id")
    sample = sorted(sample.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y")).collect(), key=lambda r: r["doc_id"])
    return fit([r["text"] for r in sample], [r["y"] for r in sample])


def _strength(sites: DataFrame, mean: float) -> float:
    """Prior rows worth of the level above, from the spread of the sites' shares beyond what chance gives (moments)."""
    r = sites.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.count("*").alias("k"), F.sum(F.col("n") * (F.col("good") / F.col("n") - mean) ** 2).alias("ss")).first()
    if not r["n"] or r["k"] < 2:
        return 10.0
    chance = mean * (1 - mean)
    between = (r["ss"] - (r["k"] - 1) * chance) / max(r["n"] - r["nn"] / r["n"], 1e-9)
    return float(f"{min(1e6, max(1.0, chance / between - 1)):.6g}") if between > 1e-9 else 1e6


def quality(docs: DataFrame, model: QualityModel, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``doc_id, evidence, p_text, p_host, p_path, p_quality, kept`` of every row.

    ``host`` and ``path`` name its site; null is a site of its own. ``p_text`` is the classifier's
    probability under the global share, ``p_quality`` the posterior with its site, and ``kept`` says
    whether that is ``least`` or more. Null text is empty. Repeated rows each get their row.
    """
    schema = "doc_id long, host long, path long, evidence double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(model.evidence(batch.column(3)))], names=["doc_id", "host", "path", "evidence"])

    site = F.xxhash64(host, host.isNull())
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), site.alias("host"), F.xxhash64(host, host.isNull(), path, path.isNull()).alias("path"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(run, schema)
    odds = float(model.prior)
    scored = materialize(scored.withColumn("p_text", F.round(1 / (1 + F.exp(-(F.col("evidence") + odds))), 9)), "evidence")
    paths = materialize(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(F.round(F.col("p_text") * 1e9).cast("long")).alias("good")), "paths")
    # Shares are summed as whole billionths: exact in any order, so reruns agree.
    hosts = materialize(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.count("*").alias("paths")), "hosts")
    paths, hosts = (x.withColumn("good", F.col("good") / 1e9) for x in (paths, hosts))
    total = hosts.agg(F.sum("n").alias("n"), F.sum(F.round(F.col("good") * 1e9).cast("long")).alias("good")).first()
    total = {"n": total["n"], "good": (total["good"] or 0) / 1e9}
    mean = min(1 - 1e-6, max(1e-6, total["good"] / total["n"])) if total["n"] else 0.5
    of_host, of_path = _strength(hosts, mean), _strength(paths, mean)
    hosts = hosts.select("host", F.col("good").alias("host_good"), F.col("n").alias("host_rows"), "paths")
    paths = lookup(paths, hosts, ["host"], "paths").withColumnRenamed("n", "rows")
    out = lookup(scored, paths.select("path", "good", F.col("rows").alias("path_rows"), "host_good", "host_rows", "rows"), ["path"], "rows")
    bounded = lambda x: F.least(F.greatest(x, F.lit(1e-6)), F.lit(1 - 1e-6))
    rest = total["n"] or 0
    others = (F.lit(float(total["good"] or 0)) - F.col("p_text")) / (rest - 1) if rest > 1 else F.lit(mean)
    out = out.withColumn("p_all", bounded(others))
    out = out.withColumn("p_host", bounded((F.col("host_good") - F.col("p_text") + of_host * F.col("p_all")) / (F.col("host_rows") - 1 + of_host)))
    out = out.withColumn("p_path", bounded((F.col("good") - F.col("p_text") + of_path * F.col("p_host")) / (F.col("path_rows") - 1 + of_path)))
    posterior = 1 / (1 + F.exp(-(F.col("evidence") + F.ln(F.col("p_path") / (1 - F.col("p_path"))))))
    return out.withColumn("p_quality", posterior).select("doc_id", "evidence", "p_text", "p_host", "p_path", "p_quality", (F.col("p_quality") >= least).alias("kept"))
