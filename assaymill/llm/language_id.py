"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the mean of the embeddings of its hashed subwords (runs of 2 to 4 letters inside a word,
word edges included). Embeddings and softmax are trained by stochastic gradient descent in numpy on
segments of a bounded sample of labelled rows (``rows``), as many of each language. A fifth of the
sample is set aside: on it a temperature makes the probabilities calibrated, and the rejection level
is the probability that all but ``rejected`` of its whole texts reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaymill.llm._words import tidy

UNKNOWN = "und"
#: So many segments at least, however few the rows.
SEGMENTS = 7_500
BITS, DIM, SIZES, BLOCK_CHARS = 16, 16, (2, 3, 4), 500_000
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Lower-case code point of each letter, 0 for everything else; built once per worker."""
    if not _letters:
        table = np.zeros(0x110000, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _letters.append(table)
    return _letters[0]


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(first element of each text, number of subwords of each text, for each size the bucket at each element; 0: none)."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
    first = np.zeros(len(texts), np.int64)
    np.cumsum(lengths[:-1], out=first[1:])
    c = _letter_table()[np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = c != 0
    keep[1:] |= c[:-1] != 0
    keep[first] = True  # each text starts with a word edge of its own, so no subword spans two texts
    place = np.cumsum(keep) - 1
    c, first = c[keep], place[first]
    x = c * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15)
    letter = c != 0
    padded, ends = np.concatenate([x, np.zeros(3, np.uint32)]), np.concatenate([letter, np.zeros(3, bool)])
    n, g, out, total = len(x), x, [], np.zeros(len(texts), np.int64)
    inner = np.ones(n, bool)
    for size in SIZES:
        g = g * np.uint32(0x01000193) + padded[size - 1 : size - 1 + n]
        if size > 2:
            inner = inner & ends[size - 2 : size - 2 + n]
        valid = inner if size > 2 else letter | ends[1 : 1 + n]
        mixed = g ^ (g >> np.uint32(15))
        out.append((((mixed * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)) + np.uint32(1)) * valid)
        total += np.add.reduceat(valid, first, dtype=np.int64)
    return first, total, out


@dataclass
class LanguageModel:
    """Trained weights; ``table`` has the logits that each bucket adds (or its embedding, if that is narrower)."""

    languages: list[str]
    table: np.ndarray
    weights: np.ndarray | None
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Logits and the number of subwords of each text."""
        sums = np.zeros((len(texts), len(self.table)))
        first, total, grams = subwords(texts)
        for j, column in enumerate(self.table):
            for g in grams:
                sums[:, j] += np.add.reduceat(column[g], first, dtype=np.float64)
        mean = sums / np.maximum(total, 1)[:, None]
        return (mean if self.weights is None else mean @ self.weights) + self.bias, total

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and calibrated probability of each text; ``und`` and 0 without a letter or a model."""
        names: list[str] = []
        scores = np.zeros(len(texts))
        at = 0
        while at < len(texts):
            to, chars = at, 0
            while to < len(texts) and (to == at or chars + len(texts[to]) < BLOCK_CHARS):
                chars += len(texts[to])
                to += 1
            if not self.languages:
                names += [UNKNOWN] * (to - at)
            else:
                z, total = self.logits(texts[at:to])
                p = softmax(z / self.temperature)
                best = p.argmax(1)
                names += [self.languages[b] if n else UNKNOWN for b, n in zip(best, total, strict=True)]
                scores[at:to] = np.where(total > 0, p[np.arange(to - at), best], 0.0)
            at = to
        return names, scores


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(docs: DataFrame, key: Column, text_col: str = "text", label_col: str = "lang", rows: int = 1600, epochs: int = 6, rejected: float = 0.002) -> LanguageModel:
    """Fit a model on at most about ``rows`` labelled rows of ``docs``, spread over the languages; ``key`` decides by hash which ones.

    Rows with a null label or text take no part. Without any labelled row the model knows no language.
    """
    pairs = docs.select(F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("lang"), F.xxhash64(key).alias("h"))
    pairs = pairs.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = {r["lang"]: r["count"] for r in pairs.groupBy("lang").count().collect()}
    if not counts:
        return LanguageModel([], np.zeros((0, 0), np.float32), None, np.zeros(0))
    each = max(1, rows // len(counts))
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, max(2.0, 1.2 * each) / n))])
    chosen = pairs.where(F.pmod("h", F.lit(1_000_000)) / 1_000_000 < share[F.col("lang")])
    # Rows of one key and language are one row of the sample, however often they repeat.
    sample = sorted(chosen.groupBy("h", "lang").agg(F.min("text").alias("text")).collect(), key=lambda r: (r["h"], r["lang"]))
    return fit([r["text"] for r in sample], [r["lang"] for r in sample], epochs, rejected)


def segments(texts: list[str], labels: list[int], rng: np.random.Generator, each: int) -> tuple[list[str], np.ndarray]:
    """Runs of words from anywhere in the texts, short ones more often."""
    out, y = [], []
    for text, label in zip(texts, labels, strict=True):
        w = text.split()
        for _ in range(each):
            n = int(min(len(w), 1 + rng.geometric(1 / 25)))
            at = int(rng.integers(0, len(w) - n + 1))
            out.append(" ".join(w[at : at + n]))
            y.append(label)
    return out, np.array(y, np.int64)


def fit(texts: list[str], labels: list[str], epochs: int, rejected: float) -> LanguageModel:
    languages = sorted(set(labels))
    codes = [languages.index(x) for x in labels]
    rng = np.random.default_rng(9)
    aside = [i % 5 == 4 for i in range(len(texts))]
    learn = [i for i, a in enumerate(aside) if not a]
    seg, y = segments([texts[i] for i in learn], [codes[i] for i in learn], rng, max(6, -(-SEGMENTS // max(1, len(learn)))))
    emb = rng.normal(0, 0.1, (2**BITS + 1, DIM)).astype(np.float32)
    emb[0] = 0
    w, b = rng.normal(0, 0.1, (DIM, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)
    steps = max(1, epochs * len(seg) // 64)
    done = 0
    for _ in range(epochs):
        order = rng.permutation(len(seg))
        for at in range(0, len(order), 64):
            rate, done = 2.0 * (1 - done / (steps + epochs)), done + 1
            part = order[at : at + 64]
            first, total, grams = subwords([seg[i] for i in part])
            n = len(grams[0])
            owner = np.repeat(np.arange(len(part)), np.diff(np.append(first, n)))
            ids, who = np.concatenate(grams), np.tile(owner, len(grams))
            ids, who = ids[ids > 0], who[ids > 0]
            cell, times = np.unique(who * (2**BITS + 1) + ids, return_counts=True)
            who, ids = cell // (2**BITS + 1), cell % (2**BITS + 1)
            share = (times / np.maximum(total, 1)[who]).astype(np.float32)
            mean = np.zeros((len(part), DIM), np.float32)
            np.add.at(mean, who, emb[ids] * share[:, None])
            g = softmax(mean @ w + b).astype(np.float32)
            g[np.arange(len(part)), y[part]] -= 1
            g[total == 0] = 0
            g /= len(part)
            back = g @ w.T
            w -= rate * (mean.T @ g)
            b -= rate * g.sum(0)
            np.add.at(emb, ids, -rate * 8 * back[who] * share[:, None])
    b = b.astype(np.float64)
    if len(languages) <= DIM:
        model = LanguageModel(languages, np.ascontiguousarray((emb @ w).T), None, b)
    else:
        model = LanguageModel(languages, np.ascontiguousarray(emb.T), w.astype(np.float64), b)
    held = [i for i, a in enumerate(aside) if a]
    if held and len(languages) > 1:
        seg, y = segments([texts[i] for i in held], [codes[i] for i in held], rng, 4)
        z, total = model.logits(seg)
        z, y = z[total > 0], y[total > 0]
        grid = np.geomspace(0.02, 10, 80)
        loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() if len(y) else 0.0 for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        scores = [s for s in model.predict([texts[i] for i in held])[1] if s > 0]
        model.least = float(min(0.5, np.quantile(scores, rejected))) if scores else 0.0
    return model


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` (``und``: null text or no letter), ``score`` (calibrated probability, 0 to 1) and ``rejected``.

    ``rejected`` marks ``und`` and scores under the model's rejection level. Every row is kept, repeated
    rows too; columns of ``docs`` with these names are replaced. Whole texts of any length are read.
    """
    added = ("lang_pred", "score", "rejected")
    base = docs.drop(*added)
    schema = T.StructType([*base.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    column = base.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = model.predict([t or "" for t in batch.column(column).to_pylist()])
            gone = [n == UNKNOWN or s < model.least for n, s in zip(names, scores, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores), pa.array(gone, pa.bool_())], names=schema.names)

    return base.mapInArrow(lambda it: tidy(run(it)), schema)
