"""Language-model scoring with a gated recurrent network trained here, in numpy.

Vocabulary. All training words are counted. The most frequent ones are words of the network, in
classes of CLASS words by frequency; every other word, known or not, belongs to one of SUFFIXES open
classes by its last two bytes. The output softmax is factored: a class, then a word within it. Within
an open class the word's probability comes from the counts of the whole corpus, so they matter for
each rare word and grow with the input.

Training. All training documents, whole, dealt to groups of bounded size, so more data make more
groups. Each group runs truncated backpropagation from the common parameters, the state carried from
window to window and reset between documents; the groups' parameters are averaged in Spark, in rounds
that each see another share of the documents. The output biases start from the counts.

Scoring. One pass over all texts, in batches of documents in step, the state carried across windows
to the document's end. Counts of the COMMON most frequent words (a fixed bound) are broadcast; rarer
words meet their counts in a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaymill.llm._words import Words, blocks, tidy, words
from assaymill.storage import materialize

CLASS, CLASSES, SUFFIXES, HIDDEN = 64, 32, 32, 16
HEAD = CLASS * CLASSES
INPUTS, OUTPUTS = HEAD + SUFFIXES, CLASSES + SUFFIXES
COMMON = 262_144
#: A group has STEPS steps of WINDOW tokens in each of STREAMS streams, or fewer streams where it is small.
WINDOW, STREAMS, STEPS, GROUP_DOCS, ROUNDS, RATE = 32, 256, 64, 2048, 2, 0.02
#: A round has a task for every four groups, up to this number.
MOST_TASKS = 20_000
SHAPES = {"x": (INPUTS, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "wc": (HIDDEN, OUTPUTS), "bc": (OUTPUTS,), "wv": (CLASSES, HIDDEN, CLASS), "bv": (CLASSES, CLASS)}


def suffix(w: Words) -> np.ndarray:
    """Open class of each word, from its last two bytes."""
    last = w.data[w.end - 1].astype(np.int64)
    before = np.where(w.end - w.start > 1, w.data[np.maximum(w.end - 2, 0)], 0).astype(np.int64)
    return ((last * 257 + before) * 40_503 >> 4) % SUFFIXES


@dataclass
class Vocabulary:
    """Frequent words by hash: their training counts, and the network's id of each (-1: an open class)."""

    hashes: np.ndarray
    counts: np.ndarray
    ids: np.ndarray
    train_tokens: int
    distinct: int
    ends: int
    open_tokens: np.ndarray
    open_words: np.ndarray

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(training count, network id) of distinct words; -1 for words that are not frequent."""
        if not len(self.hashes):
            return np.full(len(hashes), -1), np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = self.hashes[at] == hashes
        return np.where(hit, self.counts[at], -1), np.where(hit, self.ids[at], -1)


def encode(w: Words, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per word: network id, training count (-1: not frequent), number of its hash in the block, open class; and those hashes."""
    code, distinct = pd.factorize(w.hashes())
    counts, ids = vocabulary.find(distinct)
    kind = suffix(w) if len(code) else np.zeros(0, np.int64)
    net = ids[code] if len(code) else np.zeros(0, np.int64)
    return np.where(net >= 0, net, HEAD + kind), counts[code] if len(code) else net, code, kind, distinct


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to (word hash, open class, occurrences) per block; hash 0 counts the texts."""
    for batch in batches:
        for a, b, data, offsets in blocks(batch.column(0)):
            w = words(data, offsets)
            code, distinct = pd.factorize(w.hashes())
            where = np.zeros(len(distinct), np.int64)
            where[code] = np.arange(len(code))
            kinds = suffix(w)[where] if len(code) else where
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(distinct, np.uint64(0)).astype(np.int64)), pa.array(np.append(kinds, 0).astype(np.int32)), pa.array(np.append(np.bincount(code, minlength=len(distinct)), b - a))],
                names=["word", "kind", "n"],
            )


def sequences(texts: pa.Array, vocabulary: Vocabulary) -> list[np.ndarray]:
    """Network ids of each text; 0 ends it."""
    out = []
    for a, b, data, offsets in blocks(texts):
        w = words(data, offsets)
        ids = encode(w, vocabulary)[0].astype(np.int32)
        out += [np.append(ids[p:q], np.int32(0)) for p, q in zip(w.bounds[:-1], w.bounds[1:], strict=True)]
    return out


def start_parameters(vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    """Small random weights; biases that reproduce the word counts."""
    rng = np.random.default_rng(5)
    p = {k: rng.normal(0, 0.1, s).astype(np.float32) for k, s in SHAPES.items()}
    head = np.full(HEAD, 0.5)
    known = vocabulary.ids >= 0
    head[vocabulary.ids[known]] += vocabulary.counts[known]
    head[0] += vocabulary.ends
    p["bv"] = np.log(head.reshape(CLASSES, CLASS)).astype(np.float32)
    p["bv"] -= p["bv"].max(1, keepdims=True)
    p["bc"] = np.log(np.append(head.reshape(CLASSES, CLASS).sum(1), vocabulary.open_tokens + 0.5)).astype(np.float32)
    p["bc"] -= p["bc"].max()
    return p


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


def by_class(target: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Class of each target, and for each closed class the rows that have it."""
    kind = np.where(target < HEAD, target // CLASS, CLASSES + target - HEAD).astype(np.uint8)
    order = np.argsort(kind, kind="stable")
    edges = np.searchsorted(kind[order], np.arange(CLASSES + 1))
    return kind, order, [(c, order[edges[c] : edges[c + 1]]) for c in np.flatnonzero(np.diff(edges)).tolist()]


def exponentials(h: np.ndarray, w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logits, less their largest where they could overflow, and exponentials; states lie within -1..1."""
    z = h @ w + b
    if float((np.abs(w).sum(0) + np.abs(b)).max()) > 80:
        z -= z.max(1, keepdims=True)
    return z, np.exp(z)


def log_probabilities(p: dict[str, np.ndarray], h: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log probability of each target's class, and of the word within it for words of the network."""
    kind, _, own = by_class(target)
    z, e = exponentials(h, p["wc"], p["bc"])
    out = z[np.arange(len(z)), kind] - np.log(e.sum(1))
    for c, rows in own:
        z, e = exponentials(h[rows], p["wv"][c], p["bv"][c])
        out[rows] += z[np.arange(len(rows)), target[rows] - c * CLASS] - np.log(e.sum(1))
    return out


def step(p: dict[str, np.ndarray], xw: np.ndarray, h: np.ndarray) -> np.ndarray:
    g = h @ p["u"]
    zr = sigmoid(xw[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
    n = np.tanh(xw[:, 2 * HIDDEN :] + zr[:, HIDDEN:] * g[:, 2 * HIDDEN :])
    return n + zr[:, :HIDDEN] * (h - n)


def score(p: dict[str, np.ndarray], texts: list[np.ndarray], lanes: int = 512, window: int = 16) -> np.ndarray:
    """Natural log-likelihood of whole sequences by the network; open-class words count with their class alone."""
    out = np.zeros(len(texts))
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    for at in range(0, len(order), lanes):
        part = order[at : at + lanes]
        lengths = np.array([len(texts[i]) for i in part])
        h = np.zeros((len(part), HIDDEN), np.float32)
        last = np.zeros(len(part), np.int32)
        for t0 in range(0, int(lengths[0]), window):
            n = int((lengths > t0).sum())
            span = int(min(window, lengths[0] - t0))
            ids = np.zeros((span, n), np.int32)
            for j in range(n):
                x = texts[part[j]][t0 : t0 + span]
                ids[: len(x), j] = x
            alive = [int((lengths > t0 + t).sum()) for t in range(span)]
            states, targets, lane = [], [], []
            h = h[:n]
            for t, b in enumerate(alive):
                h = h[:b] if len(h) > b else h
                h = step(p, p["x"][last[:b]], h)
                last = ids[t]
                states.append(h)
                targets.append(ids[t, :b])
                lane.append(np.arange(b))
            logs = log_probabilities(p, np.concatenate(states), np.concatenate(targets))
            out[part[:n]] += np.bincount(np.concatenate(lane), logs, n)
    return out


def gradients(p: dict[str, np.ndarray], inputs: np.ndarray, targets: np.ndarray, h: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
    """Gradient over one window (time, lane) by truncated backpropagation, the state after it, and the mean loss."""
    span, lanes = inputs.shape
    keep, states, gates = [], [], []
    for t in range(span):
        h = h * (inputs[t] != 0)[:, None].astype(np.float32)  # the end of a text resets the state
        xw, g = p["x"][inputs[t]], h @ p["u"]
        zr = sigmoid(xw[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        n = np.tanh(xw[:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
        keep.append(h)
        gates.append((z, r, n, g[:, 2 * HIDDEN :]))
        h = n + z * (h - n)
        states.append(h)
    hs, y = np.concatenate(states), targets.ravel()
    scale = np.float32(1 / len(y))
    grad = {k: np.zeros(s, np.float32) for k, s in SHAPES.items()}
    kind, _, classes = by_class(y)
    _, e = exponentials(hs, p["wc"], p["bc"])
    total = e.sum(1)
    rows = np.arange(len(y))
    loss = -float(np.log(np.maximum(e[rows, kind] / total, 1e-12)).mean())
    e *= (scale / total)[:, None]
    e[rows, kind] -= scale
    grad["wc"], grad["bc"] = hs.T @ e, e.sum(0)
    dh = e @ p["wc"].T
    for c, own in classes:
        mine = hs[own]
        _, e = exponentials(mine, p["wv"][c], p["bv"][c])
        e *= (scale / e.sum(1))[:, None]
        e[np.arange(len(own)), y[own] - c * CLASS] -= scale
        grad["wv"][c], grad["bv"][c] = mine.T @ e, e.sum(0)
        dh[own] += e @ p["wv"][c].T
    dh = dh.reshape(span, lanes, HIDDEN)
    carry = np.zeros((lanes, HIDDEN), np.float32)
    xs = np.zeros((span, lanes, 3 * HIDDEN), np.float32)
    for t in reversed(range(span)):
        z, r, n, gn = gates[t]
        d = dh[t] + carry
        dn = d * (1 - z) * (1 - n * n)
        dz = d * (keep[t] - n) * z * (1 - z)
        dr = dn * gn * r * (1 - r)
        xs[t] = np.concatenate([dz, dr, dn], 1)
        back = np.concatenate([dz, dr, dn * r], 1)
        grad["u"] += keep[t].T @ back
        carry = (d * z + back @ p["u"].T) * (inputs[t] != 0)[:, None]
    seen = inputs.ravel()
    order = np.argsort(seen, kind="stable")
    first = np.flatnonzero(np.diff(seen[order], prepend=-1))
    grad["x"][seen[order[first]]] = np.add.reduceat(xs.reshape(-1, 3 * HIDDEN)[order], first, axis=0)
    return grad, h, loss


def fit(p: dict[str, np.ndarray], texts: list[np.ndarray], seed: int) -> tuple[dict[str, np.ndarray], int]:
    """Parameters after one pass over all tokens of the texts, in parallel streams, and the number of tokens."""
    p = {k: v.copy() for k, v in p.items()}
    rng = np.random.default_rng(seed)
    tokens = np.concatenate([np.zeros(0, np.int32), *[texts[i] for i in rng.permutation(len(texts))]])
    lanes = min(STREAMS, max(8, len(tokens) // (WINDOW * STEPS)))
    span = -(-len(tokens) // lanes)
    if not span:
        return p, 0
    # Ends of texts fill up the last stream.
    streams = np.append(tokens, np.zeros(span * lanes - len(tokens), np.int32)).reshape(lanes, span).T
    inputs = np.concatenate([np.zeros((1, lanes), np.int32), streams[:-1]])
    h = np.zeros((lanes, HIDDEN), np.float32)
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    steps = -(-span // WINDOW)
    for i in range(steps):
        part = slice(i * WINDOW, (i + 1) * WINDOW)
        grad, h, _ = gradients(p, inputs[part], streams[part], h)
        norm = np.sqrt(sum(float(np.vdot(g, g)) for g in grad.values()))
        rate = RATE * min(1.0, (i + 1) / 20) * (1 - 0.9 * i / steps)
        for k, g in grad.items():
            g *= np.float32(min(1.0, 1.0 / (norm + 1e-9)))
            m[k] += np.float32(0.1) * (g - m[k])
            v[k] += np.float32(0.01) * (g * g - v[k])
            p[k] -= np.float32(rate / (1 - 0.9 ** (i + 1))) * m[k] / (np.sqrt(v[k] * np.float32(1 / (1 - 0.99 ** (i + 1)))) + np.float32(1e-6))
    return p, len(tokens)


def pack(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SHAPES])


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = flat[at : at + n].reshape(s).astype(np.float32)
        at += n
    return out


def vocabulary_of(counts: DataFrame) -> Vocabulary:
    """The COMMON most frequent words at most (all of a count or none) and totals, from (word, kind, n)."""
    totals = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("word") == 0, F.col("n"))).alias("ends")).first()
    real = counts.where("word <> 0")
    # Numbers of words by count: single counts, then eighths of an octave, so the driver gets a fixed number of rows.
    level = F.when(F.col("n") < 64, F.col("n")).otherwise(F.floor(16 + 8 * F.log2("n"))).cast("long")
    least, taken = None, 0
    for r in sorted(real.groupBy(level.alias("level")).agg(F.min("n").alias("n"), F.count("*").alias("k")).collect(), key=lambda r: -r["level"]):
        if taken + r["k"] > COMMON:
            break
        least, taken = r["n"], taken + r["k"]
    frequent = real.where(F.col("n") >= least).select("word", "kind", "n").toArrow() if least is not None else None
    by_kind = {r["kind"]: (r["n"], r["v"]) for r in real.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    open_tokens, open_words = (np.array([by_kind.get(k, (0, 0))[j] for k in range(SUFFIXES)], np.float64) for j in (0, 1))
    hashes, kinds, n = (frequent.column(c).to_numpy() for c in ("word", "kind", "n")) if frequent else (np.zeros(0, np.int64),) * 3
    hashes = hashes.astype(np.int64).view(np.uint64)
    order = np.lexsort((hashes, -n))
    ids = np.full(len(n), -1, np.int64)
    top = order[: HEAD - 1]
    ids[top] = np.arange(1, len(top) + 1)
    np.subtract.at(open_tokens, kinds[top], n[top])
    np.subtract.at(open_words, kinds[top], 1)
    by_hash = np.argsort(hashes)
    return Vocabulary(hashes[by_hash], n[by_hash].astype(np.int64), ids[by_hash], int(totals["n"] or 0), int(totals["v"] or 0), int(totals["ends"] or 0), open_tokens, open_words)


@dataclass
class Model:
    """A trained network, its vocabulary and the table of all word counts."""

    vocabulary: Vocabulary
    parameters: dict[str, np.ndarray]
    counts: DataFrame


def lessons(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    """(group, text) rows, a group's one after the other, to (i, total, seen): the sum of the groups' trained parameters, weighted by their tokens."""
    flat, vocabulary = shared.value
    total, seen = np.zeros(len(flat)), 0
    group, texts = None, []

    def learn() -> None:
        nonlocal total, seen
        if texts:
            new, n = fit(unpack(flat), sequences(pa.chunked_array(texts), vocabulary), group)
            total, seen = total + pack(new).astype(np.float64) * n, seen + n
            texts.clear()

    for batch in batches:
        groups = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(groups)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a < b and int(groups[a]) != group:
                learn()
                group = int(groups[a])
            texts.append(batch.column(1).slice(a, b - a))
    learn()
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(total), pa.array(np.full(len(flat), float(seen)))], names=["i", "total", "seen"])


def train(docs: DataFrame, key: Column, text_col: str = "text") -> Model:
    """Count the words of all rows of ``docs`` and train on all of them; ``key`` decides by hash which group a row belongs to."""
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.xxhash64(key, F.lit("train")).alias("h"))
    raw = texts.select("text").mapInArrow(lambda it: tidy(count_words(it)), "word long, kind int, n long")
    counts = materialize(raw.groupBy("word").agg(F.min("kind").alias("kind"), F.sum("n").alias("n")), "counts")
    vocabulary = vocabulary_of(counts)
    p = start_parameters(vocabulary)
    if not vocabulary.ends:
        return Model(vocabulary, p, counts)
    spark = docs.sparkSession
    groups = max(1, round(vocabulary.ends / ROUNDS / GROUP_DOCS))
    tasks = min(groups, max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, -(-groups // 4))))
    # Rows of one key meet in a group, so equal keys (rows without an id) are spread by their text.
    dealt = texts.withColumn("d", F.xxhash64("h", "text")).select(F.pmod(F.shiftright("d", 20), F.lit(ROUNDS)).alias("round"), F.pmod(F.shiftright("d", 28), F.lit(groups)).alias("group"), "h", "text")
    size = sum(int(np.prod(s)) for s in SHAPES.values())
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast((pack(p), vocabulary))
        mine = dealt.where(F.col("round") == turn).repartition(tasks, "group").sortWithinPartitions("group", "h", "text").select("group", "text")
        sums = mine.mapInArrow(lambda it: tidy(lessons(it, shared)), "i long, total double, seen double")
        mean = sums.groupBy("i").agg(F.sum("total").alias("total"), F.sum("seen").alias("seen")).where("seen > 0").select("i", (F.col("total") / F.col("seen")).alias("mean")).toArrow()
        if mean.num_rows:
            flat = np.zeros(size, np.float32)
            flat[mean.column("i").to_numpy()] = mean.column("mean").to_numpy()
            p = unpack(flat)
    return Model(vocabulary, p, counts)


def log_likelihood(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of every row: ``doc_id, n_tokens, n_known, train_tokens, base_score, score``.

    ``score`` is the network's log10 probability of the whole text with its end, ``base_score`` that of
    smoothed word counts. Null text is empty: its end alone is scored. Repeated rows and rows without an
    id each get their row. Other columns are not read.
    """
    v = model.vocabulary
    shared = docs.sparkSession.sparkContext.broadcast((pack(model.parameters), v))
    base = float(np.log10(v.train_tokens + 0.5 * (v.distinct + 1)))
    opened = np.log10(v.open_tokens + 0.5 * (v.open_words + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, v = shared.value
        p = unpack(flat)
        row = TaskContext.get().partitionId() << 40
        names = ["row", "doc_id", "word", "kind", "n", "n_tokens", "n_known", "base", "score"]
        for batch in batches:
            texts, sums = [], []
            for a, b, data, offsets in blocks(batch.column(1)):
                w = words(data, offsets)
                net, counts, code, kind, distinct = encode(w, v)
                doc = w.docs()
                size = np.diff(w.bounds)
                ids = net.astype(np.int32)
                texts += [np.append(ids[x:y], np.int32(0)) for x, y in zip(w.bounds[:-1], w.bounds[1:], strict=True)]
                known = counts >= 0
                log = np.log10(np.maximum(counts, 0) + 0.5)
                plain = np.bincount(doc[known], log[known] - base, b - a) + np.log10(v.ends + 0.5) - base
                inside = known & (net >= HEAD)
                sums.append((plain, np.bincount(doc[inside], log[inside] - opened[kind[inside]], b - a), size + 1, np.bincount(doc[known], minlength=b - a) + (v.ends > 0)))
                rare = np.flatnonzero(~known)
                cell, first, times = np.unique(doc[rare] * (len(distinct) + 1) + code[rare], return_index=True, return_counts=True)
                which = rare[first]
                zero = np.zeros(len(which))
                none = pa.nulls(len(which), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(row + a + doc[which]), none, pa.array(distinct[code[which]].astype(np.int64)), pa.array(kind[which].astype(np.int32)), pa.array(times), *(pa.array(zero.astype(np.int64)) for _ in range(2)), pa.array(zero), pa.array(zero)], names=names)
            n = batch.num_rows
            plain, inside, tokens, known = (np.concatenate([s[j] for s in sums]) if sums else np.zeros(0) for j in range(4))
            total = score(p, texts) / np.log(10) + inside
            yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(n)), batch.column(0).cast(pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.array(np.zeros(n, np.int64)), pa.array(tokens.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(plain), pa.array(total)], names=names)
            row += n

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.mapInArrow(lambda it: tidy(run(it)), "row long, doc_id long, word long, kind int, n long, n_tokens long, n_known long, base double, score double")
    # Rows of whole texts go along under keys of their own; no word's hash is looked up for them.
    rows = rows.withColumn("apart", F.when(F.col("word").isNull(), F.col("row")).otherwise(-1))
    counts = model.counts.where("word <> 0").select("word", F.col("n").alias("c"), F.lit(-1).cast("long").alias("apart"))
    joined = rows.join(counts, ["word", "apart"], "left")
    log = F.log10(F.coalesce("c", F.lit(0)) + 0.5)
    within = F.coalesce(F.get(F.lit([float(x) for x in opened]), F.col("kind")), F.lit(0.0))
    out = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.col("n") * (log - base)).alias("base_score"),
        F.sum(F.col("score") + F.col("n") * (log - within)).alias("score"),
    )
    return out.select("doc_id", "n_tokens", "n_known", F.lit(v.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")
