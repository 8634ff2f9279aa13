"""Maximal periodic runs of words, found through string synchronising sets.

A run is a stretch of words with smallest period q that is at least two periods long and that no neighbour extends. Periods
up to 5 are compared directly. At scale t = 2, 4, 8, ... periods of 3 t to 6 t - 1 are proposed by

* a synchronising set: positions i at which the least hash of the windows of t words that begin in [i, i + t] is that
  of the first or the last one. Windows with a period of at most t / 3 do not count, so every t positions hold one
  unless 3 t - 1 words from there are highly periodic. Whether i is in the set depends on its 2 t words
  (its context) alone, hence a run of period p shows two positions of equal context p apart. Equal contexts lie
  over t / 3 apart, so a position has at most 18 partners;
* neighbouring highly periodic regions of one root: such regions are runs of periods up to t / 3, found at lower scales. Where
  they fill whole periods of a longer run, no position is in the set; the shifts that lay one region on the
  other are its possible periods.

Each proposal is extended both ways over hashes of 1, 8, 64, ... words, by jumps. What stands in the end is compared word by word (a
collision of hashes lengthens a run, it never hides one). A text without equal contexts and without highly
periodic regions has no run at this or any later scale, so most texts are done after the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaymill.llm._words import Words, blocks, eights, mix, same_words, tidy, words
from assaymill.llm.conversation_trie import WORD
from assaymill.llm.packing import runs as ranges

#: Periods below three times the first scale are compared directly.
FIRST = 2
#: Stored hashes grow by so much.
STEP = 8
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(2**64 - 1)


def word_codes(w: Words) -> np.ndarray:
    """A number for each word, equal where its bytes are."""
    hashes = w.hashes()
    code, distinct = pd.factorize(hashes)
    code = code.astype(np.int64)
    shown = np.zeros(len(distinct), np.int64)
    shown[code] = np.arange(len(code))
    rep, size = shown[code], w.end - w.start
    right = size == size[rep]
    eight = eights(w.data)
    right[right] = same_words(eight, w.start[right], eight, w.start[rep][right], size[right])
    others: dict[bytes, int] = {}
    for i in np.flatnonzero(~right).tolist():  # words that share a hash
        code[i] = others.setdefault(w.data[w.start[i] : w.end[i]].tobytes(), len(distinct) + len(others))
    return code


class Texts:
    """Hashed windows of texts; ``size[d]`` words of text d begin at ``base[d]``."""

    def __init__(self, codes: np.ndarray, size: np.ndarray, base: np.ndarray, seed: int):
        self.size, self.seed = size, np.uint64(2 * seed + 1)
        self.one = mix((codes.astype(np.uint64) + np.uint64(1)) * _GOLD * self.seed)
        self.base = base

    def double(self, h: np.ndarray, base: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Windows of twice ``width`` words from those of ``width``, and where each text's begin (texts too short have none)."""
        n = np.maximum(0, self.size - 2 * width + 1)
        at = ranges(base, n)
        return mix(h[at] * _GOLD + h[at + width]), np.cumsum(n) - n

    def store(self) -> None:
        """Hashes of STEP ** k words, as far as texts go."""
        self.stored = [(1, self.one, self.base)]
        h, base, width = self.one, self.base, 1
        while 2 * width <= self.size.max(initial=0):
            h, base = self.double(h, base, width)
            width *= 2
            if width == self.stored[-1][0] * STEP:
                self.stored.append((width, h, base))

    def common(self, text: np.ndarray, i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
        """How many words from i and j (i < j) on are equal, or before them if ``back``."""
        out, most = np.zeros(len(i), np.int64), i if back else self.size[text] - j
        for width, h, base in reversed(self.stored):
            some = np.flatnonzero(out + width <= most)
            while len(some):
                shift = -out[some] - width if back else out[some]
                at = base[text[some]] + shift
                some = some[h[at + i[some]] == h[at + j[some]]]
                out[some] += width
                some = some[out[some] + width <= most[some]]
        return out


def contexts(t: Texts, h: np.ndarray, base: np.ndarray, width: int, periodic: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, hash of its context) of the synchronising set, texts and contexts together, positions ascending. ``periodic`` marks windows that do not count."""
    value = h >> np.uint64(1)
    if periodic is not None:
        value[periodic] = _NONE
    least, step = value, 1
    while step < width:
        least, step = np.minimum(least[:-step], least[step:]), 2 * step
    n = np.maximum(0, t.size - 2 * width + 1)
    n[t.size < 6 * width] = 0
    at = ranges(base, n)
    first, last = value[at], value[at + width]
    low = np.minimum(least[at], last)
    kept = np.flatnonzero(((first == low) | (last == low)) & (low != _NONE))
    at = at[kept]
    text = np.repeat(np.arange(len(n)), n)[kept]
    context = mix(mix(h[at] * _GOLD + h[at + width]) + text.astype(np.uint64) * _GOLD)
    order = np.argsort(context, kind="stable")
    return text[order], (at - base[text])[order], context[order]


def small(codes: np.ndarray, text: np.ndarray, base: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """(text, start, end, period) of runs of periods below 3 * FIRST."""
    out = []
    for p in range(1, 3 * FIRST):
        if len(codes) <= p:
            break
        same = np.zeros(len(codes) - p + 2, np.int8)
        same[1:-1] = (codes[p:] == codes[:-p]) & (text[p:] == text[:-p])
        turn = np.diff(same)
        start, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        some = end - start >= p
        start, end = start[some], end[some] + p
        d = text[start]
        out.append(np.stack([d, start - base[d], end - base[d], np.full(len(d), p)], 1))
    return out


def distinct(found: np.ndarray) -> np.ndarray:
    """Runs with the smallest period of each stretch, by text and start."""
    found = found[np.lexsort((found[:, 3], found[:, 2], found[:, 1], found[:, 0]))]
    first = np.ones(len(found), bool)
    first[1:] = (found[1:, :3] != found[:-1, :3]).any(1)
    return found[first]


def neighbours(found: np.ndarray, t: Texts, codes: np.ndarray, width: int) -> np.ndarray:
    """(text, position, period) proposed by highly periodic regions of one root that overlap or leave at most one word between them."""
    regions = found[(3 * found[:, 3] <= width) & (found[:, 2] - found[:, 1] >= 3 * width - 1)]
    regions = regions[np.lexsort((regions[:, 1], regions[:, 3], regions[:, 0]))]
    a, b = regions[:-1], regions[1:]
    out = [np.zeros((0, 3), np.int64)]
    for (d, b1, e1, r), (_, b2, e2, _) in zip(*(x[(a[:, 0] == b[:, 0]) & (a[:, 3] == b[:, 3]) & (b[:, 1] - a[:, 2] <= 1)].tolist() for x in (a, b)), strict=True):
        here = codes[t.base[d] : t.base[d] + t.size[d]]
        root, last = here[b2 : b2 + r].tobytes(), here[e1 - 2 * r + 1 : e1].tobytes()
        at = last.find(root)
        while at >= 0 and at % here.itemsize:
            at = last.find(root, at + 1)
        if at >= 0:
            shift = b2 - (e1 - 2 * r + 1 + at // here.itemsize)
            p = np.arange(3 * width + (shift - 3 * width) % r, min(6 * width, e1 - b1 + 2, e2 - b2 + 2), r)
            i = np.maximum(b1, b2 - p)
            fits = (i < e1) & (i + p < e2)
            out.append(np.stack([np.full(fits.sum(), d), i[fits], p[fits]], 1))
    return np.concatenate(out)


def marked(found: np.ndarray, t: Texts, base: np.ndarray, total: int, width: int) -> np.ndarray:
    """Which windows of ``width`` words have a period of at most a third of it."""
    some = found[(3 * found[:, 3] <= width) & (found[:, 2] - found[:, 1] >= width)]
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, base[some[:, 0]] + some[:, 1], 1)
    np.add.at(edge, base[some[:, 0]] + some[:, 2] - width + 1, -1)
    return np.cumsum(edge[:-1]) > 0


def proposals(t: Texts, found: np.ndarray, codes: np.ndarray, h: np.ndarray, base: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, position, period) of possible runs at one scale, and which texts may have runs at later ones."""
    found = found[t.size[found[:, 0]] >= 6 * width]
    text, place, context = contexts(t, h, base, width, marked(found, t, base, len(h), width) if 3 <= width and len(found) else None)
    out, ahead = [np.zeros((0, 3), np.int64)], np.zeros(len(t.size), bool)
    left, k = np.arange(len(text)), 1
    while True:
        left = left[left + k < len(text)]
        left = left[context[left] == context[left + k]]
        if k == 1:
            ahead[text[left]] = True
        gap = place[left + k] - place[left]
        left, gap = left[gap < 6 * width], gap[gap < 6 * width]
        if not len(left):
            break
        fits = gap >= 3 * width
        out.append(np.stack([text[left[fits]], place[left[fits]], gap[fits]], 1))
        k += 1
    ahead[found[(3 * found[:, 3] <= width) & (found[:, 2] - found[:, 1] >= 3 * width - 1), 0]] = True
    pairs = np.concatenate(out)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 2], pairs[:, 0]))]
    # Contexts that meet or overlap, at one period, are parts of one run.
    apart = np.ones(len(pairs), bool)
    apart[1:] = (pairs[1:, 0] != pairs[:-1, 0]) | (pairs[1:, 2] != pairs[:-1, 2]) | (pairs[1:, 1] - pairs[:-1, 1] > 2 * width)
    return np.concatenate([pairs[apart], neighbours(found, t, codes, width)]), ahead


def find_runs(codes: np.ndarray, bounds: np.ndarray, seed: int = 0) -> np.ndarray:
    """(text, start, end, period) of all runs of two periods or more, by text, start and period; text d has ``codes[bounds[d]:bounds[d + 1]]``."""
    size, base = np.diff(bounds), bounds[:-1]
    text = np.repeat(np.arange(len(size)), size)
    found = np.concatenate([np.zeros((0, 4), np.int64), *small(codes, text, base, size)])
    t = Texts(codes, size, base, seed)
    h, at = t.double(t.one, t.base, 1)
    repeated, _, context = contexts(t, h, at, FIRST, None)
    some = np.zeros(len(size), bool)
    some[repeated[1:][context[1:] == context[:-1]]] = True
    some[found[found[:, 2] - found[:, 1] >= 3 * FIRST, 0]] = True
    which = np.flatnonzero(some & (size >= 6 * FIRST))
    if len(which):
        # The others are done: runs of longer periods repeat a context or hold a highly periodic region.
        inner = np.append(0, np.cumsum(size[which]))
        number = np.full(len(size), -1)
        number[which] = np.arange(len(which))
        inside = number[found[:, 0]] >= 0
        rest = found[~inside]
        found = found[inside]
        found[:, 0] = number[found[:, 0]]
        found = at_scales(codes[ranges(base[which], size[which])], inner, found, seed)
        found[:, 0] = which[found[:, 0]]
        found = np.concatenate([rest, found])
    found = distinct(found)
    return found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]


def at_scales(codes: np.ndarray, bounds: np.ndarray, found: np.ndarray, seed: int) -> np.ndarray:
    """Add runs of periods from 3 * FIRST on."""
    t = Texts(codes, np.diff(bounds), bounds[:-1], seed)
    t.store()
    h, base = t.double(t.one, t.base, 1)
    width, known = FIRST, distinct(found)
    while t.size.max(initial=0) >= 6 * width:
        more, ahead = proposals(t, known, codes, h, base, width)
        d, i, p = more.T
        right, left = t.common(d, i, i + p), t.common(d, i, i + p, back=True)
        real = right + left >= p
        more = np.stack([d, i - left, i + p + right, p], 1)[real]
        more = distinct(more)
        at, n = bounds[more[:, 0]] + more[:, 1], more[:, 2] - more[:, 1] - more[:, 3]
        for k in range(len(more)):  # hashes proposed it; the words decide
            if not np.array_equal(codes[at[k] : at[k] + n[k]], codes[at[k] + more[k, 3] : at[k] + more[k, 3] + n[k]]):
                return at_scales(codes, bounds, found, seed + 1)
        known = distinct(np.concatenate([known, more]))
        h, base = t.double(h, base, width)
        width *= 2
        gone = ~ahead & (t.size >= 6 * width)
        if gone.any():  # their windows go too
            n = np.where(gone, 0, np.maximum(0, t.size - width + 1))
            h, base = h[ranges(base, n)], np.cumsum(n) - n
            t.size = np.where(gone, 0, t.size)
    return known


def _found(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        loop_from, loop_size = (c.to_numpy(zero_copy_only=False) for c in (batch.column(2).fill_null(0), batch.column(3).fill_null(0)))
        for a, b, data, offsets in blocks(batch.column(1)):
            w = words(data, offsets, lower=False)
            size = np.diff(w.bounds)
            pick = np.arange(len(w))
            for d in np.flatnonzero(loop_size[a:b] > 0).tolist():
                first = w.bounds[d] + loop_from[a + d]
                pick[first : w.bounds[d + 1]] = first + np.arange(max(0, w.bounds[d + 1] - first)) % loop_size[a + d]
            runs = find_runs(word_codes(w)[pick], w.bounds)
            runs = runs[runs[:, 2] - runs[:, 1] >= np.maximum(least, 2 * runs[:, 3])]
            begin = w.bounds[runs[:, 0]]
            edge = np.zeros(len(w) + 1, np.int64)
            np.add.at(edge, begin + runs[:, 1] + runs[:, 3], 1)
            np.add.at(edge, begin + runs[:, 2], -1)
            kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
            # Kept words, each with a blank after it, but for a text's last.
            n = (w.end - w.start)[pick[kept]] + 1
            out = w.data[np.minimum(ranges(w.start[pick[kept]], n), len(w.data) - 1)]
            ends = np.cumsum(n)
            out[ends - 1] = 0x20
            bounds = np.append(0, ends)[np.searchsorted(kept, w.bounds)]
            drop = bounds[1:][np.diff(bounds) > 0] - 1
            out = np.delete(out, drop)
            bounds = bounds - np.append(0, np.cumsum(np.diff(bounds) > 0))
            collapsed = pa.LargeStringArray.from_buffers(b - a, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(out.tobytes())).cast(pa.string())
            per = np.append(0, np.cumsum(np.bincount(runs[:, 0], minlength=b - a)))
            entry = pa.StructArray.from_arrays([pa.array(runs[:, 1]), pa.array(runs[:, 2] - runs[:, 1]), pa.array(runs[:, 3])], names=["start", "length", "period"])
            listed = pa.ListArray.from_arrays(pa.array(per.astype(np.int32)), entry)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(size), listed, collapsed], names=["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, least: int = 12, loop_from: Column | None = None, loop_size: Column | None = None) -> DataFrame:
    """``doc_id, n_words``, ``runs`` (``start, length, period`` in words, by start, then period) and ``collapsed`` of every text: its words without those past a run's first period, one blank between.

    Runs of at least ``least`` words and two periods count. With ``loop_from`` and ``loop_size`` (null or 0: no change) the words
    from number ``loop_from`` on are first replaced by repeats of the ``loop_size`` words there, to plant runs. Null
    and empty texts have no words and no runs. Each row stands for itself: repeated rows and rows without id are
    answered each, an empty table gives an empty one, further columns are not read. Memory is about 100 bytes for each word of the
    longest text, and for texts with repeats 8 more per factor of 8 in their length.
    """
    none = F.lit(None).cast("long")
    given = [none if c is None else c.cast("long") for c in (loop_from, loop_size)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), given[0].alias("_from"), given[1].alias("_size"))
    return rows.mapInArrow(lambda it: tidy(_found(it, least)), "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def digests(docs: DataFrame) -> DataFrame:
    """The runs of every text of ``documents``, every tenth of which (by the checksum of its id) ends in planted repeats."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    n = F.when(h % 10 == 0, F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long"))
    start = F.when(n > 0, g % n)
    found = periodic_runs(docs, 12, start, 1 + F.floor((n - start) / (3 + g % 8)))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    start, length, period = -best["col2"], best["length"], -best["col3"]
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], F.concat(r["period"].cast("string"), F.lit("\n")))))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
