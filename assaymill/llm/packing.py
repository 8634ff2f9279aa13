"""Packing of token sequences into fixed windows: non-negative least squares over length combinations.

Each document is tokenised once and its ids are written to the shared folder. It gives whole windows,
which need no plan, and a remainder shorter than the window. Only the histogram of remainders (fewer
than ``window`` rows, whatever the input) goes to the driver, where

1. all pairs and triples of lengths that fill the window exactly, and all multiples of two lengths, are enumerated (some 370,000 at
   2048 with all lengths present; the number grows with the square of the window, not with the input),
2. their repeat counts are solved against the histogram by non-negative least squares, to its optimality conditions, and rounded,
   first down, then up as far as the histogram holds them; what is left is solved again, until no combination fits,
3. the residual is packed greedily, largest first; a gap that no remaining length fits is filled by
   cutting one, so only the last sequence is padded.

The plan speaks of ranks among the remainders of one length. Each row's rank is its number within its
partition plus the rows of that length in earlier partitions, so a length that a third of the corpus
shares is never gathered.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from bisect import bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assaymill.llm._words import SPACES, Words, blocks, eights, same_words, tidy, words
from assaymill.storage import materialize

#: Pieces of a combination that repeats two lengths.
PIECES = 32
#: Pieces in one of the two tables of a worker.
CACHED = 150_000
#: Cells of (partition, remainder) that are broadcast.
BROADCAST_CELLS = 2_000_000
# How a lower-casing word tokenizer cuts texts.
WORD_NORMALIZER = '{"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\\\s+"}, "content": " "}, {"type": "Lowercase"}]}'
WORD_PATTERN = {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
_DIGIT, _ODD = 2, 4
#: A digit that such a tokenizer never joins with its neighbours.
MARK = "1"
_KIND = np.full(256, _ODD, np.uint8)
_KIND[33:127] = 3
_KIND[97:123] = 1
_KIND[48:58] = _DIGIT
_KIND[39] = _ODD
_KIND[list(SPACES)] = 0
_encoders: dict[str, Encoder] = {}
_TOKENS = "doc_id long, ids binary, n_ids long, part int, rest int, nth long, windows_before long"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Table:
    """Ids of encoded pieces by hash, with the pieces' bytes, so that a hash alone never decides."""

    def __init__(self) -> None:
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.start, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.raw, self.at, self.bytes = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def find(self, hashes: np.ndarray, w: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slot of each distinct hash (-1: absent), and whether the bytes there are those of the words ``which``."""
        if not len(self.keys):
            return np.full(len(hashes), -1), np.ones(len(hashes), bool)
        place = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        slot = np.where(self.keys[place] == hashes, self.slot[place], -1)
        some = np.flatnonzero(slot >= 0)
        size, same = (w.end - w.start)[which[some]], np.ones(len(hashes), bool)
        fits = self.bytes[slot[some]] == size
        fits[fits] = same_words(eights(w.data), w.start[which[some]][fits], eights(self.raw), self.at[slot[some]][fits], size[fits])
        same[some] = fits
        return slot, same

    def add(self, hashes: np.ndarray, w: Words, which: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """New pieces: the words ``which``, with their ids on end and the number of each."""
        order = np.argsort(hashes)
        at = np.searchsorted(self.keys, hashes[order])
        self.slot = np.insert(self.slot, at, len(self.size) + order)
        self.keys = np.insert(self.keys, at, hashes[order])
        size = (w.end - w.start)[which]
        self.at = np.append(self.at, len(self.raw) + np.cumsum(size) - size)
        self.bytes = np.append(self.bytes, size)
        self.raw = np.append(self.raw, w.data[runs(w.start[which], size)])
        self.start = np.append(self.start, len(self.flat) + np.cumsum(sizes) - sizes)
        self.size = np.append(self.size, sizes)
        self.flat = np.append(self.flat, ids)


def runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, ``size`` of them, one run after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    """Ids of texts by a tokenizer file.

    A tokenizer with WORD_PATTERN encodes letter runs, digits and runs of other signs on their own, so their ids
    are kept in two tables: the older one is dropped when the younger is full, and pieces in use move over. Words with
    other bytes than printable ASCII, or with an apostrophe, are pieces as a whole. Texts that hold a special token,
    and all texts of other tokenizers, are encoded as they are.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # every core has a task of its own already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 2**16 else 4
        known = json.loads(self.tokenizer.to_str())
        self.by_piece = known["normalizer"] == json.loads(WORD_NORMALIZER) and json.dumps(WORD_PATTERN) in json.dumps(known["pre_tokenizer"])
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids[0]
        self.young, self.old = Table(), Table()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        coded = [np.array(e.ids, np.uint32) for at in range(0, len(texts), 4000) for e in self.tokenizer.encode_batch_fast(texts[at : at + 4000], add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *coded]), np.fromiter(map(len, coded), np.int64, len(coded))

    def encode_pieces(self, w: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` of the pieces ``which``, many at a time: one between two digits ends where the next digit stands."""
        marked = np.concatenate([[0], np.cumsum(w.data == ord(MARK))])
        marked = marked[w.end[which]] > marked[w.start[which]]
        joined, alone = np.flatnonzero(~marked), np.flatnonzero(marked)
        begin, n = w.start[which[joined]], (w.end - w.start)[which[joined]]
        at = np.append(0, np.cumsum(n + 3))
        line = np.full(at[-1], ord(" "), np.uint8)
        line[at[1:] - 2] = ord(MARK)
        line[runs(at[:-1], n)] = w.data[runs(begin, n)]
        edges = np.append(at[:-1:500], at[-1]).tolist()
        flat, _ = self.encode([line[p:q].tobytes().decode("utf-8", "replace") for p, q in zip(edges[:-1], edges[1:], strict=True)])
        ends = np.flatnonzero(flat == self.mark)
        more, n = self.encode([w.text(i) for i in which[alone].tolist()])
        order, start, size = np.append(joined, alone), np.zeros(len(which), np.int64), np.zeros(len(which), np.int64)
        start[order] = np.concatenate([np.append(0, ends + 1)[: len(ends)], len(flat) + np.cumsum(n) - n])
        size[order] = np.concatenate([np.diff(np.append(-1, ends)) - 1, n])
        return np.append(flat, more)[runs(start, size)], size

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block and the bounds of each text's."""
        n = len(offsets) - 1
        raw = data.tobytes()
        whole = np.full(n, not self.by_piece)
        for token in self.special:
            at = raw.find(token)
            while at >= 0 and not whole.all():
                whole[np.searchsorted(offsets, at, "right") - 1] = True
                at = raw.find(token, at + 1)
        ids, sizes = [np.zeros(0, np.uint32)], np.zeros(n, np.int64)
        at = 0
        while at < n:
            to = at + 1
            while to < n and whole[to] == whole[at]:
                to += 1
            part = raw[offsets[at] : offsets[to]]
            if whole[at]:
                got, sizes[at:to] = self.encode([part[p - offsets[at] : q - offsets[at]].decode("utf-8", "replace") for p, q in zip(offsets[at:to], offsets[at + 1 : to + 1], strict=True)])
            else:
                got, bounds = self.pieced(split(words(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])))
                sizes[at:to] = np.diff(bounds)
            ids.append(got)
            at = to
        bounds = np.zeros(n + 1, np.int64)
        np.cumsum(sizes, out=bounds[1:])
        return np.concatenate(ids), bounds

    def pieced(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts cut into pieces."""
        if not len(w):
            return np.zeros(0, np.uint32), np.zeros(len(w.bounds), np.int64)
        code, distinct = pd.factorize(w.hashes())
        which = np.zeros(len(distinct), np.int64)
        which[code] = np.arange(len(code))
        slot, same = self.young.find(distinct, w, which)
        for source in (self.old, None):
            new = np.flatnonzero(slot < 0)
            if source is not None:
                had, right = source.find(distinct[new], w, which[new])
                found = (had >= 0) & right
                new, had = new[found], had[found]
                sizes = source.size[had]
                ids = source.flat[runs(source.start[had], sizes)]
            else:
                ids, sizes = self.encode_pieces(w, which[new])
            self.young.add(distinct[new], w, which[new], ids, sizes)
            slot[new] = len(self.young.size) - len(new) + np.arange(len(new))
        # A piece whose hash is another piece's is encoded by itself.
        rep, size, eight = which[code], w.end - w.start, eights(w.data)
        right = same[code] & (size == size[rep])
        right[right] = same_words(eight, w.start[right], eight, w.start[rep][right], size[right])
        other = np.flatnonzero(~right)
        flat, start, sizes = self.young.flat, self.young.start[slot][code], self.young.size[slot][code]
        if len(other):
            more, n = self.encode([w.text(i) for i in other.tolist()])
            start[other], sizes[other] = len(flat) + np.cumsum(n) - n, n
            flat = np.append(flat, more)
        ends = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=ends[1:])
        if len(self.young.size) > CACHED:
            self.young, self.old = Table(), self.young
        return flat[runs(start, sizes)], ends[w.bounds]


def split(w: Words) -> Words:
    """Words of printable ASCII without an apostrophe cut into letter runs, digits and runs of other signs."""
    kind = _KIND[w.data]
    begins = np.zeros(len(kind), bool)
    begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    begins &= kind != 0
    odd = np.zeros(len(kind) + 1, np.int32)
    np.cumsum(kind == _ODD, out=odd[1:])
    whole = np.flatnonzero(odd[w.end] > odd[w.start])
    begins[runs(w.start[whole], (w.end - w.start)[whole])] = False
    begins[w.start] = True
    start = np.flatnonzero(begins)
    first = np.searchsorted(start, w.start)
    end = np.append(start[1:], len(kind))
    end[np.append(first[1:], len(start))[: len(first)] - 1] = w.end
    return Words(w.data, start, end, np.append(first, len(start))[w.bounds])


def tokenize(batches: Iterator[pa.RecordBatch], path: str, end_id: int, window: int) -> Iterator[pa.RecordBatch]:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    encoder = _encoders[path]
    kind = np.uint16 if encoder.width == 2 else np.uint32
    part, nth, whole = TaskContext.get().partitionId(), Counter(), 0
    for batch in batches:
        for a, b, data, offsets in blocks(batch.column(1)):
            ids, bounds = encoder.ids(data, offsets)
            out = np.insert(ids, bounds[1:], end_id).astype(kind)
            bounds = bounds + np.arange(len(bounds))
            sizes = np.diff(bounds)
            rest, seen, before = sizes % window, [], []
            for r, n in zip(rest.tolist(), (sizes // window).tolist(), strict=True):
                seen.append(nth[r])
                before.append(whole)
                nth[r] += 1
                whole += n
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer((bounds * encoder.width).astype(np.int64).tobytes()), pa.py_buffer(out.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(pa.int64()), raw, pa.array(sizes), pa.array([part] * (b - a), pa.int32()), pa.array(rest.astype(np.int32)), pa.array(seen, pa.int64()), pa.array(before, pa.int64())], names=["doc_id", "ids", "n_ids", "part", "rest", "nth", "windows_before"])


def combinations(present: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, times): rows of up to three of the lengths ``present`` (marks by length; 0: none) and how often each, that fill the window.

    All pairs and triples, and of two lengths all multiples of up to PIECES pieces.
    """
    a = np.flatnonzero(present)
    a = a[a > 0]
    half = a[2 * a <= window]
    pairs = half[present[window - half]]
    out = [np.stack([np.zeros_like(pairs), pairs, window - pairs], 1)]
    for x in half[3 * half <= window].tolist():
        y = half[(half >= x) & (2 * half <= window - x)]
        y = y[present[window - x - y]]
        out.append(np.stack([np.full_like(y, x), y, window - x - y], 1))
    lengths = np.concatenate(out)
    times = (lengths > 0).astype(np.int64)
    more, often = [lengths], [times]
    for n in range(1, PIECES + 1):
        for m in range(PIECES - n + 1):
            if n + m < 3 or (n, m) in ((1, 2), (2, 1)):
                continue  # a pair or a triple
            x = a[(n * a <= window - m) if m else (n * a == window)]
            x = x[(window - n * x) % m == 0] if m else x
            y = (window - n * x) // m if m else np.zeros_like(x)
            fits = (y > x) & present[y] if m else np.ones(len(x), bool)
            more.append(np.stack([x, y, np.zeros_like(x)], 1)[fits])
            often.append(np.broadcast_to([n, m, 0], (int(fits.sum()), 3)))
    return np.concatenate(more).astype(np.int32), np.concatenate(often)


def repeats(combos: np.ndarray, often: np.ndarray, want: np.ndarray, close: float = 1e-2, steps: int = 400) -> np.ndarray:
    """Non-negative repeat counts that bring the combinations' lengths closest to ``want``, a count for each length.

    Accelerated projected gradient, each combination with a step of its own, begun anew where it overshoots, until the optimality
    conditions hold to ``close`` repeats: no step up is left, and none down but at 0. The steps are bounded; what rounding
    leaves is solved again.
    """
    x = y = np.zeros(len(combos))
    if not len(combos):
        return x
    columns = [(np.ascontiguousarray(combos[:, j]), often[:, j].astype(float)) for j in range(3)]
    laid = lambda v: sum(np.bincount(c, v * k, len(want)) for c, k in columns)
    seen = lambda g: sum(g[c] * k for c, k in columns)
    rate, t = 1.0 / np.maximum(seen(laid(np.ones(len(combos)))), 1.0), 1.0  # bounds the curvature, as nothing is negative
    for i in range(steps):
        gap = want - laid(y)
        gap[0] = 0
        move = np.maximum(rate * seen(gap), -y)
        if i % 20 == 0 and np.abs(move).max() <= close * rate.min():
            return y
        step = y + move
        if (y - step) @ (step - x) > 0:
            t = 1.0
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        x, y = step, np.maximum(0, step + (last - 1) / t * (step - x))
    return x


class Pool:
    """Remainders still to be packed, as intervals of ranks: length -> [(remainder, low, high, start of the piece)]."""

    def __init__(self, histogram: dict[int, int]):
        self.items: dict[int, list[tuple[int, int, int, int]]] = {n: [(n, 0, c, 0)] for n, c in histogram.items() if n and c}
        self.count = {n: c for n, c in histogram.items() if n and c}
        self.lengths = sorted(self.count)

    def take(self, length: int, n: int) -> list[tuple[int, int, int, int]]:
        out = []
        self.count[length] -= n
        while n:
            r, low, high, start = self.items[length].pop()
            k = min(n, high - low)
            if low + k < high:
                self.items[length].append((r, low + k, high, start))
            out.append((r, low, low + k, start))
            n -= k
        if not self.count[length]:
            self.lengths.remove(length)
            del self.count[length], self.items[length]
        return out

    def put(self, length: int, intervals: list[tuple[int, int, int, int]]) -> None:
        if length not in self.count:
            insort(self.lengths, length)
            self.count[length], self.items[length] = 0, []
        self.items[length] += intervals
        self.count[length] += sum(high - low for _, low, high, _ in intervals)

    def fitting(self, most: int, used: Counter) -> int:
        """The largest length of at most ``most`` that still has an unused item; 0: none."""
        i = bisect_right(self.lengths, most)
        while i and used[self.lengths[i - 1]] >= self.count[self.lengths[i - 1]]:
            i -= 1
        return self.lengths[i - 1] if i else 0


def plan(histogram: dict[int, int], window: int) -> tuple[np.ndarray, int]:
    """((remainder, low rank, high rank, start, length, first sequence, offset) rows, number of sequences)."""
    pool, rows, sequences = Pool(histogram), array("q"), 0

    def emit(intervals: list[tuple[int, int, int, int]], length: int, offset: int) -> None:
        at = sequences
        for r, low, high, start in intervals:
            rows.extend((r, low, high, start, length, at, offset))
            at += high - low

    def repeat(i: int, most: int) -> int:
        """Lay a combination into as many sequences as the pool holds, at most so many."""
        nonlocal sequences
        need: Counter = Counter()
        for k, m in zip(combos[i].tolist(), often[i].tolist(), strict=True):
            if m:
                need[k] += m
        n = min([most, *(pool.count.get(k, 0) // m for k, m in need.items())])
        if n > 0:
            offset = 0
            for k in need.elements():
                emit(pool.take(k, n), k, offset)
                offset += k
            sequences += n
        return max(n, 0)

    want, placed = np.zeros(window + 1), 1
    want[list(pool.count)] = list(pool.count.values())
    combos, often = combinations(want > 0, window)
    while placed and len(combos):
        times = repeats(combos, often, want)
        # Whole repeats first, then one more of each combination, the largest fractions first; each as far as the histogram holds it.
        whole = np.floor(times + 1e-9)
        some = np.flatnonzero(whole > 0)
        placed = sum(repeat(i, int(whole[i])) for i in some[np.argsort(-whole[some], kind="stable")].tolist())
        some = np.flatnonzero(times > whole)
        placed += sum(repeat(i, 1) for i in some[np.argsort((whole - times)[some], kind="stable")].tolist())
        want[:] = 0
        want[list(pool.count)] = list(pool.count.values())
        left = (want[combos] >= often).all(1)  # what the histogram still holds once
        combos, often = combos[left], often[left]
    while pool.lengths:
        used: Counter = Counter()
        gap, cut = window, 0
        while gap and (k := pool.fitting(gap, used)):
            used[k] += 1
            gap -= k
        if gap and (k := pool.fitting(window, used)):
            cut = k
        n = min(pool.count[k] // m for k, m in (used + Counter([cut] if cut else [])).items())
        offset = 0
        for k in sorted(used.elements(), reverse=True):
            emit(pool.take(k, n), k, offset)
            offset += k
        if cut:
            taken = pool.take(cut, n)
            emit(taken, gap, offset)
            pool.put(cut - gap, [(r, low, high, start + gap) for r, low, high, start in taken])
        sequences += n
    return np.array(rows, np.int64).reshape(-1, 7), sequences


class Plan:
    """The plan's rows by remainder, start of the piece and rank."""

    def __init__(self, rows: np.ndarray, planned: int, window: int):
        self.planned, self.window = planned, window
        self.shift = 63 - (window * window).bit_length()
        if len(rows) and int(rows[:, 2].max()).bit_length() > self.shift:
            raise ValueError(f"too many rows of one length for a window of {window}")
        keys = self.key(rows[:, 0], rows[:, 3], rows[:, 1])
        order = np.argsort(keys)
        self.keys, self.low, self.length, self.sequence, self.offset = keys[order], *(rows[order, j] for j in (1, 4, 5, 6))

    def key(self, rest: np.ndarray, start: np.ndarray, rank: np.ndarray) -> np.ndarray:
        return ((rest * self.window + start) << self.shift) + rank

    def pieces(self, n: np.ndarray, rest: np.ndarray, rank: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, start, length, sequence, offset) of the pieces of rows of ``n`` ids."""
        whole = n // self.window
        row, nth = np.repeat(np.arange(len(n)), whole), runs(np.zeros(len(n), np.int64), whole)
        out = [(row, nth * self.window, np.full(len(row), self.window), self.planned + first[row] + nth, np.zeros(len(row), np.int64))]
        row, start = np.flatnonzero(rest), np.zeros(np.count_nonzero(rest), np.int64)
        while len(row):
            at = np.searchsorted(self.keys, self.key(rest[row], start, rank[row]), "right") - 1
            out.append((row, n[row] - rest[row] + start, self.length[at], self.sequence[at] + rank[row] - self.low[at], self.offset[at]))
            start = start + self.length[at]
            more = start < rest[row]
            row, start = row[more], start[more]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def pieces(batches: Iterator[pa.RecordBatch], plan: Plan, width: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, ids, n_ids, rest, rank, first whole window) to one row per piece."""
    for batch in batches:
        n, rest, rank, first = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[2:])
        row, start, length, sequence, offset = plan.pieces(n, rest, rank, first)
        order = np.argsort(row, kind="stable")
        row, start, length, sequence, offset = (x[order] for x in (row, start, length, sequence, offset))
        check, last, wide = np.zeros(len(row), np.int64), -1, b""
        for i, (r, s, m) in enumerate(zip(row.tolist(), start.tolist(), length.tolist(), strict=True)):
            if r != last:
                wide, last = memoryview(np.frombuffer(batch.column(1)[r].as_buffer(), np.uint16 if width == 2 else np.uint32).astype("<u4").tobytes()), r
            check[i] = zlib.crc32(wide[4 * s : 4 * (s + m)])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *map(pa.array, (start, length, check, n[row], sequence, offset))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of all rows' token ids, laid into sequences of ``window``: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A row's ids are its text's by ``tokenizer`` (a file), then ``end_id``; null and empty texts have
    that id alone. Every row is packed, repeated rows and rows without an id too. An empty table gives
    no piece. Other columns are not read.
    """
    width = Encoder(tokenizer).width
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tokens = materialize(texts.mapInArrow(lambda it: tidy(tokenize(it, tokenizer, end_id, window)), _TOKENS), "tokens")
    rests = tokens.where("rest > 0").groupBy("part", "rest").agg(F.count("*").alias("n"))
    wholes = tokens.groupBy("part").agg(F.sum(F.floor(F.col("n_ids") / window)).alias("n")).select("part", F.lit(0).alias("rest"), "n")
    counts = materialize(rests.unionByName(wholes), "counts")
    histogram = {r["rest"]: r["n"] for r in counts.where("rest > 0").groupBy("rest").agg(F.sum("n").alias("n")).collect()}
    found = Plan(*plan(histogram, window), window)

    # One row per partition: what earlier partitions have of each remainder, and of whole windows at place 0.
    grid = counts.where("rest = 0").select("part", F.explode(F.sequence(F.lit(0), F.lit(window - 1))).alias("rest"))
    earlier = F.sum("n").over(Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    grid = grid.join(counts, ["part", "rest"], "left").select("part", "rest", F.coalesce(earlier, F.lit(0)).alias("before"))
    before = materialize(grid.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("rest", "before")))["before"].alias("before")), "before")
    if before.count() * window <= BROADCAST_CELLS:
        before = F.broadcast(before)
    placed = tokens.join(before, "part").select("doc_id", "ids", "n_ids", "rest", (F.col("nth") + F.get("before", "rest")).alias("rank"), (F.col("windows_before") + F.get("before", F.lit(0))).alias("first"))
    return placed.mapInArrow(lambda it: tidy(pieces(it, found, width)), _PIECES)
