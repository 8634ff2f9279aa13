"""Words of Arrow text columns as numpy arrays: offsets and 64-bit hashes, without a Python object per word.

A word is ``[^\\x20\\x09-\\x0D]+``. Those six bytes never occur inside a longer UTF-8 sequence, so
words are cut on the encoded bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
BLOCK_BYTES = 1_000_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Which of eight bytes, first byte lowest, belong to a word with so many left.
_MASK = np.array([2 ** (8 * i) - 1 for i in range(9)], np.uint64)
#: Longer words are hashed one by one.
LONG = 256
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[list(SPACES)] = False


def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches as they come; then freed memory goes back to the system, for a worker lives on between tasks."""
    yield from batches
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on, as one number; zeros follow the last."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, np.uint64, padded, strides=(1,))


def same_words(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes from each ``a_start`` are those from each ``b_start``; ``a`` and ``b`` come from ``eights``."""
    mask = _MASK[np.minimum(size, 8)]
    same = ((a[a_start] ^ b[b_start]) & mask) == 0
    more, at = np.flatnonzero(same & (size > 8)), 8
    while len(more):
        same[more] = ((a[a_start[more] + at] ^ b[b_start[more] + at]) & _MASK[np.minimum(size[more] - at, 8)]) == 0
        at += 8
        more = more[same[more] & (size[more] > at)]
    return same


@dataclass
class Words:
    """Words of a block of texts; ``bounds[d]:bounds[d + 1]`` are those of text d."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, equal wherever the word occurs.

        Eight bytes at a time go through a bijection that is not linear, so words of up to eight bytes and one length
        never meet, and no pattern of longer ones makes them meet more often than chance.
        """
        size = self.end - self.start
        h = mix(size.astype(np.uint64) * _GOLD + _GOLD)
        if not len(h):
            return h
        eight = eights(self.data)
        some = np.flatnonzero(size <= LONG)
        every = len(some) == len(size)
        start, left, acc = (self.start, size, h) if every else (self.start[some], size[some], h[some])
        acc = mix((acc ^ (eight[start] & _MASK[np.minimum(left, 8)])) * _GOLD)
        more, at = np.flatnonzero(left > 8), 8
        while len(more):
            acc[more] = mix((acc[more] ^ (eight[start[more] + at] & _MASK[np.minimum(left[more] - at, 8)])) * _GOLD)
            at += 8
            more = more[left[more] > at]
        if every:
            return acc
        h[some] = acc
        for i in np.flatnonzero(size > LONG).tolist():
            h[i] = xxhash.xxh3_64_intdigest(self.data[self.start[i] : self.end[i]])
        return h

    def text(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")

    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def blocks(texts: pa.Array | pa.ChunkedArray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) over runs of whole texts of about ``size`` bytes; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True, letters: np.ndarray = _IS_WORD) -> Words:
    """Cut a block from ``blocks`` into words, A-Z in lower case if asked. ``letters`` says which bytes belong to words."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = letters[data]
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    begins[cut] |= inside[cut + 1]  # a word never runs on from one text into the next
    ends[cut - 1] |= inside[cut]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(_LOWER[data] if lower else data, start, end, np.searchsorted(start, offsets))


def shingle_sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed k-word shingles of each text, sorted, and their bounds; a text of fewer words is one shingle."""
    h = w.hashes()
    sizes = np.diff(w.bounds)
    counts = np.where(sizes >= k, sizes - k + 1, np.minimum(sizes, 1))
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    s = np.zeros(out[-1], np.uint64)
    long = sizes >= k
    where = np.repeat(w.bounds[:-1] - out[:-1], counts) + np.arange(out[-1])
    full = np.repeat(long, counts)
    at = where[full]
    acc = np.zeros(len(at), np.uint64)
    for j in range(k):
        acc = mix(acc * _GOLD + h[at + j])
    s[full] = acc
    for d in np.flatnonzero(~long & (sizes > 0)):
        acc = np.full(1, sizes[d], np.uint64)
        for x in h[w.bounds[d] : w.bounds[d + 1]]:
            acc = mix(acc * _GOLD + np.uint64(x))
        s[out[d]] = acc[0]
    keep = np.ones(len(s), bool)
    for a, b in zip(out[:-1].tolist(), out[1:].tolist()):
        s[a:b].sort()
    if len(s):
        keep[1:] = s[1:] != s[:-1]
        keep[out[:-1][counts > 0]] = True
    kept = np.zeros(len(s) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    return s[keep], kept[out]
