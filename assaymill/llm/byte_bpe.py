"""Byte-level BPE: texts to token ids and back, merging by a segment tree over the ranks of adjacent pairs.

A text is cut into pieces, and each distinct piece of a block is merged once. Over a piece stands a segment
tree whose leaf i holds ``rank << 32 | i`` of the pair of symbol i and its right neighbour (NONE where
the pair does not merge), and whose inner nodes hold the least of their children. So the root names
the leftmost pair of lowest rank; merging it changes three leaves, each repaired up to the root in
logarithmic time, until the root is NONE. Short pieces of a block are merged side by side, one merge
of each tree at a time, as rows of one array; a long piece has a tree of its own.

Pieces in use are kept with their ids from block to block (``packing.Table``: found by hash, decided by
bytes), in two tables of bounded size.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaymill.llm._words import Words, blocks, tidy
from assaymill.llm.packing import Encoder, Table, runs

NONE = np.int64(2**63 - 1)
#: Pieces of more symbols have a tree of their own.
SIDE_BY_SIDE = 64
#: Trees of one array.
ROWS = 1 << 14
#: Places of the table in which pairs are looked up; at least four for each pair.
SLOTS = 1 << 18
#: Bytes that are cut into pieces at a time, up to the next blank.
PART = 1 << 22
_LETTER, _NUMBER, _SPACE, _OTHER = range(4)
# What byte-level tokenizers split off after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
_coders: dict[str, ByteBPE] = {}


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it prints, else the next from U+0100 on."""
    prints = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


@functools.cache
def kinds() -> np.ndarray:
    """Letter, number, space or other, of every code point."""
    # surrogates stand in no text
    every = "".join(map(chr, [*range(0xD800), *[0] * 0x800, *range(0xE000, 0x110000)]))
    out = np.full(0x110000, _OTHER, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


def cut(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Starts of the pieces of UTF-8 ``data``; none runs over one of ``edges`` (sorted, first 0).

    A piece is a contraction (ENDINGS), or a run of letters, of numbers or of other signs, each with one blank
    before it, or white space: to the end, or up to the last space before another sign.
    """
    at = np.flatnonzero((data & 0xC0) != 0x80)
    if not len(at):
        return at
    first = data[at]
    point = first.astype(np.int64)
    wide = np.flatnonzero(first >= 0xC0)
    if len(wide):
        lead = first[wide].astype(np.int64)
        more = (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)
        point[wide] = lead & (0x3F >> more)
        for k in (1, 2, 3):
            some = wide[more >= k]
            point[some] = point[some] << 6 | data[np.minimum(at[some] + k, len(data) - 1)] & 0x3F
    kind = kinds()[np.minimum(point, 0x10FFFF)]
    edge = np.zeros(len(at) + 1, bool)
    edge[np.searchsorted(at, edges)] = True
    edge[0] = edge[-1] = True
    starts = edge[:-1].copy()
    starts[1:] |= kind[1:] != kind[:-1]
    space = kind == _SPACE
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~edge[1:-1])
    starts[last] = True
    starts[last[point[last] == 0x20] + 1] = False
    tick = np.flatnonzero((point == 0x27) & starts)
    for ending in ENDINGS:
        n = len(ending)
        some = tick[tick + n < len(at)]
        for k, letter in enumerate(ending, 1):
            some = some[(point[some + k] == ord(letter)) & ~edge[some + k]]
        starts[some + 1] = False
        then = some + n + 1
        starts[then[then < len(at)]] = True
    return at[starts]


def parts(data: np.ndarray, special: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of parts of about PART bytes, each but the first from a blank or line feed after a printable ASCII sign, where a piece begins whatever surrounds it."""
    at = 0
    while at < len(data):
        to, look = len(data), at + PART
        while look < len(data) and to == len(data):
            seen = data[look - 1 : look + PART]
            safe = look + np.flatnonzero(((seen[1:] == 0x20) | (seen[1:] == 0x0A)) & (seen[:-1] > 0x20) & (seen[:-1] < 0x7F))
            safe = safe[np.searchsorted(special[:, 0], safe, "left") == np.searchsorted(special[:, 1], safe, "right")]  # in no added token
            to, look = int(safe[0]) if len(safe) else to, look + PART
        yield at, to
        at = to


def _slot(pair: np.ndarray) -> np.ndarray:
    """Where the search for a pair begins in a table of SLOTS."""
    return ((pair * 0x9E3779B1) ^ (pair >> 32) * 0x85EBCA6B) >> 7 & (SLOTS - 1)


class ByteBPE(Encoder):
    """Ids of texts by a byte-level BPE file of the tokenizers library, and texts of ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            known = json.load(f)
        model, pre = known["model"], known["pre_tokenizer"] or {}
        plain = pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre.get("use_regex", True) and not known["normalizer"] and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if model["type"] != "BPE" or not plain or (known["decoder"] or {}).get("type") != "ByteLevel" or any(t[k] for t in known["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path} is no plain byte-level BPE")
        byte = {c: b for b, c in enumerate(byte_letters())}
        vocab = model["vocab"]
        self.added = {t["content"].encode(): t["id"] for t in known["added_tokens"]}
        self.added_pattern = re.compile(b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        held = {i: bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t, i in vocab.items()} | {i: t for t, i in self.added.items()}
        size = max(held) + 1
        self.token_size = np.array([len(held.get(i, b"")) for i in range(size)])
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.token_bytes = np.frombuffer(b"".join(held.get(i, b"") for i in range(size)), np.uint8)
        self.symbol = np.array([vocab[c] for c in byte_letters()], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, merged = (np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in pairs), strict=True))
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        # of a pair that stands twice, the last rank holds
        order = order[np.append(key[order][1:] != key[order][:-1], True)]
        self.pairs, self.ranks, self.merged = key[order], order, merged
        self.slots = np.full(SLOTS, -1)
        for at, place in enumerate(_slot(self.pairs).tolist()):
            while self.slots[place] >= 0:
                place = (place + 1) & (SLOTS - 1)
            self.slots[place] = at
        self.by_pair = dict(zip(self.pairs.tolist(), self.ranks.tolist(), strict=True))
        self.young, self.old = Table(), Table()

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, -1 where they do not merge."""
        key = left << 32 | right
        place = _slot(key)
        at = self.slots[place]
        out = np.where(self.pairs[at] == key, self.ranks[at], -1)
        more = np.flatnonzero((out < 0) & (at >= 0))
        while len(more):
            place[more] = (place[more] + 1) & (SLOTS - 1)
            at = self.slots[place[more]]
            same = (self.pairs[at] == key[more]) & (at >= 0)
            out[more[same]] = self.ranks[at[same]]
            more = more[~same & (at >= 0)]
        return out

    def merge_many(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``merge`` of pieces of about one size side by side: one row of ``symbols`` (padded) each; ids on end, and how many each has."""
        n, width = symbols.shape
        leaves = 1 << max(0, (width - 2).bit_length())
        place = np.arange(width)
        inside = place < sizes[:, None]
        # Arrays of one row per piece, flat; a last symbol of each row, -1, merges with nothing.
        after = np.where(place < sizes[:, None] - 1, place + 1, width).ravel()
        before = np.where(inside, place - 1, -1).ravel()
        symbols = np.concatenate([np.where(inside, symbols, -1), np.full((n, 1), -1)], 1)
        first = np.full((n, 2 * leaves), NONE)
        rank = self.rank(symbols[:, :-2].ravel(), symbols[:, 1:-1].ravel()).reshape(n, width - 1)
        first[:, leaves : leaves + width - 1] = np.where((rank >= 0) & inside[:, 1:], rank << 32 | place[:-1], NONE)
        at = leaves
        while at > 1:
            first[:, at // 2 : at] = np.minimum(first[:, at : 2 * at : 2], first[:, at + 1 : 2 * at : 2])
            at //= 2
        symbols, tree = symbols.ravel(), first.ravel()
        row = np.flatnonzero(first[:, 1] != NONE)
        while len(row):
            s, a, t = row * (width + 1), row * width, row * (2 * leaves)
            root = tree[t + 1]
            i = root & 0xFFFFFFFF
            j = after[a + i]
            then = after[a + j]
            new = self.merged[root >> 32]
            symbols[s + i], symbols[s + j] = new, -2
            after[a + i] = then
            inner = then < width
            before[(a + then)[inner]] = i[inner]
            h = before[a + i]
            ahead = h >= 0
            h = np.where(ahead, h, i)
            rank = self.rank(np.append(new, symbols[s + h]), np.append(symbols[s + then], new))
            right, left = rank[: len(row)], rank[len(row) :]
            tree[(t + leaves + j)[inner]] = NONE
            tree[t + leaves + i] = np.where(inner & (right >= 0), right << 32 | i, NONE)
            tree[(t + leaves + h)[ahead]] = np.where(left >= 0, left << 32 | h, NONE)[ahead]
            h, i, j = h + leaves, i + leaves, np.minimum(j, leaves - 1) + leaves
            for _ in range(leaves.bit_length() - 1):
                h, i, j = h >> 1, i >> 1, j >> 1
                for node in (j, i, h):
                    below = t + 2 * node
                    tree[t + node] = np.minimum(tree[below], tree[below + 1])
            row = row[tree[t + 1] != NONE]
        kept = (symbols >= 0).reshape(n, width + 1)
        return symbols[kept.ravel()], kept.sum(1)

    def merge(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of one piece, given the ids of its bytes."""
        n = len(symbols)
        if n < 2:
            return symbols
        leaves = 1 << (n - 2).bit_length()
        base = np.full(2 * leaves, NONE)
        rank = self.rank(symbols[:-1], symbols[1:])
        base[leaves : leaves + n - 1] = np.where(rank >= 0, rank << 32 | np.arange(n - 1), NONE)
        at = leaves
        while at > 1:
            base[at // 2 : at] = np.minimum(base[at : 2 * at : 2], base[at + 1 : 2 * at : 2])
            at //= 2
        tree, ids, none = base.tolist(), symbols.tolist(), int(NONE)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        known, merged = self.by_pair, self.merged.tolist()

        def put(i: int, key: int) -> None:
            i += leaves
            if tree[i] == key:
                return
            tree[i] = key
            while i > 1:
                key = min(tree[i], tree[i ^ 1])
                i >>= 1
                if tree[i] == key:
                    return
                tree[i] = key

        while tree[1] != none:
            i, j = (root := tree[1]) & 0xFFFFFFFF, after[tree[1] & 0xFFFFFFFF]
            ids[i], ids[j] = merged[root >> 32], -1
            then, h = after[j], before[i]
            after[i], before[then] = then, i
            if then < n:
                put(j, none)
            rank = known.get(ids[i] << 32 | ids[then]) if then < n else None
            put(i, none if rank is None else rank << 32 | i)
            if h >= 0:
                rank = known.get(ids[h] << 32 | ids[i])
                put(h, none if rank is None else rank << 32 | h)
        out = np.array(ids, np.int64)
        return out[out >= 0]

    def encode_pieces(self, w: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces ``which`` on end, and how many each has."""
        size = (w.end - w.start)[which]
        count, at = np.zeros(len(which), np.int64), np.zeros(len(which), np.int64)
        out, total = [np.zeros(0, np.int64)], 0
        width = 1
        while width <= SIDE_BY_SIDE:
            every = np.flatnonzero((size <= width) & (size > width // 2))
            for some in (every[k : k + ROWS] for k in range(0, len(every), ROWS)):
                place = np.minimum(w.start[which[some], None] + np.arange(width), len(w.data) - 1)
                ids, n = self.merge_many(self.symbol[w.data[place]], size[some])
                count[some], at[some] = n, total + np.cumsum(n) - n
                out.append(ids)
                total += len(ids)
            width *= 2
        for k in np.flatnonzero(size > SIDE_BY_SIDE).tolist():
            ids = self.merge(self.symbol[w.data[w.start[which[k]] : w.end[which[k]]]])
            count[k], at[k] = len(ids), total
            out.append(ids)
            total += len(ids)
        return np.concatenate(out)[runs(at, count)].astype(np.uint32), count

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of single pieces whose hash is another piece's."""
        raw = [t.encode() for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        return self.encode_pieces(Words(data, np.cumsum(size) - size, np.cumsum(size), np.array([0, len(raw)])), np.arange(len(raw)))

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block and the bounds of each text's."""
        edges, special = offsets, np.zeros((0, 3), np.int64)
        if self.added_pattern:
            raw, found, at = data.tobytes(), [], 0
            while m := self.added_pattern.search(raw, at):
                text_end = int(offsets[np.searchsorted(offsets, m.start(), "right")])
                if m.end() <= text_end:
                    found.append((m.start(), m.end(), self.added[m[0]]))
                    at = m.end()
                elif m := self.added_pattern.search(raw, m.start(), text_end):  # a shorter one may fit
                    found.append((m.start(), m.end(), self.added[m[0]]))
                    at = m.end()
                else:
                    at = text_end
            if found:
                special = np.array(found)
                edges = np.unique(np.concatenate([offsets, special[:, 0], special[:, 1]]))
        marks, ids = np.append(offsets, special[:, 0]), [np.zeros(0, np.uint32)]
        places = np.zeros(len(marks), np.int64)
        for a, b in parts(data, special):
            inside = edges[(edges >= a) & (edges < b)] - a
            start = a + cut(data[a:b], inside)
            end = np.append(start[1:], b)
            # an added token has been cut into pieces too; they give way to its id
            first, last = np.searchsorted(start, special[:, 0]), np.searchsorted(start, special[:, 1])
            keep = np.ones(len(start), bool)
            keep[runs(first, last - first)] = False
            start, end = start[keep], end[keep]
            got, bounds = self.pieced(Words(data, start, end, np.searchsorted(start, marks)))
            places += bounds
            ids.append(got)
        ids = np.insert(np.concatenate(ids), places[len(offsets) :], special[:, 2].astype(np.uint32))
        return ids, places[: len(offsets)] + np.searchsorted(special[:, 0], offsets)

    def text_bytes(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that ids stand for; ids outside the vocabulary stand for none."""
        ids = ids[ids < len(self.token_size)]
        return self.token_bytes[runs(self.token_start[ids], self.token_size[ids])]


def coder(path: str) -> ByteBPE:
    """The tokenizer of ``path``, read once in each worker."""
    if path not in _coders:
        _coders[path] = ByteBPE(path)
    return _coders[path]


def _encoded(batches: Iterator[pa.RecordBatch], path: str, text_at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in blocks(batch.column(text_at)):
            ids, bounds = coder(path).ids(data, offsets)
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer((bounds * 4).astype(np.int64).tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())]).cast(pa.binary())
            kept = [c.slice(a, b - a) for i, c in enumerate(batch.columns) if i != text_at]
            yield pa.RecordBatch.from_arrays([*kept, raw, pa.array(np.diff(bounds))], names=[str(i) for i in range(len(kept) + 2)])


def _decoded(batches: Iterator[pa.RecordBatch], path: str, ids_at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [coder(path).text_bytes(np.frombuffer(raw, "<u4")).tobytes().decode("utf-8", "replace") for raw in (x.as_buffer() if x.is_valid else b"" for x in batch.column(ids_at))]
        kept = [c for i, c in enumerate(batch.columns) if i != ids_at]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string())], names=[str(i) for i in range(len(kept) + 1)])


def _schema(df: DataFrame, without: str, more: list[tuple[str, T.DataType]]) -> T.StructType:
    """The other columns under their numbers, then new ones: names may clash or repeat in between."""
    kept = [f.dataType for f in df.schema if f.name != without]
    return T.StructType([T.StructField(str(i), t) for i, t in enumerate([*kept, *(t for _, t in more)])])


def encode(docs: DataFrame, tokenizer: str, text_col: str = "text", ids_col: str = "ids", size_col: str = "n_tokens") -> DataFrame:
    """Replace ``text_col`` by its token ids (``ids_col``: little-endian unsigned 32-bit numbers on end) and how many they are (``size_col``).

    ``tokenizer`` is a byte-level BPE file of the tokenizers library that every executor can read. Ids are
    those of the library without added begin or end tokens, truncation and padding; strings of added tokens
    in a text become those tokens. Null and empty texts have no ids. Each row stands for itself, so repeated
    rows, ties and rows without an id need no rule, and an empty table gives an empty one. All other columns
    stay; columns named as the new ones are replaced. A text may have up to 500 MB, as its ids are one value.
    """
    docs = docs.select(*[c for c in docs.columns if c not in {ids_col, size_col} - {text_col}])
    docs = docs.withColumn(text_col, F.col(f"`{text_col}`").cast("string"))
    schema = _schema(docs, text_col, [(ids_col, T.BinaryType()), (size_col, T.LongType())])
    at = docs.columns.index(text_col)
    names = [c for c in docs.columns if c != text_col]
    return docs.mapInArrow(lambda it: tidy(_encoded(it, tokenizer, at)), schema).toDF(*names, ids_col, size_col)


def decode(coded: DataFrame, tokenizer: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """Replace ``ids_col``, as ``encode`` writes it, by the text the ids stand for; bytes that are no UTF-8 become U+FFFD.

    Null ids give an empty text; ids outside the vocabulary stand for nothing. All other columns stay, but for one named ``text_col``.
    """
    coded = coded.select(*[c for c in coded.columns if c != text_col or c == ids_col])
    schema = _schema(coded, ids_col, [(text_col, T.StringType())])
    at = coded.columns.index(ids_col)
    names = [c for c in coded.columns if c != ids_col]
    return coded.mapInArrow(lambda it: tidy(_decoded(it, tokenizer, at)), schema).toDF(*names, text_col)


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every text."""
    coded = encode(docs.select("doc_id", "text"), tokenizer).withColumn("ids_sha256", F.sha2("ids", 256))
    back = decode(coded, tokenizer)
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), "n_tokens", "ids_sha256", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
