"""Byte BPE against its library, the trie and the runs against slow readings of their definitions."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from assaymill.llm import byte_bpe, conversation_trie, periodic_runs
from tests.llm.data import frame, rows

WORD = re.compile("[^\x20\x09-\x0d]+")
SF = "/root/testdata/sf0.001"


def path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(path())


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def ids_of(texts):
    raw = [t.encode() for t in texts]
    ids, bounds = byte_bpe.coder(path()).ids(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]


def test_bpe_of_odd_texts(library):
    rng = random.Random(1)
    signs = ["a", "s", "t", "re", "'", " ", "\n", "1", "!", "é", "　", "\xa0", "你", "<|endoftext|>", "<|endof", "text|>", "ll", "ve", "m", "d", "\x1c", "\x85", "\t", "​", "xxxxx", "the", "ing", "𝒳"]
    texts = ["", "'s", " 's", "!'s", "''s", "I'll", "a  b\n\n c \n", "<|endof", "text|>", "x  <|endoftext|><|endoftext|> y"]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(4000)]
    got = ids_of(texts)
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    coder = byte_bpe.coder(path())
    assert [coder.text_bytes(np.array(x, np.int64)).tobytes().decode() for x in got] == texts


def test_bpe_knows_every_code_point(library):
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and (i < 0x3400 or i % 7 == 0)]
    texts = ["".join(f"a{x}a1{x}1 {x}\n" for x in points[i : i + 60]) for i in range(0, len(points), 60)]
    assert ids_of(texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_bpe_of_long_pieces_and_parts(library, monkeypatch):
    rng = random.Random(2)
    piece = "".join(rng.choice("abcdefgh") for _ in range(30_000))
    assert ids_of([piece, "a" * 20_000]) == [library.encode(t, add_special_tokens=False).ids for t in (piece, "a" * 20_000)]
    monkeypatch.setattr(byte_bpe, "PART", 50)
    texts = ["some words, and\nmore <|endoftext|> of them  than before! " * 50, piece[:300], "", "é è à " * 100]
    assert ids_of(texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_trees_side_by_side_and_alone():
    coder, rng = byte_bpe.coder(path()), random.Random(3)
    pieces = ["".join(rng.choice("theinanders ") for _ in range(rng.randrange(1, 33))).encode() for _ in range(300)]
    sizes = np.array(list(map(len, pieces)))
    symbols = np.zeros((300, 32), np.int64)
    for i, p in enumerate(pieces):
        symbols[i, : len(p)] = coder.symbol[list(p)]
    ids, n = coder.merge_many(symbols, sizes)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [coder.merge(coder.symbol[list(p)]).tolist() for p in pieces]


def test_bpe_digests(spark, library):
    docs = frame(spark)
    got = sorted(map(tuple, byte_bpe.digests(docs, path()).collect()), key=repr)
    want = []
    for r in rows():
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want, key=repr)


def test_bpe_keeps_columns_and_replaces_bad_bytes(spark, library):
    docs = spark.createDataFrame([(1, "some text", "x", 2), (2, None, "y", 3)], "a long, text string, `0` string, ids long")
    back = byte_bpe.decode(byte_bpe.encode(docs, path()), path())
    assert sorted(map(tuple, back.select("a", "0", "n_tokens", "text").collect())) == [(1, "x", 2, "some text"), (2, "y", 0, "")]
    ids = library.encode("é", add_special_tokens=False).ids + [11, 99_999]
    odd = library.encode("\U0001f389", add_special_tokens=False).ids[:1]
    coded = spark.createDataFrame([(1, bytearray(np.array(ids + odd, "<u4").tobytes())), (2, None)], "a long, ids binary")
    assert {r["a"]: r["text"] for r in byte_bpe.decode(coded, path()).collect()} == {1: library.decode(ids + odd, skip_special_tokens=False), 2: ""}
    with pytest.raises(ValueError):
        byte_bpe.ByteBPE(path().replace("byte_bpe_50k", "word_bpe_49k"))


def slow_trie(data):
    """Nodes by definition, from (conv_id, turn, role, text) rows."""
    own = defaultdict(list)
    for c, t, r, x in data:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append(((t is not None, t or 0), sha(f"{len(r.encode())} {r}{x}"), (r, x)))
    own = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + v[h:])
    members = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    out = set()
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        childless = [q for q in below if not any(len(x) == len(q) + 1 and x[:-1] == q for x in below)]
        saved = sum((len(members[q]) - 1) * (len(WORD.findall(q[-1][1])) if q else 0) for q in below)
        last = sorted(c for c in m if len(built[c]) == len(p))
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), sum(len(q) == len(p) + 1 for q in below), len(childless), saved, sha(",".join(map(str, last)))))
    return out


def talks(seed):
    rng, out = random.Random(seed), []
    for c in range(70):
        c += 7 * (c > 20)
        n = rng.choice([0, 1, 2, 3, 5, 9, 17 if c % 9 == 0 else 4])
        same = rng.random() < 0.5
        for t in range(n):
            out.append((c, t, "user" if t % 2 == 0 else "assistant", "same words here" if same or rng.random() < 0.3 else rng.choice(["a b", "", "c d  e", f"own {rng.randrange(3)}"])))
    # nulls, ties, repeated rows, a conversation without id
    out += [(40, None, None, "null turn"), (40, None, "user", None), (41, 1, "user", "tie"), (41, 1, "user", "tie"), (41, 1, "user", "other"), (None, 0, "user", "nobody"), (500, 5, None, None), (520, 0, "x", "y")]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_trie(spark, seed):
    data = talks(seed)
    docs = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumns({"key": F.lit(1), "_part": F.lit(2)}).repartition(2 * seed)
    got = [tuple(r) for r in conversation_trie.shared_trie(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == slow_trie(data)


def test_trie_of_nothing_and_of_one(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert conversation_trie.shared_trie(spark.createDataFrame([], schema)).collect() == []
    assert conversation_trie.shared_trie(spark.createDataFrame([(None, 1, "a", "b")], schema)).collect() == []
    for c in (2, 4):  # turnless once rebuilt, and not
        data = [(c, 0, "user", "x y")]
        assert {tuple(r) for r in conversation_trie.shared_trie(spark.createDataFrame(data, schema)).collect()} == slow_trie(data)


def test_trie_with_one_conversation_of_most_turns(spark):
    data = [(60, t, "user", f"turn {t}") for t in range(300)] + [(61 + c, t, "user", f"turn {t if t < 30 + c else -c}") for c in range(5) for t in range(40)]
    docs = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(7)
    assert {tuple(r) for r in conversation_trie.shared_trie(docs).collect()} == slow_trie(data)


def test_ids_of_many_members_in_small_buckets(spark):
    data = [(c, d, 3 if d else -5) for c in range(-5, 300) for d in (0, 1)]
    paths = spark.createDataFrame(data, "conv_id long, depth long, name long").repartition(5)
    assert [tuple(r) for r in conversation_trie.ends(paths, 3).collect()] == [(3, 1, sha(",".join(map(str, range(-5, 300)))))]


def slow_runs(words):
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i >= p:
                found.setdefault((i, j + p), p)
            i = max(i + 1, j)
    return sorted((s, p, e) for (s, e), p in found.items())


def word_sequence(rng):
    kind, n = rng.randrange(6), rng.randrange(300)
    if kind < 2:
        return [rng.randrange(2 + 3 * kind) for _ in range(n)]
    if kind == 2:
        root = [rng.randrange(3) for _ in range(rng.randrange(1, 60))]
        out = (root * n)[:n]
        for _ in range(rng.randrange(4)):
            if out:
                out[rng.randrange(n)] = rng.randrange(3)
        return out
    if kind == 3:
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    out = [rng.randrange(2)]
    while len(out) < n:
        if kind == 4:
            out = out * rng.randrange(1, 8) + [rng.randrange(3)] * rng.randrange(3)
        else:
            root = [rng.randrange(2) for _ in range(rng.randrange(1, 4))]
            out += (root * 100)[: rng.randrange(1, 120)]
            if rng.random() < 0.4:
                out = out[-rng.randrange(1, len(out) + 1) :] * 2
    return out[:n]


def test_all_runs_of_all_periods():
    rng = random.Random(11)
    for _ in range(60):
        texts = [word_sequence(rng) for _ in range(12)]
        found = periodic_runs.find_runs(np.array([x for t in texts for x in t], np.int64), np.cumsum([0, *map(len, texts)]))
        for d, t in enumerate(texts):
            assert sorted((s, p, e) for x, s, e, p in found.tolist() if x == d) == slow_runs(t)


def test_colliding_hashes_are_found_out(monkeypatch):
    """Hashes of a few bits collide at every scale, and the words decide."""
    real, seeds = periodic_runs.Texts.common, []

    def careless(self, text, i, j, back=False):
        seeds.append(int(self.seed))
        out = real(self, text, i, j, back)
        return out + (self.seed == 1) * (~np.bool_(back)) * (out + j < self.size[text])

    monkeypatch.setattr(periodic_runs.Texts, "common", careless)
    rng = random.Random(4)
    words = [rng.randrange(40) for _ in range(50)] * 3 + [rng.randrange(40) for _ in range(50)]
    found = periodic_runs.find_runs(np.array(words), np.array([0, len(words)]))
    assert sorted((s, p, e) for _, s, e, p in found.tolist()) == slow_runs(words) and len(set(seeds)) > 1


def slow_digest(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = [(s, e - s, p) for s, p, e in slow_runs(w) if e - s >= 12]
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    tail = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *tail, sha("".join(f"{s},{m},{p}\n" for s, m, p in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_run_digests(spark):
    rng = random.Random(5)
    data = [(r[0], r[1]) for r in rows()]
    data += [(i, "\n".join(["ab", "é", "C", "<x>", "ü"][x % 5] for x in word_sequence(rng))) for i in range(1000, 1120)]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumns({"runs": F.lit(1), "_from": F.lit(2)}).repartition(3)
    got = sorted((tuple(r) for r in periodic_runs.digests(docs).collect()), key=repr)
    assert got == sorted((slow_digest(*r) for r in data), key=repr)


def test_runs_of_very_long_texts(spark):
    docs = spark.createDataFrame([(1, "alpha beta, gamma 12 " * 250_000), (2, "x " * 700_000), (3, "short one")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in periodic_runs.periodic_runs(docs).collect()}
    assert [tuple(x) for x in got[1]["runs"]] == [(0, 1_000_000, 4)] and got[1]["collapsed"] == "alpha beta, gamma 12"
    assert [tuple(x) for x in got[2]["runs"]] == [(0, 700_000, 1)] and got[2]["collapsed"] == "x" and got[3]["collapsed"] == "short one"
