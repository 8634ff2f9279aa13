"""Word hashes and token pieces against plain Python."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from assaymill.llm import _words, packing
from assaymill.llm.queries import tokenizer

WORD = re.compile("[^\x20\x09-\x0d]+")


def folded(n: int, flip: bool = False) -> str:
    """Thue-Morse letters: where hashes that are polynomials modulo a power of two collide whatever their base."""
    return "".join("ab"[(i.bit_count() + flip) % 2] for i in range(n))


def cut(texts):
    for _, _, data, offsets in _words.blocks(pa.array(texts)):
        yield _words.words(data, offsets)


@pytest.mark.parametrize("n", [64, 128, 256, 257, 512, 1024])
def test_hashes_tell_structured_words_apart(n):
    (w,) = cut([f"{folded(n)} {folded(n, True)} {folded(n)} x{folded(n)}"])
    a, b, c, d = w.hashes().tolist()
    assert a == c and len({a, b, d}) == 3


def test_hashes_follow_bytes_alone():
    rng = np.random.default_rng(3)
    pool = ["".join(rng.choice(list("abé🙂\0z"), int(n))) for n in rng.integers(1, 40, 400)] + ["q" * n for n in (8, 9, 16, 255, 256, 257, 600)]
    texts = [" ".join(rng.choice(pool, 50)) for _ in range(60)] + ["", None]
    seen = {}
    for w in cut(texts):
        for i, h in enumerate(w.hashes().tolist()):
            assert seen.setdefault(h, w.text(i)) == w.text(i)
    assert sorted(seen.values()) == sorted({x for t in texts if t for x in WORD.findall(t)})


TEXTS = ["Plain words, 12 of them -- a_b x1y2 ... #tag", "don't it's we'll 'tis rock'n'roll", "Schön über naïve ǅ İstanbul é 日本語 «quoted» ½ x y", "a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|>", "\x1c\x1d\x7f odd\x00bytes", "", None, "1 11 111 a1 1a", f"{folded(512)} {folded(512, True)}", "🙂🙂x 🙂"]


def ids(encoder, texts):
    out = []
    for _, _, data, offsets in _words.blocks(pa.array(texts)):
        flat, bounds = encoder.ids(data, offsets)
        out += [flat[p:q].tolist() for p, q in zip(bounds[:-1], bounds[1:])]
    return out


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_have_the_tokenizers_ids(name, monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(packing, "CACHED", 40)  # tables turn over many times
    encoder = packing.Encoder(public_tokenizers.path(name))
    assert encoder.by_piece == (name == "word_bpe_49k.json")
    rng = np.random.default_rng(5)
    texts = TEXTS + [" ".join(rng.choice([*"ab,.'1é", "word", "Wörd", "it's", "x-y"], 12)) for _ in range(200)]
    want = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert ids(encoder, texts) == want and [x for t in texts for x in ids(encoder, [t])] == want


def test_pieces_survive_colliding_hashes(monkeypatch):
    monkeypatch.setattr(_words.Words, "hashes", lambda w: np.array([zlib.crc32(w.text(i).encode()) % 7 for i in range(len(w))], np.uint64))
    encoder = packing.Encoder(tokenizer())
    want = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in TEXTS]
    assert ids(encoder, TEXTS) == want and ids(encoder, TEXTS[::-1]) == want[::-1]
