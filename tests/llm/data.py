"""Small tables with the awkward cases every operator has to settle."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, cell string, key string, row long, word long, size long, score double"


def sentence(rng: random.Random, n: int, lang: str = "en") -> str:
    parts = {"en": ["the", "and", "thing", "wheat", "other", "shore", "with"], "de": ["der", "und", "schön", "zeit", "heit", "über", "nicht"]}[lang]
    return " ".join(rng.choice(parts) + rng.choice(["", "s", "er", "ing", "t"]) + str(rng.randrange(40) or "") * (rng.random() < 0.3) for _ in range(n))


def rows() -> list[tuple]:
    rng = random.Random(4)
    out: list[tuple] = []

    def add(i, text, lang="en", source="a"):
        out.append((i, text, lang, source, None if text is None else len(text), 1, "x", "y", 2, 3, 4, 0.5))

    for i in range(60):
        lang = "de" if i % 4 == 0 else "en"
        add(i, sentence(rng, rng.randrange(20, 120), lang), lang, f"s{i % 3}")
    base = sentence(rng, 80)
    words = base.split()
    for i in range(60, 70):
        copy = list(words)
        copy[(i * 7) % 80] = "changed"
        add(i, " ".join(copy), "en", None)
    add(70, base)
    add(71, base)
    add(72, base.upper())
    add(80, None)
    add(81, "")
    add(82, " \n\t ")
    add(83, "one")
    add(84, "two words", None)
    add(85, "héllo 𝒳𝒴 " * 30, None, None)
    add(86, "long " + sentence(rng, 6000), "en", "s1")
    add(None, "no id here " + sentence(rng, 30), "de", "s2")
    add(None, None, None, None)
    line = sentence(rng, 9) + "\n"
    add(90, line * 12)
    for _ in range(3):
        add(91, "repeated row " + base, "en", "s0")
    add(92, "### $$$ " * 40 + sentence(rng, 30))
    return out


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)
