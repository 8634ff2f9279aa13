"""Mixing sources to target weights by the cube method.

Each source gets a target number of words; its rate (target over size) says how often each of its
documents is taken. The whole part of the rate is taken outright, the fraction is an inclusion
probability. The cube method turns those into 0 or 1: three documents at a time are moved along the
null space of two constraints, the number of documents and the number of words, until one of them
lands on 0 or 1, so both totals of a source stay what the probabilities promised.

Documents are dealt to blocks of bounded size, which fly on their own; the two at most that a block
leaves between 0 and 1 fly on together at the next level, until one block per source is left. There
the landing decides them, coming as close to the promised words as it can. Repeated rows (equal id, source and size) are
one unit with a multiplicity, so no key gathers more rows than a block should hold.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assaymill.storage import materialize

SPACES = " \t\n\x0b\x0c\r"
BLOCK = 2000
NEAR = 1e-9
#: So many documents of a source, at most, are decided by trying all their choices.
LANDING = 14
_UNIT = "key string, src int, size long, rows long, p double"


def words(text: Column) -> Column:
    """Number of words of a text; null: 0."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def targets(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """``share`` of all words by weight; what exceeds ``most`` times a source is reshared among the others."""
    out = [0.0] * len(sizes)
    open_ = list(range(len(sizes)))
    left = share * sum(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        want = {i: left * weights[i] / total for i in open_}
        over = [i for i in open_ if want[i] > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = want[i]
            break
        for i in over:
            out[i] = most * sizes[i]
            left -= out[i]
        open_ = [i for i in open_ if i not in set(over)]
    return out


def fly(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, least: int = 2) -> np.ndarray:
    """Flight phase: probabilities after moves that keep their sum and the sum of ``size`` times them, until ``least`` or fewer are fractional."""
    p = p.copy()
    waiting = [i for i in rng.permutation(len(p)).tolist() if NEAR < p[i] < 1 - NEAR]
    p[(p <= NEAR)] = 0
    p[(p >= 1 - NEAR)] = 1
    at: list[int] = []
    while len(at) + len(waiting) > least:
        while len(at) < 3 and waiting:
            at.append(waiting.pop())
        if len(at) == 3:
            a, b, c = (float(size[i]) for i in at)
            u = [c - b, a - c, b - a] if not a == b == c else [1.0, -1.0, 0.0]
        elif len(at) == 2 and size[at[0]] == size[at[1]]:
            u = [1.0, -1.0]
        else:
            return p
        up = min(((1 - p[i]) / x if x > 0 else p[i] / -x) for i, x in zip(at, u, strict=True) if x)
        down = min((p[i] / x if x > 0 else (1 - p[i]) / -x) for i, x in zip(at, u, strict=True) if x)
        step = up if rng.random() * (up + down) < down else -down
        stay = []
        for i, x in zip(at, u, strict=True):
            p[i] += step * x
            if p[i] <= NEAR:
                p[i] = 0
            elif p[i] >= 1 - NEAR:
                p[i] = 1
            else:
                stay.append(i)
        at = stay
    return p


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The 0/1 choice for the fractional rest (LANDING at most) that brings its words, then its count, closest to what its probabilities promise."""
    rest = np.flatnonzero((p > 0) & (p < 1))
    if not len(rest):
        return p
    choices = ((np.arange(2 ** len(rest))[:, None] >> np.arange(len(rest))) & 1).astype(float)
    words_off, rows_off = np.abs(choices @ size[rest] - p[rest] @ size[rest]), np.abs(choices.sum(1) - p[rest].sum())
    out = p.copy()
    out[rest] = choices[np.lexsort((rows_off, np.round(words_off, 6)))[0]]
    return out


def _flight(level: int, last: bool, seed: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, units: pd.DataFrame) -> pd.DataFrame:
        units = units.sort_values(["key", "size"], na_position="last", ignore_index=True)
        rng = np.random.default_rng([seed, level, int(key[0]), int(key[1])])
        size = units["size"].to_numpy(np.float64)
        p = fly(units["p"].to_numpy(np.float64), size, rng, LANDING if last else 2)
        units["p"] = land(p, size) if last else p
        return units[["key", "src", "size", "rows", "p"]]

    return run


def mixture(docs: DataFrame, weights: Callable[[list[str | None]], list[float]], share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 8) -> DataFrame:
    """How often the mix takes each row: ``doc_id, source, size, source_size, target, copies, taken``.

    ``weights`` gives the weights of the sources, listed by code point with null last; there is one row
    per source on the driver. The mix shares ``share`` times all words by weight; a target is at most
    ``most`` times its source, and no row is taken more often than its source's rate rounded up. Reruns
    agree. Null text has no word. Rows without an id count as rows with one common id. An empty table
    gives an empty mix.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col).cast("string")).alias("size"))
    units = materialize(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows")), "units")
    per = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("units"), F.max("size").alias("longest"))
    sources = sorted(per.collect(), key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be", "surrogatepass")))
    sizes = [r["source_size"] for r in sources]
    goals = targets(sizes, weights([r["source"] for r in sources]), share, most) if sources else []
    rates = [g / s if s else 0.0 for g, s in zip(goals, sizes, strict=True)]
    whole = [int(r + NEAR) for r in rates]
    spark = docs.sparkSession
    table = [(r["source"], i, sizes[i], goals[i], whole[i], max(0.0, rates[i] - whole[i]), -(-r["units"] // BLOCK)) for i, r in enumerate(sources)]
    facts = spark.createDataFrame(table, "source string, src int, source_size long, target double, whole int, p double, blocks int")
    known = units.withColumnRenamed("source", "_source").join(facts, F.col("_source").eqNullSafe(F.col("source"))).drop("_source")
    # A unit of several rows is taken so many times for sure; its fraction flies.
    sure = F.floor(F.col("rows") * F.col("p") + NEAR)
    known = known.withColumns({"sure": sure, "key": F.col("doc_id").cast("string"), "block": F.pmod(F.xxhash64("doc_id", "size"), F.col("blocks"))})
    known = materialize(known, "known")
    flying = known.select("key", "src", "size", "rows", F.greatest(F.col("rows") * F.col("p") - F.col("sure"), F.lit(0.0)).alias("p"), "block", "blocks")
    done = None
    level = 0
    blocks = max([t[6] for t in table], default=0)
    while blocks:
        last = blocks == 1
        flown = materialize(flying.groupBy("src", "block").applyInPandas(_flight(level, last, seed), _UNIT), "flown")
        landed = flown if last else flown.where("p = 0 or p = 1")
        done = landed if done is None else done.union(landed)
        if last:
            break
        blocks = -(-2 * blocks // BLOCK)
        level += 1
        flying = flown.where("p > 0 and p < 1").withColumn("block", F.pmod(F.xxhash64("key", "size", F.lit(level)), F.lit(blocks)))
    if done is None:
        done = spark.createDataFrame([], _UNIT)
    landed = done.select("key", "src", "size", F.col("p").cast("int").alias("hit"))
    out = known.join(landed.withColumnRenamed("key", "_key").withColumnRenamed("src", "_src").withColumnRenamed("size", "_size"), F.col("key").eqNullSafe(F.col("_key")) & (F.col("src") == F.col("_src")) & (F.col("size") == F.col("_size")))
    out = out.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    copies = F.col("whole") + (F.col("nth") <= F.col("sure") + F.col("hit")).cast("int")
    out = out.withColumn("copies", copies.cast("long"))
    return out.select("doc_id", "source", "size", "nth", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: Callable[[list[str | None]], list[float]], share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 8) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it; rows it does not take are left out."""
    plan = mixture(docs, weights, share, most, id_col, text_col, source_col, seed)
    name = lambda i, s, n: F.concat_ws("|", F.coalesce(i.cast("string"), F.lit("")), n.cast("string"), F.coalesce(F.concat(F.lit("="), s), F.lit("")))
    plan = plan.where("copies > 0").select(name(F.col("doc_id"), F.col("source"), F.col("size")).alias("__mix_unit"), F.col("nth").alias("__mix_nth"), F.col("copies").alias("__mix_copies"))
    keyed = docs.withColumn("__mix_unit", name(F.col(id_col).cast("long"), F.col(source_col).cast("string"), words(F.col(text_col).cast("string"))))
    keyed = keyed.withColumn("__mix_nth", F.row_number().over(Window.partitionBy("__mix_unit").orderBy(text_col)).cast("long"))
    out = keyed.join(plan, ["__mix_unit", "__mix_nth"])
    return out.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__mix_copies")))).select(*docs.columns)
