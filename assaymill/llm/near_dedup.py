"""Near-duplicate detection: banded MinHash, sequential Bayesian pruning, exact confirmation.

1. One pass over the texts gives each document a MinHash signature and a 128-bit key of its set of
   word shingles. Documents with one key are copies and are collapsed to a node.
2. Bands of the signatures deal nodes into buckets. A bucket compares its members with one centre,
   later with CENTRES of them, and only across components that are not joined yet: a group of copies is
   settled that way. Members of buckets that stay open after the first centre are
   dealt anew by the rare shingles of their sets (prefix filtering, which is exact), and shingles that
   occur in one set only bound what a pair can share. In the end all pairs that could be links and are
   not joined yet are compared; no pair that shares a bucket is lost.
3. A pair's signatures are compared batch by batch. It is dropped as soon as the posterior
   probability of the asked similarity (uniform prior) is under ``miss``.
4. Survivors are confirmed on their full shingle sets; confirmed links make components.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assaymill.llm._words import blocks, mix, shingle_sets, tidy, words
from assaymill.storage import lookup, materialize

#: Hashes of a signature, and how many of them are compared at a time.
K, BATCH = 144, 16
#: Members of an open bucket that all others are compared with before the rest.
CENTRES = 8
#: Members of one block of a bucket: larger buckets compare block with block, each pair of blocks apart.
BLOCK = 512
_rng = np.random.default_rng(7)
_MULT = (_rng.integers(0, 2**31, K, dtype=np.uint32) * np.uint32(2)) + np.uint32(1)
_SIGNATURES = "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>"
#: Ids of documents in shared buckets are broadcast up to this number, after a count.
BROADCAST_IDS = 2_000_000


def band_rows(similarity: float, miss: float = 2e-5) -> int:
    """The most hashes a band may have so that a pair of this similarity shares none of the K // rows bands with probability ``miss`` at most."""
    return max([1, *(r for r in range(1, K + 1) if (1 - similarity**r) ** (K // r) <= miss)])


def minhash(sets: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which sets are not empty, and their signatures."""
    some = np.flatnonzero(np.diff(bounds))
    sig = np.zeros((len(some), K), np.uint32)
    if len(some):
        low, high, starts = sets.astype(np.uint32), (sets >> np.uint64(32)).astype(np.uint32), bounds[:-1][some]
        for k in range(K):
            sig[:, k] = np.minimum.reduceat(low * _MULT[k] + high, starts)
    return some, sig


def signatures(batches: Iterator[pa.RecordBatch], shingle_words: int, rows: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to the size and key of the set of shingles and the hashes of its signature's bands; no key for an empty set."""
    count = K // rows
    for batch in batches:
        ids = batch.column(0)
        for a, b, data, offsets in blocks(batch.column(1)):
            sets, bounds = shingle_sets(words(data, offsets), shingle_words)
            some, sig = minhash(sets, bounds)
            keys = np.zeros((b - a, 2), np.uint64)
            bands = np.zeros((len(some), count), np.uint64)
            for i, d in enumerate(some):
                digest = xxhash.xxh3_128_intdigest(sets[bounds[d] : bounds[d + 1]])
                keys[d] = digest >> 64, digest & (2**64 - 1)
            for j in range(count):
                h = np.full(len(some), j, np.uint64)
                for column in sig[:, j * rows : (j + 1) * rows].T:
                    h = mix(h * np.uint64(0x9E3779B97F4A7C15) + column)
                bands[:, j] = h
            empty = np.diff(bounds) == 0
            edges = np.zeros(b - a + 1, np.int32)
            np.cumsum(~empty * count, out=edges[1:])
            yield pa.RecordBatch.from_arrays(
                [ids.slice(a, b - a).cast(pa.int64()), pa.array(np.diff(bounds)), *(pa.array(keys[:, j].astype(np.int64), mask=empty) for j in (0, 1)), pa.ListArray.from_arrays(edges, bands.ravel().astype(np.int64))],
                names=["doc_id", "n_shingles", "k1", "k2", "bands"],
            )


def full_sets(batches: Iterator[pa.RecordBatch], shingle_words: int) -> Iterator[pa.RecordBatch]:
    """(text, node, k1, k2) to the node, the whole set of shingles and its signature; rows whose set has another key give none."""
    for batch in batches:
        node, k1, k2 = (batch.column(c).to_numpy() for c in (1, 2, 3))
        for a, _, data, offsets in blocks(batch.column(0)):
            sets, bounds = shingle_sets(words(data, offsets), shingle_words)
            some, sig = minhash(sets, bounds)
            keys = [xxhash.xxh3_128_intdigest(sets[bounds[d] : bounds[d + 1]]) for d in some]
            own = np.array([k >> 64 == int(k1[a + d]) % 2**64 and k % 2**64 == int(k2[a + d]) % 2**64 for k, d in zip(keys, some, strict=True)], bool)
            edges = np.append(bounds[some], bounds[-1]).astype(np.int32)
            shingles = pa.ListArray.from_arrays(edges, sets.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(node[a + some]), shingles, pa.array([x.tobytes() for x in sig], pa.binary())], names=["node", "shingles", "signature"]).filter(pa.array(own))


def least_matches(similarity: float, miss: float) -> list[int]:
    """For 16, 32, ... compared hashes: the fewest matches at which P(similarity or more | matches) is at least ``miss``.

    With a uniform prior and m of n matching the posterior is Beta(m+1, n-m+1), whose upper tail at s
    is the probability that Binomial(n+1, s) is at most m.
    """
    out = []
    for n in range(BATCH, K + 1, BATCH):
        below, m = 0.0, -1
        while below < miss:
            m += 1
            below += comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
        out.append(m)
    return out


def confirm(batches: Iterator[pa.RecordBatch], least: list[int], percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b, signatures, sets) to the pairs that no batch of hashes rules out and whose full sets overlap enough."""
    for batch in batches:
        n = batch.num_rows
        sig = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(n, K) for c in (2, 3)]
        alive, matches = np.arange(n), np.zeros(n, np.int64)
        for i, m in enumerate(least):
            part = slice(i * BATCH, (i + 1) * BATCH)
            matches = matches + (sig[0][alive, part] == sig[1][alive, part]).sum(1)
            stay = matches >= m
            alive, matches = alive[stay], matches[stay]
        linked = []
        for i in alive.tolist():
            x, y = (batch.column(c)[i].values.to_numpy() for c in (4, 5))
            shared = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * shared >= percent * (len(x) + len(y) - shared):
                linked.append(i)
        rows = pa.array(linked, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows)], names=["a", "b"])


def overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, signatures, sets) to the number of shingles that both sets have."""
    for batch in batches:
        shared = [len(np.intersect1d(x.values.to_numpy(), y.values.to_numpy(), assume_unique=True)) for x, y in zip(batch.column(4), batch.column(5), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared, pa.int64())], names=["a", "b", "shared"])


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links to (node, root): the smallest node reachable. Labels spread over links and then jump to their own label's label."""
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    first = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"), F.count("*").alias("links"))
    labels = materialize(first.select("node", F.least("low", "node").alias("root"), "links"), "labels")
    while True:
        # A node with a third of all links is looked up without gathering them.
        near = lookup(both, labels.withColumnRenamed("node", "b"), ["b"], "links").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("old"), "links")
        sizes = labels.groupBy("root").agg(F.count("*").alias("nodes"))
        jump = sizes.join(labels.select(F.col("node").alias("root"), F.col("root").alias("further")), "root")
        step = lookup(step, jump, ["root"], "nodes").select("node", F.least("root", F.coalesce("further", "root")).alias("root"), "old", "links")
        step = materialize(step, "labels")
        if step.where(F.col("root") != F.col("old")).isEmpty():
            return step.select("node", "root")
        labels = step.select("node", "root", "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """Components of documents whose sets of ``shingle_words``-word shingles overlap by ``percent`` of their union or more.

    Returns ``doc_id, n_shingles, component_id, kept`` for each row of ``docs``: ``component_id`` is the
    smallest id reachable over links and ``kept`` marks the row that has it. A text without words or
    null has the empty set and no link. Rows without an id have no link, no component and stay.
    Repeated rows share their id, so both are kept. Other columns of ``docs`` are not read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = band_rows(percent / 100)
    signed = materialize(texts.mapInArrow(lambda it: tidy(signatures(it, shingle_words, rows)), _SIGNATURES), "signatures")
    linked = signed.where(F.col("doc_id").isNotNull() & F.col("k1").isNotNull())
    groups = linked.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    groups = materialize(groups.withColumn("node", F.monotonically_increasing_id()), "groups")
    members = groups.select("node", F.explode("bands").alias("bucket"))
    groups = groups.drop("bands")
    shared = members.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("size")).where("low < high").select("bucket", "low", "size")
    members = materialize(lookup(members, materialize(shared, "shared"), ["bucket"], "size", inner=True), "buckets")
    needed = materialize(groups.join(members.select("node").distinct(), "node").select("doc_id", "node", "k1", "k2"), "needed")
    needed = F.broadcast(needed) if needed.count() <= BROADCAST_IDS else needed
    found = texts.join(needed, "doc_id").select("text", "node", "k1", "k2").mapInArrow(lambda it: tidy(full_sets(it, shingle_words)), "node long, shingles array<long>, signature binary")
    nodes = materialize(found.dropDuplicates(["node"]), "nodes")

    least = least_matches(percent / 100, miss)
    roots = _joined(None, _confirmed(members.where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")), nodes, least, percent))
    if roots is not None:
        members = _viable(members, roots, nodes, percent)
        roots = _joined(roots, _confirmed(_centre_pairs(_placed(members, roots), percent), nodes, least, percent))
        roots = _joined(roots, _confirmed(_other_pairs(_placed(members, roots), nodes, percent), nodes, least, percent))

    if roots is not None:
        lowest = groups.join(roots, "node").groupBy("root").agg(F.min("doc_id").alias("component_id"))
        found = groups.join(roots, "node", "left").join(lowest, "root", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    else:
        found = groups.withColumn("component_id", F.col("doc_id"))
    found = found.where("copies > 1 or component_id <> doc_id").select("k1", "k2", "component_id", "copies")
    out = lookup(signed.select("doc_id", "n_shingles", "k1", "k2"), found, ["k1", "k2"], "copies")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def _placed(members: DataFrame, roots: DataFrame, least: int = 2) -> DataFrame:
    """Members with their ``root``, in buckets of at least ``least`` members that still hold several components."""
    placed = materialize(members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")
    open_ = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size"))
    open_ = materialize(open_.where(F.expr("low < high") & (F.col("size") >= least)).select("bucket", "size"), "open-buckets")
    return lookup(placed, open_, ["bucket"], "size", inner=True)


def _heads(placed: DataFrame, n: int) -> DataFrame:
    """``placed`` with ``heads``: the ``n`` members of the row's bucket with the fewest shingles of their own."""
    order = Window.partitionBy("bucket").orderBy("alone", F.xxhash64("node"))
    first = placed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    heads = first.groupBy("bucket").agg(F.collect_list(F.struct(F.col("node").alias("head"), F.col("root").alias("head_root"), F.col("n").alias("head_n"), F.col("alone").alias("head_alone"))).alias("heads"))
    sized = placed.groupBy("bucket").agg(F.count("*").alias("size"))
    return lookup(placed, materialize(heads.join(sized, "bucket"), "heads"), ["bucket"], "size")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b"))


def _centre_pairs(placed: DataFrame, percent: int) -> DataFrame:
    """Members against the CENTRES of their bucket, where they are in other components and could be linked."""
    met = _heads(placed, CENTRES).select("node", "root", "n", "alone", F.inline("heads"))
    most = F.least(F.col("n") - F.col("alone"), F.col("head_n") - F.col("head_alone"))
    fewest = F.greatest(F.col("n") + F.col("head_alone"), F.col("head_n") + F.col("alone"))
    return _ordered(met.where((F.col("root") != F.col("head_root")) & (100 * most >= percent * fewest)))


def _other_pairs(placed: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """All pairs of a bucket in different components that could be linked.

    Each member's overlap with its bucket's first centre is measured. Two sets then share at most the
    smaller of those overlaps, and outside the centre at most what either has there and not alone; and if
    the bucket's shingle is the first they share, at most what follows it in either. A large bucket is
    dealt to blocks, and each pair of blocks is a key of its own.
    """
    placed = materialize(placed, "open")
    pivot = _heads(placed, 1).withColumn("head", F.col("heads")[0]["head"]).drop("heads")
    measured = materialize(_sided(_ordered(pivot.select("node", "head")), nodes).mapInArrow(lambda it: tidy(overlaps(it)), "a long, b long, shared long"), "overlaps")
    known = measured.select("a", "b", "shared").union(measured.where("a <> b").select("b", "a", "shared")).toDF("node", "head", "shared")
    near = materialize(pivot.join(known, ["node", "head"]).select("bucket", "node", "root", "n", "nth", "shared", F.greatest(F.col("n") - F.col("shared") - F.col("alone"), F.lit(0)).alias("outside")), "measured")
    blocks_of = near.groupBy("bucket").agg(F.count("*").alias("rows")).withColumn("blocks", F.ceil(F.col("rows") / BLOCK))
    near = lookup(near, blocks_of, ["bucket"], "rows").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    near = near.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pair = [F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")]
    near = near.select(*pair, "own", "bucket", "node", "root", "n", "nth", "shared", "outside")
    other = near.select("bucket", "low", "high", *[F.col(c).alias(f"other_{c}") for c in ("own", "node", "root", "n", "nth", "shared", "outside")])
    most = F.least(F.least("shared", "other_shared") + F.least("outside", "other_outside"), F.least(F.col("n") - F.col("nth"), F.col("other_n") - F.col("other_nth")) + 1)
    could = 100 * most >= percent * (F.col("n") + F.col("other_n") - most)
    once = F.when(F.col("low") < F.col("high"), F.col("root") != F.col("other_root")).otherwise(F.col("root") < F.col("other_root"))
    met = (F.col("own") == F.col("low")) & (F.col("other_own") == F.col("high"))
    return _ordered(near.join(other, ["bucket", "low", "high"]).where(met & once & could).withColumnRenamed("other_node", "head"))


def _viable(members: DataFrame, roots: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Members of open buckets in new buckets, one for each shingle of their prefix, with the set's size ``n`` and ``alone``.

    Shingles are ordered from the rarest among these members to the most frequent. Two sets that overlap
    enough share one of the first n - ceil(percent of n) + 1 of both (prefix filtering), so the new
    buckets lose no link, while rare shingles keep them small. ``alone`` counts the shingles that no other
    of these sets has: two sets share at most ``n - alone`` of either, and unite to at least ``n`` of one
    plus ``alone`` of the other. A member for which that rules out every link is left out.
    """
    placed = _placed(members, roots, 3)  # two were compared by the first centre
    sets = nodes.join(placed.select("node").distinct(), "node").select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("bucket"))
    sets = materialize(sets, "open-sets")
    often = sets.groupBy("bucket").agg(F.count("*").alias("often"))
    order = Window.partitionBy("node").orderBy("often", "bucket")
    ranked = sets.join(often, "bucket").withColumns({"nth": F.row_number().over(order), "alone": F.count_if(F.col("often") == 1).over(Window.partitionBy("node"))})
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    kept = ranked.where((F.col("nth") <= prefix) & (F.col("often") > 1) & (100 * (F.col("n") - F.col("alone")) >= percent * F.col("n")))
    return materialize(kept.select("bucket", "node", "n", "nth", F.col("alone").cast("long").alias("alone")), "viable")


def _sided(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct (a, b) pairs with both sides' signatures and sets."""
    sides = [nodes.select(F.col("node").alias(x), F.col("signature").alias(f"sig_{x}"), F.col("shingles").alias(f"set_{x}")) for x in "ab"]
    return pairs.distinct().join(sides[0], "a").join(sides[1], "b").select("a", "b", "sig_a", "sig_b", "set_a", "set_b")


def _confirmed(pairs: DataFrame, nodes: DataFrame, least: list[int], percent: int) -> DataFrame:
    """The (a, b) pairs of nodes that the posterior bound leaves and whose full sets overlap enough."""
    return materialize(_sided(pairs, nodes).mapInArrow(lambda it: tidy(confirm(it, least, percent)), "a long, b long"), "confirmed")


def _joined(roots: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """(node, root) after more links; None: no node is linked yet."""
    if links.isEmpty():
        return roots
    if roots is None:
        return components(links)
    a, b = (roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
    ends = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")).where("a <> b")
    if ends.isEmpty():
        return roots
    moved = components(ends)
    onward = roots.join(moved.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return materialize(onward.union(moved.join(roots, "node", "left_anti")), "roots")
