"""Prefix trie of conversations by van Emde Boas recursion.

Sequences are cut at half depth. Their cut prefixes get names, so the upper halves and the lower halves
(whose roots are those names) are independent tries of half the depth; all of them are cut again, side by side
in one Spark job per level. A depth of 400 takes nine such levels instead of 400 rounds, and each (sequence,
depth) is named once. The name of a prefix is its smallest member, the key of its trie node.

Totals go the other way: starting with pieces one turn deep, the totals of lower tries are grafted on the
upper ones, doubling the span each time: a node at a cut adds its total to its ancestors of the
upper piece, which are the names on its smallest member's path.

Prefixes are told apart by SHA-256: a turn by its role and text, a block of turns by its halves' digests.
Texts are digested where they are read and not shuffled. No sequence is gathered: turns are numbered across
range partitions, so one conversation may hold a third of all rows, and names that a third of the sequences
share are joined by ``storage.lookup``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assaymill.storage import lookup, materialize

#: Members of one node whose ids are joined in one row: those that share all but so many low bits of their id.
BUCKET_BITS = 16
WORD = r"[^\x20\x09-\x0D]+"


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Add ``nth``, each row's number (from 1) in its group, whatever part of the rows a group holds.

    Rows are sorted into range partitions by group and ``order`` (which should leave only equal rows tied). A group that lies in several
    partitions adds what its earlier partitions hold; such groups are fewer than the partitions, and so is the table of their offsets.
    """
    part = rows.repartitionByRange(*[F.asc_nulls_first(c) for c in (group, *order)]).withColumn("_part", F.spark_partition_id())
    inside = Window.partitionBy("_part", group).orderBy(*[F.asc_nulls_first(c) for c in order])
    found = materialize(part.withColumn("nth", F.row_number().over(inside).cast("long")), "numbered")
    held = found.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    earlier = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = held.withColumn("_before", earlier).where("_before > 0").select(group, "_part", "_before")
    return found.join(F.broadcast(offsets), [group, "_part"], "left").withColumn("nth", F.col("nth") + F.coalesce("_before", F.lit(0))).drop("_part", "_before")


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, nth, key, words`` of every turn: its number by turn (null first; ties by ``key``), the digest of role and text, and the words of the text.

    Null role or text is empty. Rows without ``conv_id`` belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(" "), role, text).cast("binary"), 256))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", key.alias("key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    return numbered(rows.where("conv_id IS NOT NULL"), "conv_id", ["turn", "key"]).drop("turn")


def shared_starts(own: DataFrame, base: Column, length: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """(``conv_id`` of all, turns ``conv_id, depth, key, words``) of conversations whose first ``length`` turns (at most ``most``) come from conversation ``base``.

    Both are expressions of ``conv_id``. A base with fewer turns gives all it has, an absent one none; the conversation's own turns after its first ``length`` follow.
    """
    ids = own.where("nth = 1").select("conv_id", base.alias("_base"), length.alias("_length"))
    first = own.where(F.col("nth") <= most).select(F.col("conv_id").alias("_base"), "nth", "key", "words")
    taken = ids.join(first, "_base").where("nth <= _length").select("conv_id", F.col("nth").alias("depth"), "key", "words")
    rest = own.withColumn("_length", length).where("nth > _length")
    size = first.groupBy("_base").agg(F.max("nth").alias("_size"))
    size = ids.join(size, "_base", "left").select("conv_id", F.least("_length", F.coalesce("_size", F.lit(0))).alias("_taken"))
    size = size.join(rest.groupBy("conv_id").agg(F.count("*").alias("_rows")), "conv_id")
    rest = lookup(rest, materialize(size, "taken"), ["conv_id"], "_rows", inner=True)
    own_turns = rest.select("conv_id", (F.col("nth") - F.col("_length") + F.col("_taken")).alias("depth"), "key", "words")
    return ids.select("conv_id"), materialize(taken.unionByName(own_turns), "rebuilt")


def names(ids: DataFrame, sequences: DataFrame) -> tuple[DataFrame, int]:
    """``conv_id, depth, name`` of each prefix of each sequence, the empty one too, and a power of two above all depths; ``name`` is the smallest id with that prefix."""
    root, deepest = ids.agg(F.min("conv_id")).first()[0], sequences.agg(F.max("depth")).first()[0] or 0
    span = 1 << deepest.bit_length()
    # Names of blocks, from single turns to half the depth: those of their halves, digested.
    blocks, width = {1: sequences.select("conv_id", (F.col("depth") - 1).alias("at"), "key")}, 2
    while width < span:
        half = [F.max(F.when(F.col("at") % width == at, F.col("key"))).alias(f"_{i}") for i, at in enumerate((0, width // 2))]
        pairs = blocks[width // 2].groupBy("conv_id", (F.col("at") - F.col("at") % width).alias("at")).agg(*half).where("_0 IS NOT NULL AND _1 IS NOT NULL")
        blocks[width] = materialize(pairs.select("conv_id", "at", F.unhex(F.sha2(F.concat("_0", "_1"), 256)).alias("key")), "blocks")
        width *= 2
    known, width = ids.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(root).cast("long").alias("name")), span // 2
    while width:
        above = known.withColumnRenamed("depth", "at").withColumnRenamed("name", "above")
        cut = above.join(blocks[width].where(F.col("at") % (2 * width) == 0), ["conv_id", "at"])
        table = materialize(cut.groupBy("at", "above", "key").agg(F.min("conv_id").alias("name"), F.count("*").alias("_rows")), "names")
        found = lookup(cut, table, ["at", "above", "key"], "_rows", inner=True)
        # Each level about doubles the rows, so writing all of them anew costs as much again as the last level.
        known = materialize(known.unionByName(found.select("conv_id", (F.col("at") + width).alias("depth"), "name")), "names")
        width //= 2
    return known, span


def grafted(totals: DataFrame, paths: DataFrame, span: int, sums: list[str]) -> DataFrame:
    """Subtree sums: ``totals`` (``conv_id, depth`` of nodes, and ``sums`` of each alone) summed over all nodes below, the node included."""
    width = 1
    while width < span:
        cut = totals.where(F.col("depth") % (2 * width) == width).withColumn("_block", ((F.col("depth") - width) / width).cast("long")).drop("depth")
        upper = paths.withColumn("_block", ((F.col("depth") - F.col("depth") % width) / width).cast("long"))
        lifted = upper.join(cut, ["conv_id", "_block"]).groupBy(F.col("name").alias("conv_id"), "depth").agg(*[F.sum(c).alias(c) for c in sums])
        totals = materialize(totals.unionByName(lifted).groupBy("conv_id", "depth").agg(*[F.sum(c).alias(c) for c in sums]), "grafted")
        width *= 2
    return totals


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest the joined ids of each node, whose rows come one after the other."""
    node, digest = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.int64()), pa.array([digest.hexdigest()])], names=["conv_id", "depth", "ends_sha256"])

    for batch in batches:
        for name, depth, joined in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (name, depth) != node:
                if node:
                    yield row()
                node, digest = (name, depth), hashlib.sha256(joined.encode())
            else:
                digest.update(b"," + joined.encode())
    if node:
        yield row()


def ends(paths: DataFrame, bucket_bits: int = BUCKET_BITS) -> DataFrame:
    """``conv_id, depth, ends_sha256``: of each node at which sequences end, the SHA-256 of their ids, ascending and joined by commas.

    Ids are joined in buckets of ``2 ** bucket_bits`` ids first; a node's buckets then stream through one digest in order, which holds no more than one.
    """
    last = paths.groupBy(F.col("conv_id").alias("_member")).agg(F.max_by("name", "depth").alias("name"), F.max("depth").alias("depth"))
    # A hash of the whole bucket key deals a node that a third of the sequences reach to many tasks.
    joined = last.groupBy("name", "depth", F.shiftright("_member", bucket_bits).alias("_bucket")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_member")), lambda c: c.cast("string")), ",").alias("_joined"))
    in_order = joined.repartition("name", "depth").sortWithinPartitions("name", "depth", "_bucket").select("name", "depth", "_joined")
    return in_order.mapInArrow(_digested, "conv_id long, depth long, ends_sha256 string")


def trie(ids: DataFrame, sequences: DataFrame) -> DataFrame:
    """All nodes of the trie of ``sequences`` (``conv_id, depth`` from 1 without gaps, ``key``, ``words``); ``ids`` has the ``conv_id`` of all, of empty ones too.

    One row per node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (root: null), ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``. No sequence: no node. A word count
    is that of the smallest member's turn.
    """
    paths, span = names(ids, sequences)
    with_words = paths.join(sequences.select("conv_id", "depth", "words"), ["conv_id", "depth"], "left")
    nodes = with_words.groupBy(F.col("name").alias("conv_id"), "depth").agg(F.count("*").alias("n_convs"), F.max(F.when(F.col("conv_id") == F.col("name"), F.col("words"))).alias("_words"))
    above = paths.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent_conv_id"))
    nodes = materialize(nodes.join(above, ["conv_id", "depth"], "left"), "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    own = nodes.select("conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.coalesce("_words", F.lit(0))).alias("saved_tokens"))
    out = nodes.join(grafted(own, paths, span, ["n_leaves", "saved_tokens"]), ["conv_id", "depth"]).join(ends(paths), ["conv_id", "depth"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def shared_trie(conversations: DataFrame) -> DataFrame:
    """``trie`` of ``conversations`` (``conv_id, turn, role, text``), each started with up to three turns of the first of its twenty.

    Null role or text is empty, null turns come first, ties go by the digest of role and text (so repeated rows
    are repeated turns), rows without ``conv_id`` are left out, further columns are not read. An empty table has no node, not even a root.
    """
    own = turns(conversations.select("conv_id", "turn", "role", "text"))
    length = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    ids, sequences = shared_starts(own, F.col("conv_id") - F.col("conv_id") % 20, length, 3)
    return trie(ids, sequences)
