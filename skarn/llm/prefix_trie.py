"""A prefix trie of conversations, built from mergeable partial tries.

A node stands for a distinct sequence of first turns. Its key is the depth and 128 bits, the exclusive or of hashes of (place, role, text) over its turns, so the keys along a
conversation are a running fold; turns of long conversations are folded block by block, and a block begins with the fold of those before it. Partial tries,
one for each shard of conversations, are tables of locally combined nodes (members, smallest member, ends); merging tables of shards by key, level by level, gives the trie's.

Rollup: the smallest member of a node owns it. A conversation owns an end of its own path, so each node has one owner, and the owner's path runs through
all of the node's ancestors. What a subtree sums is therefore the sum, over the owners whose paths run through its top, of what they own from there on:
a running sum from the bottom of each path, and one more merge by key, without a round for each depth. End lists are packed runs of ascending ids by ranges of conversations,
which are disjoint, so their merge is a concatenation, and the digest reads it as a stream.

Defined cases: turns are in order of ``turn`` (null first), then of hashes of role and text; null role or text is empty; rows without a conv_id take
no part; repeated rows are turns of their own; other columns are not read; an empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, hash128, ship

KEY = ["depth", "k1", "k2"]
#: Turns of a conversation that one window folds; shards of partial tries, and how many of them a merge brings together.
BLOCK, SHARDS, FAN = 1 << 16, 64, 8


def ordered_turns(conversations: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``conv_id, part, place, h1, h2, length`` of all turns, place counting within a part of a conversation, and ``conv_id, part, before, total``.
    Rows are dealt by ranges of (conversation, turn), so a long conversation spreads over many parts."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    h1, h2 = hash128(role, text)
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", h1.alias("h1"), h2.alias("h2"), F.char_length(text).cast("long").alias("length"), F.monotonically_increasing_id().alias("row")
    )
    order = [F.asc_nulls_first("turn"), F.col("h1"), F.col("h2"), F.col("row")]
    dealt = rows.repartitionByRange(F.col("conv_id"), *order).withColumn("part", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order))
    turns = scratch.table(dealt.withColumn("place", place).select("conv_id", "part", F.col("place").cast("long").alias("place"), "h1", "h2", "length"), "turns")
    parts = turns.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    same = Window.partitionBy("conv_id")
    before = F.sum("n").over(same.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return turns, scratch.table(parts.select("conv_id", "part", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(same).alias("total")), "parts")


def shared_openings(turns: DataFrame, parts: DataFrame, scratch: Scratch, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """``conv_id, pos, h1, h2, length, n`` and ``conv_id, n``: each conversation with its first turns (crc32 of its id modulo ``most``) replaced by as many of the
    first conversation of its group of ids; n: its turns. An opening is shorter where that conversation is, and empty where it is missing."""
    opening = F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % most
    base = F.col("conv_id") - F.col("conv_id") % group
    convs = parts.groupBy("conv_id").agg(F.max("total").alias("total")).withColumn("h", opening).withColumn("base", base)
    firsts = convs.where("conv_id = base").select("base", F.col("total").alias("there"))
    taken = F.least("h", F.coalesce("there", F.lit(0)))
    members = scratch.table(convs.join(firsts, "base", "left").select("conv_id", "base", "h", taken.alias("m"), (taken + F.greatest(F.col("total") - F.col("h"), F.lit(0))).alias("n")), "members")
    placed = turns.join(parts.select("conv_id", "part", "before"), ["conv_id", "part"]).withColumn("pos", F.col("before") + F.col("place") - 1)
    heads = placed.where((F.col("conv_id") % group == 0) & (F.col("pos") < most - 1)).select(F.col("conv_id").alias("base"), "pos", "h1", "h2", "length")
    shared = members.where("m > 0").join(heads, "base").where("pos < m").select("conv_id", "pos", "h1", "h2", "length", "n")
    own = placed.join(members, "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "h1", "h2", "length", "n")
    return shared.unionByName(own), members.select("conv_id", "n")


def _running(rows: DataFrame, runs: dict[str, tuple[str, str]], fold, plus, backwards: bool, scratch: Scratch) -> DataFrame:
    """rows with running folds of columns along ``pos`` of each conversation: within its blocks first, then with what the blocks before (or behind) fold to.
    runs: for each new column the folded one and the name of its share of other blocks; n: a conversation's rows, at least."""
    to = F.desc if backwards else F.asc
    blocked = rows.withColumn("block", F.floor(F.col("pos") / BLOCK))
    run = Window.partitionBy("conv_id", "block").orderBy(to("pos")).rowsBetween(Window.unboundedPreceding, 0)
    local = scratch.table(blocked.withColumns({c: fold(F.col(value)).over(run) for c, (value, _) in runs.items()}), "local")
    one, more = local.where(F.col("n") < BLOCK), local.where(F.col("n") >= BLOCK)
    order = Window.partitionBy("conv_id").orderBy(to("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = more.groupBy("conv_id", "block").agg(*[fold(F.col(value)).alias(carry) for value, carry in runs.values()])
    carried = blocks.select("conv_id", "block", *[F.coalesce(fold(F.col(carry)).over(order), F.lit(0)).alias(carry) for _, carry in runs.values()])
    rest = more.join(carried, ["conv_id", "block"]).withColumns({c: plus(F.col(c), F.col(carry)) for c, (_, carry) in runs.items()})
    return one.unionByName(rest.select(*one.columns)).drop("block")


def _paths(turns: DataFrame, members: DataFrame, scratch: Scratch) -> DataFrame:
    """``conv_id, depth, k1, k2, p1, p2, length, n``: the nodes of each conversation, the root included, with their parents' keys."""
    x1, x2 = hash128(F.col("pos"), F.col("h1"), F.col("h2"))
    steps = turns.select("conv_id", "pos", "length", "n", x1.alias("x1"), x2.alias("x2"))
    folded = _running(steps, {"k1": ("x1", "c1"), "k2": ("x2", "c2")}, F.bit_xor, Column.bitwiseXOR, False, scratch)
    nodes = folded.select("conv_id", (F.col("pos") + 1).alias("depth"), "k1", "k2", F.col("k1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("p2"), "length", "n")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    roots = members.select("conv_id", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"), zero.alias("length"), "n")
    return scratch.table(nodes.unionByName(roots), "paths")


def _merged(paths: DataFrame) -> DataFrame:
    """Key, owner ``conv_id, n_convs, n_ends, length`` of each node: the partial tries of shards of conversations, merged level by level."""
    shard, one = F.pmod(F.xxhash64(F.lit("shard"), "conv_id"), F.lit(SHARDS)), F.lit(1).cast("long")
    table = paths.select(*KEY, shard.alias("shard"), "conv_id", one.alias("n_convs"), (F.col("depth") == F.col("n")).cast("long").alias("n_ends"), "length")
    merge = lambda keys: table.groupBy(*keys).agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_ends").alias("n_ends"), F.max("length").alias("length"))
    shards = SHARDS
    while shards > 1:
        table = merge([*KEY, "shard"]).withColumn("shard", F.floor(F.col("shard") / FAN))
        shards = -(-shards // FAN)
    return merge(KEY)


def _digests(paths: DataFrame) -> DataFrame:
    """Key and ``ends_sha256`` of nodes where conversations end."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # in ascending order of conv_id
            keys, ids = np.stack([c.to_numpy() for c in batch.columns[:3]], axis=1), batch.column(3).to_numpy()
            order = np.lexsort(keys.T)
            keys, ids = keys[order], ids[order]
            at = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]) if len(ids) else np.zeros(0, np.int64)
            ends = [*at[1:].tolist(), len(ids)]
            runs = [ids[a:b].astype("<i8").tobytes() for a, b in zip(at.tolist(), ends, strict=False)]
            yield pa.RecordBatch.from_arrays([*[pa.array(keys[at, j]) for j in range(3)], pa.array(ids[at]), pa.array(runs, pa.binary())], [*KEY, "first", "run"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []
        columns = lambda: pa.RecordBatch.from_arrays([*[pa.array([k[j] for k, _ in done], pa.int64()) for j in range(3)], pa.array([h for _, h in done], pa.string())], [*KEY, "ends_sha256"])
        for batch in batches:
            for *key, run in zip(*(c.to_pylist() for c in (*batch.columns[:3], batch.column(4))), strict=True):
                if key != now:
                    if state is not None:
                        done.append((now, state.hexdigest()))
                    now, state = key, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(",".join(map(str, np.frombuffer(run, "<i8").tolist())).encode())
            yield columns()
            done.clear()
        if state is not None:
            done.append((now, state.hexdigest()))
            yield columns()

    ends = paths.where("depth = n").select(*KEY, "conv_id").repartitionByRange("conv_id").sortWithinPartitions("conv_id")
    runs = ends.mapInArrow(pack, "depth long, k1 long, k2 long, first long, run binary")
    return runs.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digest, "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, members: DataFrame, scratch: Scratch) -> DataFrame:
    """One row a node: ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    turns: ``conv_id, pos`` (from 0, without gaps), ``h1, h2`` (hashes of role and text), ``length`` (what a member beyond the first saves), ``n``; members: ``conv_id, n``, each conversation
    once with its number of turns, those without turns too. saved_tokens: over the subtree, (members - 1) times the length; ends_sha256: of the ids that end at the node."""
    ship(turns.sparkSession)
    paths = _paths(turns, members, scratch)
    nodes = scratch.table(_merged(paths), "nodes")
    saved, leaf = (F.col("n_convs") - 1) * F.col("length"), (F.col("n_ends") == F.col("n_convs")).cast("long")
    owned = nodes.select("conv_id", "depth", "n_convs", saved.alias("saved"), leaf.alias("leaf"))
    rows = paths.join(owned, ["conv_id", "depth"], "left").select("conv_id", F.col("depth").alias("pos"), "k1", "k2", "p1", "p2", "n", "n_convs", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("saved", "leaf")])
    below = _running(rows, {"saved_tokens": ("saved", "c1"), "n_leaves": ("leaf", "c2")}, F.sum, Column.__add__, True, scratch)
    below = below.withColumnRenamed("pos", "depth")
    none, own = F.lit(None).cast("long"), F.col("n_convs").isNotNull()
    part = lambda df, **given: df.select(*KEY, *[given.get(c, none).alias(c) for c in ("conv_id", "n_convs", "n_leaves", "saved_tokens", "children", "parent")])
    sums = part(below.where(own | (F.col("n_leaves") > 0) | (F.col("saved_tokens") > 0)), conv_id=F.when(own, F.col("conv_id")), n_convs=F.col("n_convs"), n_leaves=F.col("n_leaves"), saved_tokens=F.col("saved_tokens"))
    # Each node counts at its parent, and takes its owner.
    child = below.where(own & (F.col("depth") > 0)).select(*KEY, (F.col("depth") - 1).alias("up"), "p1", "p2")
    counts = part(child.select(F.col("up").alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")), children=F.lit(1).cast("long"))
    parents = child.join(nodes.select(F.col("depth").alias("up"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("owner")), ["up", "p1", "p2"])
    everything = reduce(DataFrame.unionByName, [sums, counts, part(parents, parent=F.col("owner"))])
    found = everything.groupBy(*KEY).agg(
        F.max("conv_id").alias("conv_id"), F.max("parent").alias("parent_conv_id"), F.max("n_convs").alias("n_convs"), F.coalesce(F.sum("children"), F.lit(0)).alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"),
    )
    none_end = F.lit(hashlib.sha256().hexdigest())
    return found.join(_digests(paths), KEY, "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none_end).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """The trie of conversations with shared openings, see :func:`shared_openings`."""
    scratch = Scratch(conversations.sparkSession, "trie")
    turns, members = shared_openings(*ordered_turns(conversations, scratch), scratch, group, most)
    return prefix_trie(turns, members, scratch)
