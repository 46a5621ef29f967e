"""SimHash near-duplicates with sharded vantage-point trees.

A fingerprint has 64 bits; two fingerprints link if at most ``max_bits`` bits differ. By the pigeonhole principle such a pair differs in
at most ``max_bits // 2`` bits in one of its two halves, so one vantage-point tree is grown for each half under the Hamming distance of
that half. A tree's inner nodes (vantage point, median distance) come from a bounded sample of the fingerprints; its leaves are shards.
Every distinct fingerprint has one home shard per tree and also visits each shard that the triangle inequality can't rule out, i.e. those
whose boundary lies within the search radius of its distance to the vantage point. Inside a shard pairs are verified exactly on all 64 bits,
in blocks of bounded size, and only a spanning forest of them leaves the task, so a dense group of copies costs one row per member.

Defined cases: null text counts as empty; texts without words have fingerprint zero, which links like any other; fewer words than a
shingle give the whole sequence as one shingle; equal rows share a fingerprint; component_id is the smallest non-null doc_id of the
component (null if there is none); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, components

#: Distinct fingerprints a shard should hold, the depth of the tree that the driver grows (a larger shard grows a tree of its own in its task), sampled fingerprints for each shard.
SHARD_ROWS, MAX_DEPTH, SAMPLE_PER_SHARD = 2048, 16, 32
#: Comparisons held in memory at once.
BLOCK = 1 << 19


def simhash(text: str | None, words: int = 3) -> int:
    """Majority bits of the XXH64 (seed 42) of all word shingles, repeats included."""
    from xxhash import xxh64_intdigest

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(tokens)
    if not n:
        return 0
    if n <= words:
        hashes = [xxh64_intdigest(b" ".join(tokens), 42)]
    else:
        joined = b" ".join(tokens)
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: n - words + 1]
        hashes = [xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=True)]
    total = len(hashes)
    counts = np.zeros(64, np.int64)
    values = np.array(hashes, dtype=">u8")
    for at in range(0, total, 65536):
        part = values[at : at + 65536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def fingerprints(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """``(doc_id, fp)``, the fingerprint as a signed long."""

    def per_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fps = np.array([simhash(t, words) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return arrow_map(documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), per_batch, "doc_id long, fp long")


class Tree:
    """A vantage-point tree over one half of the bits: arrays of vantage points and median distances in heap order."""

    def __init__(self, sample: np.ndarray, depth: int, high: bool, seed: int = 7) -> None:
        self.depth, self.high = depth, high
        self.points, self.medians = np.zeros(1 << depth, np.uint32), np.zeros(1 << depth, np.int64)
        rng, members = np.random.default_rng(seed), {1: self.half(sample)}
        for node in range(1, 1 << depth):
            own = members.pop(node)
            if len(own) == 0:
                own = np.zeros(1, np.uint32)
            tries = rng.choice(own, size=min(12, len(own)), replace=False)
            # The widest spread of distances leaves the fewest fingerprints near the boundary.
            spread = [np.bitwise_count(own ^ t).astype(np.int64).std() for t in tries]
            point = tries[int(np.argmax(spread))]
            d = np.bitwise_count(own ^ point).astype(np.int64)
            median = int(np.median(d)) - (1 if d.size and (d <= np.median(d)).mean() > 0.75 else 0)
            self.points[node], self.medians[node] = point, median
            members[2 * node], members[2 * node + 1] = own[d <= median], own[d > median]

    def half(self, fps: np.ndarray) -> np.ndarray:
        return (fps >> np.uint64(32)).astype(np.uint32) if self.high else fps.astype(np.uint32)

    def route(self, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shard, index, is home) of every visit; a fingerprint visits shards before its home only, so each pair meets once."""
        half, home = self.half(fps), np.ones(len(fps), np.int64)
        frontier = [(1, np.arange(len(fps)))]
        for _ in range(self.depth):
            d = np.bitwise_count(half ^ self.points[home]).astype(np.int64)
            home = 2 * home + (d > self.medians[home])
        for _ in range(self.depth):
            below = []
            for node, idx in frontier:
                d = np.bitwise_count(half[idx] ^ self.points[node]).astype(np.int64)
                below.append((2 * node, idx[d - radius <= self.medians[node]]))
                below.append((2 * node + 1, idx[d + radius > self.medians[node]]))
            frontier = [(node, idx) for node, idx in below if len(idx)]
        shards, ids, is_home = [], [], []
        for node, idx in frontier:
            idx = idx[home[idx] >= node]
            shards.append(np.full(len(idx), node - (1 << self.depth), np.int64))
            ids.append(idx)
            is_home.append(home[idx] == node)
        return np.concatenate(shards), np.concatenate(ids), np.concatenate(is_home)


def spanning(home: np.ndarray, visitors: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links home x (home + visitors): each linked fingerprint with the representative of its component."""
    everyone = np.concatenate([home, visitors])
    root = np.arange(len(everyone))

    def settle(r: np.ndarray) -> np.ndarray:
        while True:
            up = r[r]
            if np.array_equal(up, r):
                return r
            r = up

    rows = max(1, BLOCK // max(1, len(everyone)))
    for at in range(0, len(home), rows):
        i, j = np.nonzero(np.bitwise_count(home[at : at + rows, None] ^ everyone[None, at:]) <= max_bits)
        i, j = i + at, j + at
        i, j = i[i < j], j[i < j]
        while len(i):
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            root = settle(root)
    linked = root != np.arange(len(root))
    return everyone[linked], everyone[root[linked]]


def spanning_tree(home: np.ndarray, visitors: np.ndarray, max_bits: int, rows: int = SHARD_ROWS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``spanning`` of a shard of any size: above ``rows`` it is split by a vantage point in all 64 bits, and a fingerprint within ``max_bits`` of the boundary also visits the other side."""
    todo = [(home, visitors)]
    while todo:
        home, visitors = todo.pop()
        if len(home) > rows:
            tries = home[:: max(1, len(home) // 8)][:8]
            some = home[:: max(1, len(home) // 4096)]
            point = tries[int(np.argmax([np.bitwise_count(some ^ t).astype(np.int64).std() for t in tries]))]
            own, other = np.bitwise_count(home ^ point).astype(np.int64), np.bitwise_count(visitors ^ point).astype(np.int64)
            median = int(np.median(own)) - (1 if (own <= np.median(own)).mean() > 0.75 else 0)
            inner = own <= median
            if 0 < inner.sum() < len(home):
                # Pairs across the boundary meet on its inner side, pairs of visitors and a side's own on that side.
                todo.append((home[inner], np.concatenate([home[~inner & (own <= median + max_bits)], visitors[other <= median + max_bits]])))
                todo.append((home[~inner], visitors[other > median - max_bits]))
                continue
        yield spanning(home, visitors, max_bits)


def links(distinct: DataFrame, scratch: Scratch, max_bits: int = 3) -> DataFrame:
    """``(a, b)``: edges between distinct fingerprints ``(fp)`` that span the same components as all links do."""
    n = distinct.count()
    depth = min(MAX_DEPTH, max(0, math.ceil(math.log2(max(1, n) / SHARD_ROWS))))
    sample = distinct.orderBy(F.xxhash64(F.lit("vantage"), F.col("fp")), "fp").limit(SAMPLE_PER_SHARD << depth).collect()
    known = np.array([r["fp"] for r in sample], dtype=np.int64).view(np.uint64)
    trees, radius = [Tree(known, depth, high) for high in (False, True)], max_bits // 2

    def route(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for k, tree in enumerate(trees):
            shard, idx, home = tree.route(fps, radius)
            yield pa.RecordBatch.from_arrays([pa.array(shard + (k << depth)), pa.array(fps[idx].view(np.int64)), pa.array(home)], ["shard", "fp", "home"])

    def search(table: pa.Table) -> pa.Table:
        fps, home = table.column("fp").to_numpy().view(np.uint64), table.column("home").to_numpy(zero_copy_only=False)
        found = list(spanning_tree(fps[home], fps[~home], max_bits))
        return pa.table({k: np.concatenate([x[i] for x in found]).view(np.int64) for i, k in enumerate("ab")})

    routed = arrow_map(distinct.select("fp"), route, "shard long, fp long, home boolean")
    return routed.groupBy("shard").applyInArrow(search, "a long, b long")


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, max_bits: int = 3) -> DataFrame:
    """One row per document: ``doc_id, fp, component_id``."""
    scratch = Scratch(documents.sparkSession, "simhash")
    docs = scratch.table(fingerprints(documents, doc_id, text, words), "fp")
    distinct = scratch.table(docs.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    labels = components(links(distinct, scratch, max_bits), scratch)
    member = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of = scratch.table(member.join(smallest, "root").select("fp", "component_id"), "of")
    return docs.join(of, "fp", "left").select("doc_id", "fp", "component_id")
