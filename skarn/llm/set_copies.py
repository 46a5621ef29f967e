"""Near copies by SimHash and the exact Jaccard similarity of word shingles.

Two texts link if their sets of five-word shingles have a similarity of 0.8 or more. Candidates come first from fingerprints of the sets, which vantage-point trees bring together within three
bits (:mod:`vp_simhash`); they are verified on the whole sets. What differs in more bits is found exactly: under any order of all shingles such sets share one of
the first ``n - ceil(0.8 n) + 1`` of their n shingles, so texts meet by an equi-join on these and no linked pair is missed. The order puts
shingles first that a sample of the texts doesn't repeat; the sample decides about speed only. Sizes, positions and counts of shingles in cells rule out most of the pairs
that meet by chance; the others are verified on the whole sets. Texts that fingerprints haven't joined first meet the smallest text of each shingle; pairs of all others are
only formed where a shingle still joins different components, so a dense group of copies costs one pair per member and shingle.

Defined cases: null text counts as empty; texts without words are copies of each other, fewer words than a shingle give the whole sequence as
one shingle; equal sets are one node. Rows have keys of their own, so doc_id may be null or repeated: exactly one row of each component
stays, the one with the smallest doc_id (null last), then with the smallest content hash. All columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, broadcast_if_few, components, hash128, unused
from .vp_simhash import links as fingerprint_links

WORDS = 5
#: Texts of the sample, and the most repeated shingles of it that are put last.
SAMPLE, REPEATED = 8192, 1 << 16
#: Cells in which a set's shingles are counted.
CELLS = 256


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    from xxhash import xxh64_intdigest

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    each = np.fromiter(map(xxh64_intdigest, tokens), np.uint64, len(tokens))
    length = min(words, len(each))
    out = np.full(max(1, len(each) - words + 1), length + 1, np.uint64)
    for k in range(length):
        out = (out ^ each[k : k + len(out)]) * np.uint64(0x9E3779B185EBCA87)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _hash(held: np.ndarray) -> int:
    """The node of a set: a hash of the whole of it."""
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(held.tobytes(), 42) - (1 << 63)


def _fingerprint(held: np.ndarray) -> int:
    """The majority bits of a set's shingles, as a signed integer."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(held), 8192):
        counts += np.unpackbits(held[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(held)).view(np.int64)[0])


def _counts(held: np.ndarray) -> bytes:
    """How many shingles of a set fall into each of ``CELLS`` cells; empty if a cell has too many for a byte. Two sets share no more than the lesser count of each cell."""
    n = np.bincount((held & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
    return n.astype(np.uint8).tobytes() if n.max() < 256 else b""


def _nodes(texts: DataFrame) -> DataFrame:
    """``row, doc_id, h1, h2, node, fp, counts, cells`` of ``row, doc_id, h1, h2, text``. cells: the counts as numbers, empty if one is above 127."""

    def per_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        nodes, fps, counts, cells = [], [], [], []
        for text in batch.column(4):
            held = shingles(text.as_py())
            nodes.append(_hash(held))
            fps.append(_fingerprint(held))
            counts.append(_counts(held))
            cells.append(np.frombuffer(counts[-1], np.int8) if counts[-1] and max(counts[-1]) < 128 else np.zeros(0, np.int8))
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(nodes, pa.int64()), pa.array(fps, pa.int64()), pa.array(counts, pa.binary()), pa.array(cells, pa.list_(pa.int8()))], ["row", "doc_id", "h1", "h2", "node", "fp", "counts", "cells"])

    return arrow_map(texts, per_batch, "row long, doc_id long, h1 long, h2 long, node long, fp long, counts binary, cells array<tinyint>")


def _repeated(texts: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of the shingles that a sample repeats most."""

    def per_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for text in batch.column(0).to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(shingles(text).view(np.int64))], ["h"])

    some = texts.where(F.pmod(F.xxhash64(F.lit("sample"), "row"), F.lit(max(1, total // SAMPLE))) == 0)
    counts = arrow_map(some.select("text"), per_batch, "h long").groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(REPEATED).collect()
    found = np.array([r["h"] for r in counts], np.int64).view(np.uint64)
    order = np.argsort(found)
    return found[order], np.array([r["count"] for r in counts], np.int64)[order]


def _prefixes(texts: DataFrame, hashes: np.ndarray, counts: np.ndarray) -> DataFrame:
    """``key, node, place``: the first shingles of each set; equal sets bring equal rows. place: the set's size and the shingle's position in it, see ``_places``."""
    shared = texts.sparkSession.sparkContext.broadcast((np.append(hashes, np.uint64(0)), np.append(counts, 0)))

    def per_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known, often = shared.value
        for at in range(0, batch.num_rows, 1000):
            keys, nodes, sizes, whole = [], [], [], []
            for text in batch.column(0).slice(at, 1000).to_pylist():
                held = shingles(text)
                i = np.searchsorted(known[:-1], held)
                count = np.where(known[i] == held, often[i], 0)
                n = len(held)
                keys.append(held[np.argsort(count, kind="stable")][: n - (4 * n + 4) // 5 + 1])
                nodes.append(_hash(held))
                sizes.append(len(keys[-1]))
                whole.append(n)
            pos = np.arange(sum(sizes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            columns = [np.concatenate(keys).view(np.int64), np.repeat(np.array(nodes, np.int64), sizes), (np.repeat(np.array(whole, np.int64), sizes) << 32) | pos]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "node", "place"])

    return arrow_map(texts.select("text"), per_batch, "key long, node long, place long")


def _places(place: Column) -> tuple[Column, Column]:
    """The set's size and the shingle's position."""
    return F.shiftright(place, 32), place.bitwiseAND(F.lit((1 << 32) - 1))


def _may_link(place1: Column, place2: Column) -> Column:
    """Whether sets that share the shingles at these places can reach the similarity."""
    (n1, pos1), (n2, pos2) = _places(place1), _places(place2)
    most = F.least(pos1, pos2) + 1 + F.least(n1 - 1 - pos1, n2 - 1 - pos2)
    return (5 * F.least(n1, n2) >= 4 * F.greatest(n1, n2)) & (9 * most >= 4 * (n1 + n2))


def _possible(pairs: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs ``(a, b)`` less those that can't reach the similarity, whatever shingles of equal cells are the same."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    counts = scratch.table(rows.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("counts").alias("counts")), "counts")

    def per_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known = np.array([len(x.as_buffer()) and len(y.as_buffer()) for x, y in zip(batch.column(2), batch.column(3), strict=True)], bool)
        keep = ~known
        if known.any():
            some = batch.filter(pa.array(known))
            x, y = (np.frombuffer(b"".join(some.column(c).to_pylist()), np.uint8).reshape(-1, CELLS) for c in (2, 3))
            common, total = np.minimum(x, y).sum(axis=1, dtype=np.int64), x.sum(axis=1, dtype=np.int64) + y.sum(axis=1, dtype=np.int64)
            keep[known] = 5 * common >= 4 * (total - common)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    of = lambda c: counts.select(F.col("node").alias(c), F.col("counts").alias(f"counts_{c}"))
    return scratch.table(arrow_map(pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "counts_a", "counts_b"), per_batch, "a long, b long"), "possible")


def _verified(pairs: DataFrame, texts: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Those of the pairs ``(a, b)`` whose sets reach the similarity. One text stands for each node; texts travel, as they are smaller than their sets and compress."""
    pairs = _possible(pairs, rows, scratch)
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    bearers = scratch.table(rows.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("row").alias("row")), "bearers")
    borne = scratch.table(texts.join(broadcast_if_few(bearers), "row").select("node", "text"), "borne")
    path = scratch.paths[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}  # sets of nodes that many pairs share
        for batch in batches:
            keep = []
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if a not in held:
                    if len(held) >= 64:
                        held.clear()
                    held[a] = shingles(x.as_py())
                u, v = held[a], shingles(y.as_py())
                both = np.sort(np.concatenate((u, v)), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(5 * common >= 4 * (len(u) + len(v) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of = lambda c: borne.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))
    links = scratch.table(pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long"), "links")
    scratch.drop(path)
    return links


def _fingerprinted(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs ``(a, b)`` of nodes within three bits of each other, or joined by such: a spanning forest of each group, and all nodes of a fingerprint with the smallest."""
    nodes = scratch.table(rows.select("node", "fp").distinct(), "fingerprints")
    least = scratch.table(nodes.groupBy("fp").agg(F.min("node").alias("least")), "least")
    of = lambda c: least.select(F.col("fp").alias(c), F.col("least").alias(f"least_{c}"))
    apart = fingerprint_links(least.select("fp"), scratch).distinct().join(of("a"), "a").join(of("b"), "b").select(F.col("least_a").alias("a"), F.col("least_b").alias("b"))
    return scratch.table(nodes.join(least, "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).unionByName(apart), "close")


def _components(texts: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, root)`` of the linked sets."""
    from pyspark.sql import Window

    close = _fingerprinted(rows, scratch)
    known = _verified(close, texts, rows, scratch)
    roots = components(known, scratch)
    key = Window.partitionBy("key")
    prefixes = _prefixes(texts, *_repeated(texts, rows.count()))
    shared = scratch.table(prefixes.withColumn("least", F.min(F.struct("node", "place")).over(key)).withColumn("last", F.max("node").over(key)).where("least.node <> last").drop("last"), "shared")
    shared_path = scratch.paths[-1]
    scratch.release()
    near = shared.where((F.col("node") != F.col("least.node")) & _may_link(F.col("place"), F.col("least.place")))
    pairs = scratch.table(near.select(F.col("least.node").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    root = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    joined = F.coalesce(F.col("root_a") == F.col("root_b"), F.lit(False))
    pairs = scratch.table(pairs.join(root("a"), "a", "left").join(root("b"), "b", "left").where(~joined).select("a", "b"), "pairs")
    links = scratch.table(_verified(pairs, texts, rows, scratch).unionByName(known), "links")
    labels = components(links, scratch)

    # Keys that still join components are compared in full, but for pairs whose counts rule them out before the join gives them out.
    mixed = _mixed(shared.drop("least").distinct(), labels, scratch)
    scratch.drop(shared_path)
    scratch.release()
    if mixed.isEmpty():
        return labels
    nodes = rows.groupBy("node").agg(F.first("cells").alias("cells")).join(mixed.select("node").distinct(), "node", "left_semi")
    mixed = scratch.table(mixed.join(nodes, "node"), "cells")
    few = mixed.where("root <> most").select("key", *[F.col(c).alias(f"{c}1") for c in ("node", "place", "root", "cells")])
    # Sets without cells (texts above some 25,000 words) are ruled out by nothing here.
    common = F.aggregate(F.zip_with("cells", "cells1", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    counted = (F.size("cells") > 0) & (F.size("cells1") > 0)
    total = _places(F.col("place"))[0] + _places(F.col("place1"))[0]
    # A pair of two components that are not the largest is met once.
    once = (F.col("root") == F.col("most")) | (F.col("node") < F.col("node1"))
    met = few.join(mixed, "key").where((F.col("root") != F.col("root1")) & once & _may_link(F.col("place"), F.col("place1")) & (~counted | (9 * common >= 4 * total)))
    fresh = _new(met.select("node1", "node"), pairs, scratch)
    if fresh.isEmpty():
        return labels
    more = _verified(fresh, texts, rows, scratch)
    return labels if more.isEmpty() else components(links.unionByName(more), scratch)


def _mixed(plain: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """``key, node, place, root, most``: the rows of keys whose nodes are in several components; most: the component of most of them.
    Of keys with the same nodes, as a passage's shingles have, one stays: a pair that links passes the bounds at every shingle that it shares."""
    placed = plain.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    same = [F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"same{k}") for k in (1, 2)]
    several = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n"), *same).where("low <> high")
    several = several.groupBy("n", "same1", "same2").agg(F.min("key").alias("key")).select("key")
    mixed = scratch.table(placed.join(several, "key", "left_semi"), "mixed")
    most = mixed.groupBy("key", "root").count().groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("most"))
    return mixed.join(most, "key")


def _new(met: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct pairs ``(a, b)`` of ``node, node1`` that aren't among pairs."""
    ordered = met.select(F.least("node", "node1").alias("a"), F.greatest("node", "node1").alias("b")).distinct()
    return scratch.table(ordered.join(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "pairs")


def drop_copies(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """documents with one row of each component of near copies."""
    scratch = Scratch(documents.sparkSession, "copies")
    scratch.release()
    (number,) = unused(documents, "_row")
    docs = scratch.table(documents.withColumn(number, F.monotonically_increasing_id()), "rows")
    filled = F.coalesce(F.col(text).cast("string"), F.lit(""))
    h1, h2 = hash128(filled)
    texts = docs.select(F.col(number).alias("row"), F.col(doc_id).cast("long").alias("doc_id"), h1.alias("h1"), h2.alias("h2"), filled.alias("text"))
    rows = scratch.table(_nodes(texts), "nodes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2", "row")).alias("first")
    labels = _components(texts.select("row", "text"), rows, scratch)
    kept = rows.groupBy("node").agg(first).join(labels, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    kept = scratch.table(kept.select(F.col("first.row").alias("row")), "kept")
    extra = scratch.table(rows.join(kept, "row", "left_anti").select(F.col("row").alias(number)), "extra")
    return docs.join(broadcast_if_few(extra), number, "left_anti").select(*documents.columns)
