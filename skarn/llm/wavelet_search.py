"""Exact ranked search over dual-sorted wavelet trees, one tree per shard of documents.

A shard concatenates its terms' posting lists, each in order of impact (highest first), and keeps the sequence of document numbers as a wavelet
matrix, a bit a level and posting. Within a term's range the first posting has the list's highest impact; a level down, the range splits
stably into the documents of either half, so the first posting of each part again has the highest impact among those documents. A
tree node is thus a range of documents with a range of postings for each term of a query, and the weighted sum of the ranges' first impacts is
an upper bound of the score of every document below it; at a leaf it is the score. Search expands nodes with the highest bounds first, many at a time in
one numpy step, and stops when no bound reaches the k-th best score; documents are numbered by doc_id, so equal scores come in its order. The best scores of one
shard prune the next of the same task.

Jobs: one pass counts documents and terms (a row per task), one builds the shards where their documents lie, without a shuffle; they are written to the shared
folder (or a given path, to be kept). Queries go over the shards in blocks of bounded size. A task gives its best k of each query, and Spark's window keeps k of those.

Score of a document with n terms, of which tf are the query's term, in a table of N documents with L terms (documents without terms don't count): the sum over the query's
distinct terms of ``weight * (10**9 * tf div (1000 * tf + 8 * m))`` with ``m = 10 + 90 * n * N div L`` and ``weight = floor(1000 * ln((2 N + 2) / (2 df + 1)))``.

Defined cases: null and empty texts and texts without terms are no documents; rows count by themselves, so repeated rows and ids are all ranked (equal scores by doc_id, null
last, then in any order); query rows are ranked by themselves, repeated and null item ids too; a query without terms, or whose terms no document holds, has no rows; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_map

#: A shard ends at so many postings; documents that are numbered together; shards of a file, so that a reader's batch is bounded; nodes expanded in one step.
POSTINGS, ROWS, SHARDS_A_FILE, STEP = 1 << 20, 1000, 4, 128
#: Bytes of queries that are broadcast together.
QUERY_BYTES = 8 << 20

_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.array([c + 32 if 0x41 <= c <= 0x5A else c for c in range(256)], np.uint8)
_FOLD = np.where(_TERM, _LOWER, 32).astype(np.uint8).tobytes()


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of characters beyond ASCII, with only A-Z lower-cased."""
    return text.translate(_FOLD).split()


def _inside(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of texts: all bytes, which of them belong to terms, which begin one, and the number of terms up to each text's begin (and the end)."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    inside = _TERM[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = (at[:-1] - at[0])[at[:-1] < at[1:]]
    begins[first] = inside[first]
    return raw, inside, begins, np.concatenate(([0], np.cumsum(begins)))[at - at[0]]


def corpus_size(documents: DataFrame, text: str = "text") -> tuple[int, int]:
    """Documents with a term, and terms."""

    def per_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n = np.diff(_inside(batch.column(0))[3])
        yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], ["n", "total"])

    row = arrow_map(documents.select(F.col(text).cast("string").alias("text")).where("text <> ''"), per_batch, "n long, total long").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    return row["n"] or 0, row["total"] or 0


class Builder:
    """Collects a task's batches of documents and gives a shard."""

    def __init__(self, n: int, total: int) -> None:
        self.n, self.total = n, total
        self.clear()

    def clear(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # document, term (by batch), impact
        self.words: list[pa.Array] = []
        self.ids: list[int | None] = []
        self.postings = 0

    def add(self, ids: list[int | None], texts: pa.Array) -> None:
        raw, inside, begins, upto = _inside(texts)
        n = np.diff(upto)
        if not n.sum():
            return
        # The terms' bytes stand one after another once the others are gone.
        starts = np.cumsum(inside)[begins] - 1
        held = _LOWER[raw[inside]]
        offsets = np.append(starts, len(held)).astype(np.int64)
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(held)]).dictionary_encode()
        some = np.flatnonzero(n)
        doc = np.repeat(np.arange(len(some), dtype=np.int64), n[some])
        pair, tf = np.unique((doc << 32) + coded.indices.to_numpy(), return_counts=True)
        doc, term = pair >> 32, pair & 0xFFFFFFFF
        m = 10 + 90 * n[some] * self.n // self.total
        self.parts.append(((doc + len(self.ids)).astype(np.int32), term.astype(np.int32), (10**9 * tf // (1000 * tf + 8 * m[doc])).astype(np.int32)))
        self.words.append(coded.dictionary)
        self.ids += [ids[i] for i in some.tolist()]
        self.postings += len(pair)

    def shard(self) -> dict[str, bytes | int]:
        """Columns of a shard: documents in order of id, terms, ends of their lists, impacts by list (highest first), and the bits of the documents' numbers, level by level."""
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        held = [self.ids[i] for i in order]
        some = sum(i is not None for i in held)
        number = np.empty(len(order), np.int32)
        number[order] = np.arange(len(order), dtype=np.int32)
        coded = pa.concat_arrays(self.words).dictionary_encode()  # the batches' terms under one number each
        same, at = coded.indices.to_numpy(), np.cumsum([0, *map(len, self.words)])
        doc = number[np.concatenate([d for d, _, _ in self.parts])]
        term = np.concatenate([same[at[k] + t] for k, (_, t, _) in enumerate(self.parts)])
        impact = np.concatenate([x for _, _, x in self.parts])
        by = np.argsort((term.astype(np.int64) << 32) + (1_000_000 - impact), kind="stable")
        doc, impact = doc[by], impact[by]
        height = max(1, (len(order) - 1).bit_length())
        bits, now = [], doc
        for level in range(height):
            bit = ((now >> (height - 1 - level)) & 1).astype(bool)
            bits.append(np.packbits(bit).tobytes())
            now = np.concatenate((now[~bit], now[bit]))
        return {
            "docs": len(order), "postings": len(doc), "ids": np.array(held[:some], "<i8").tobytes(), "words": b" ".join(coded.dictionary.to_pylist()),
            "ends": np.cumsum(np.bincount(term, minlength=len(coded.dictionary))).astype("<i4").tobytes(), "impacts": impact.astype("<i4").tobytes(), "bits": b"".join(bits),
        }


_SHARD = "docs long, postings long, ids binary, words binary, ends binary, impacts binary, bits binary"


def build(documents: DataFrame, path: str, size: tuple[int, int], doc_id: str = "doc_id", text: str = "text", postings: int = POSTINGS) -> DataFrame:
    """Writes the shards of documents to ``path`` and returns them. A shard ends with the batch (of bounded bytes) in which it reaches ``postings`` postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        builder = Builder(*size)

        def flush() -> pa.RecordBatch:
            shard = builder.shard()
            builder.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if isinstance(v, int) else pa.binary()) for v in shard.values()], list(shard))

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                builder.add(part.column(0).to_pylist(), part.column(1))
                if builder.postings >= postings:
                    yield flush()
        if builder.ids:
            yield flush()

    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("text <> ''")
    rows.mapInArrow(run, _SHARD).write.option("compression", "zstd").option("maxRecordsPerFile", SHARDS_A_FILE).parquet(path)
    return documents.sparkSession.read.schema(_SHARD).parquet(path)


class Shard:
    """A shard in memory: for each level the zeros before each place and the impacts in the level's order."""

    def __init__(self, row: dict) -> None:
        self.docs, n = row["docs"], row["postings"]
        self.height = max(1, (self.docs - 1).bit_length())
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.words, self.ends = row["words"].split(b" "), np.frombuffer(row["ends"], "<i4").astype(np.int64)
        width, packed = -(-n // 8), np.frombuffer(row["bits"], np.uint8)
        self.zeros, self.impacts = np.zeros((self.height, n + 1), np.int32), np.empty((self.height + 1, n), np.int32)
        self.impacts[0] = np.frombuffer(row["impacts"], "<i4")
        for level in range(self.height):
            one = np.unpackbits(packed[level * width : (level + 1) * width], count=n).view(bool)
            np.cumsum(~one, out=self.zeros[level, 1:])
            below, z = self.impacts[level + 1], self.zeros[level, n]
            np.compress(~one, self.impacts[level], out=below[:z])
            np.compress(one, self.impacts[level], out=below[z:])
        self.n, self.least = n, self.zeros[:, n].astype(np.int64)
        self.number: dict[bytes, int] | None = None

    def lists(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the words the shard holds, and the ranges of their lists."""
        if self.number is None:
            self.number = {w: i for i, w in enumerate(self.words)}
        at = [(k, self.number[w]) for k, w in enumerate(words) if w in self.number]
        which, i = np.array([k for k, _ in at], np.int64), np.array([i for _, i in at], np.int64)
        return which, np.where(i > 0, self.ends[i - 1], 0), self.ends[i]

    def id(self, doc: int) -> int | None:
        return int(self.ids[doc]) if doc < len(self.ids) else None

    def best(self, weights: np.ndarray, left: np.ndarray, right: np.ndarray, k: int, top: list[tuple]) -> list[tuple]:
        """The k best of ``top`` and this shard's documents as ``(-score, no id, id)``, in order.

        Nodes: level, prefix of the document numbers, bound, and a run of ranges, which are only those of terms that occur below the node."""
        zeros, impacts, n = self.zeros.ravel(), self.impacts.ravel(), self.n
        pool = np.array([left, right, weights], np.int64)  # ranges of all nodes so far
        used = len(left)
        level, prefix, begin, count = (np.array([x], np.int64) for x in (0, 0, 0, used))
        bound = np.array([int(impacts[left] @ weights)])
        while len(bound):
            if len(top) == k:  # what can't come before the k-th any more goes
                least, key = -top[-1][0], top[-1][1:]
                keep = bound > least
                for i in np.flatnonzero(bound == least).tolist():
                    doc = self.id(int(prefix[i]) << int(self.height - level[i]))
                    keep[i] = (doc is None, doc or 0) < key
                if not keep.all():
                    level, prefix, begin, count, bound = level[keep], prefix[keep], begin[keep], count[keep], bound[keep]
                    continue
            pick = np.argpartition(bound, len(bound) - STEP)[-STEP:] if len(bound) > STEP else np.arange(len(bound))
            m, runs = len(pick), count[pick]
            node = np.repeat(np.arange(m), runs)
            at = np.arange(len(node)) + np.repeat(begin[pick] - np.cumsum(runs) + runs, runs)
            l, r, w = pool[0, at], pool[1, at], pool[2, at]  # noqa: E741
            lv = level[pick][node]
            lz, rz = zeros[lv * (n + 1) + l].astype(np.int64), zeros[lv * (n + 1) + r].astype(np.int64)
            base = self.least[lv]
            child_l, child_r = np.concatenate((lz, base + l - lz)), np.concatenate((rz, base + r - rz))
            held = child_l < child_r
            child_l, child_r, child_w = child_l[held], child_r[held], np.concatenate((w, w))[held]
            child = np.concatenate((node, node + m))[held]
            part = child_w * impacts[(np.concatenate((lv, lv))[held] + 1) * n + child_l]
            runs = np.bincount(child, minlength=2 * m)
            some = np.flatnonzero(runs)
            first = (np.cumsum(runs) - runs)[some]
            fresh_bound = np.add.reduceat(part, first)
            fresh_level, fresh_prefix = level[pick][some % m] + 1, prefix[pick][some % m] * 2 + (some >= m)
            if used + len(child) > pool.shape[1]:
                pool = np.concatenate((pool, np.empty((3, max(pool.shape[1], len(child))), np.int64)), axis=1)
            pool[:, used : used + len(child)] = child_l, child_r, child_w
            leaf = fresh_level == self.height
            done = np.flatnonzero(leaf)
            if len(done) > 4 * k:
                done = done[np.lexsort((fresh_prefix[done], -fresh_bound[done]))][:k]
            if len(done):
                found = [(-int(fresh_bound[i]), (doc := self.id(int(fresh_prefix[i]))) is None, doc or 0) for i in done.tolist()]
                top = sorted(top + found)[:k]
            rest, go = np.ones(len(bound), bool), ~leaf
            rest[pick] = False
            level, prefix, bound = np.concatenate((level[rest], fresh_level[go])), np.concatenate((prefix[rest], fresh_prefix[go])), np.concatenate((bound[rest], fresh_bound[go]))
            begin, count = np.concatenate((begin[rest], used + first[go])), np.concatenate((count[rest], runs[some][go]))
            used += len(child)
        return top


def _blocks(queries: DataFrame, item_id: str, text: str, scratch: Scratch) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Queries as (item_id, distinct terms), in blocks of bounded bytes."""
    block, held = [], 0
    rows = queries.select(F.col(item_id).cast("long").alias("item_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    for row in rows.toLocalIterator():
        words = sorted(set(terms(row["text"].encode("utf-8", "surrogatepass"))))
        if words:
            block.append((row["item_id"], words))
            held += sum(map(len, words)) + 64
        if held >= QUERY_BYTES:
            yield block
            block, held = [], 0
    if block:
        yield block


def _frequencies(shards: DataFrame, block: list[tuple[int | None, list[bytes]]]) -> dict[bytes, int]:
    """Documents that hold each of a block's terms."""
    wanted = shards.sparkSession.sparkContext.broadcast(sorted({w for _, words in block for w in words}))

    def per_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        words = pa.array(wanted.value, pa.binary())
        for held, ends in zip(batch.column(0), batch.column(1), strict=True):
            place = pa.compute.index_in(words, value_set=pa.array(held.as_py().split(b" "), pa.binary()))
            at = np.flatnonzero(place.is_valid().to_numpy(zero_copy_only=False))
            df = np.diff(np.frombuffer(ends.as_py(), "<i4"), prepend=0)[place.drop_null().to_numpy()]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df.astype(np.int64))], ["term", "df"])

    import pyarrow.compute  # noqa: F401

    counts = arrow_map(shards.select("words", "ends"), per_batch, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {wanted.value[r["term"]]: r["df"] for r in counts.collect()}  # a number for each term of a block, which is bounded


def search(shards: DataFrame, queries: DataFrame, n: int, k: int = 10, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score`` of the k best documents of each query row. shards: of :func:`build`; n: documents with a term."""
    spark = shards.sparkSession
    scratch = Scratch(spark, "wavelet")
    schema = "query long, item_id long, doc_id long, score long"
    parts: list[DataFrame] = []
    for number, block in enumerate(_blocks(queries, item_id, text, scratch)):
        df = _frequencies(shards, block)
        weight = {w: math.floor(1000 * math.log((2 * n + 2) / (2 * f + 1))) for w, f in df.items()}
        asked = [(item, [w for w in words if weight.get(w, 0) > 0]) for item, words in block]
        shared = spark.sparkContext.broadcast([(item, words, np.array([weight[w] for w in words], np.int64)) for item, words in asked])
        found = shards.mapInArrow(_search_task(shared, k, number << 32), schema)
        parts.append(scratch.table(found, "found"))
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    everything = parts[0]
    for part in parts[1:]:
        everything = everything.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return everything.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _search_task(shared, k: int, first: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        tops: list[list[tuple]] = [[] for _ in queries]
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard({c: batch.column(c)[row].as_py() for c in batch.schema.names})
                for q, (_, words, weights) in enumerate(queries):
                    which, left, right = shard.lists(words)
                    if len(which):
                        tops[q] = shard.best(weights[which], left, right, k, tops[q])
                del shard
        rows = [(first + q, queries[q][0], None if none else doc, -score) for q, top in enumerate(tops) for score, none, doc in top]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(4)], ["query", "item_id", "doc_id", "score"])

    return run


def rank_documents(documents: DataFrame, queries: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """:func:`search` of queries over an index that is built for them."""
    spark: SparkSession = documents.sparkSession
    size = corpus_size(documents, text)
    if not size[0]:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return search(build(documents, Scratch(spark, "index").path("shards"), size, doc_id, text), queries, size[0], k)
