"""Benchmark decontamination by latent semantic retrieval.

Texts become word hashes (punctuation dropped, A-Z lower-cased) and, in passages of ``PASSAGE`` words, TF-IDF vectors over hashed features; document frequencies count all
documents. One distributed pass applies the Gram matrix of all passages to a random test matrix (each task sums its own part, parts are summed block by block), and a
Nystroem step on the small result gives the right singular vectors: a randomised SVD. Windows of every whole text, half a passage apart, are compared with the items.
A window is a candidate for an item if the words around it (as many on each side as the item has) hold ``least_lcs`` of the item's words and of their idf mass; the item's rarest words
tell first where that can be, which loses nothing, since without enough of them the mass can't be reached.
The latent space ranks an item's candidate windows: they are confirmed by falling cosine of window and item until one is sure, and the cosine of the confirmed window is reported.
It drops none: for a short item in a window of other words the cosine is mostly noise.
A candidate is confirmed by the longest common subsequence of words: it must cover ``least_lcs`` of the item; between ``least_lcs`` and ``sure_lcs`` the item's answer (what follows its last question mark, else its last sentence) must be there, too.

Benchmark items are taken in blocks of bounded size against all documents, so neither the driver nor a task ever holds more than a block.

Items of fewer than ``least_words`` words are too short for a subsequence to tell anything; they match where their words stand consecutively (cosine, share and answer are then 1, 1 and true).

Defined cases: null text has no words; items without a word are never matched; copies are all reported; doc_id may be null or repeated; an empty
benchmark or table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, hash128, unused

PASSAGE, FEATURE_BITS, RANK, EXTRA, ITEM_BLOCK = 32, 14, 24, 8, 5000
FEATURES = 1 << FEATURE_BITS
_CHUNK = 256  # features of a block when parts are summed
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def word_hashes(text: str | None) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()
    return np.fromiter(map(zlib.crc32, words), np.uint32, len(words))


def hashed(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, h1, h2, ids``: word hashes as little-endian unsigned 32-bit integers, and the text's content hash."""

    def per_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = pa.array([word_hashes(t).tobytes() for t in batch.column(3).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], ids], ["doc_id", "h1", "h2", "ids"])

    filled = F.coalesce(F.col(text).cast("string"), F.lit(""))
    h1, h2 = hash128(filled)
    return arrow_map(documents.select(F.col(doc_id).cast("long").alias("doc_id"), h1.alias("h1"), h2.alias("h2"), filled.alias("text")), per_batch, "doc_id long, h1 long, h2 long, ids binary")


def _groups(column: pa.Array, words: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word hashes of some texts, their word counts), so many words at a time."""
    held, size = [], 0
    for raw in column:
        ids = np.frombuffer(raw.as_buffer(), np.uint32) if raw.is_valid else np.zeros(0, np.uint32)
        held.append(ids)
        size += len(ids)
        if size >= words:
            yield np.concatenate(held), np.array([len(x) for x in held])
            held, size = [], 0
    if held:
        yield np.concatenate(held), np.array([len(x) for x in held])


def _summed(parts: DataFrame, columns: int, scratch: Scratch) -> np.ndarray:
    """Sums the tasks' matrices ``(block, part)`` block by block; FEATURES x columns."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(_CHUNK * columns)
        for raw in table.column("part").to_pylist():
            total += np.frombuffer(raw, np.float32)
        return pa.table({"block": table.column("block").slice(0, 1), "part": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros((FEATURES, columns))
    for r in parts.groupBy("block").applyInArrow(add, "block long, part binary").collect():
        out[r["block"] * _CHUNK : (r["block"] + 1) * _CHUNK] = np.frombuffer(r["part"]).reshape(_CHUNK, columns)
    return out


def _emit(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    blocks = [total[at : at + _CHUNK].astype(np.float32).tobytes() for at in range(0, FEATURES, _CHUNK)]
    yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int64()), pa.array(blocks, pa.binary())], ["block", "part"])


def document_frequencies(ids: DataFrame, scratch: Scratch) -> np.ndarray:
    """Documents that hold each feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES, 1))
        for batch in batches:
            for words, n in _groups(batch.column(0)):
                key = np.unique(np.repeat(np.arange(len(n)), n) * FEATURES + (words & (FEATURES - 1)))
                total[:, 0] += np.bincount(key & (FEATURES - 1), minlength=FEATURES)
        yield from _emit(total)

    return _summed(ids.select("ids").mapInArrow(run, "block long, part binary"), 1, scratch)[:, 0]


def _sums(rows: np.ndarray, heads: np.ndarray) -> np.ndarray:
    return np.add.reduceat(rows, heads, axis=0)


def gram_times(ids: DataFrame, idf: np.ndarray, test: np.ndarray, scratch: Scratch) -> np.ndarray:
    """(A^T A) test for the TF-IDF matrix A of all passages, rows of unit length, in one pass."""
    weights, matrix = idf.astype(np.float32), test.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(matrix.shape)
        for batch in batches:
            for words, n in _groups(batch.column(0), 1 << 13):
                if not len(words):
                    continue
                feature = (words & (FEATURES - 1)).astype(np.uint16)
                inside = np.arange(len(words)) - np.repeat(np.cumsum(n) - n, n)
                head = inside % PASSAGE == 0
                heads, passage = np.flatnonzero(head), np.cumsum(head) - 1
                w = weights[feature]
                norm = np.sqrt(_sums(w * w, heads))
                a = w / np.maximum(norm, 1e-6)[passage]
                y = _sums(matrix[feature] * a[:, None], heads)
                order = np.argsort(feature, kind="stable")
                f = feature[order]
                first = np.flatnonzero(np.concatenate(([True], f[1:] != f[:-1])))
                total[f[first]] += _sums(y[passage[order]] * a[order, None], first)
        yield from _emit(total)

    return _summed(ids.select("ids").mapInArrow(run, "block long, part binary"), test.shape[1], scratch)


def singular_vectors(product: np.ndarray, test: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Nystroem: right singular vectors and singular values from (A^T A) test."""
    shift = 1e-7 * max(np.linalg.norm(product), 1e-12)
    moved = product + shift * test
    core = test.T @ moved
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    root = vectors / np.sqrt(np.maximum(values, shift * 1e-3))
    u, s, _ = np.linalg.svd(moved @ root, full_matrices=False)
    return u[:, :rank], np.sqrt(np.maximum(s[:rank] ** 2 - shift, 0.0))


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a bit for each element of b."""
    masks: dict[int, int] = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | (1 << j)
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        if m := masks.get(x):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(b) - v.bit_count()


def answer_words(text: str) -> int:
    """How many of the item's last words are its answer: what follows the last question mark, else the last sentence."""
    body = text.rstrip()
    cut = body.rfind("?")
    if cut < 0 or cut >= len(body) - 1:
        cut = max(body.rstrip(".!?").rfind(x) for x in (".", "!", "\n"))
    return len(word_hashes(body[cut + 1 :])) if cut >= 0 else 0


def _phrases(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each place on."""
    out = np.full(max(0, len(words) - n + 1), n, np.uint64)
    for k in range(n):
        out = (out ^ words[k : k + len(out)].astype(np.uint64)) * np.uint64(0x9E3779B185EBCA87)
        out ^= out >> np.uint64(29)
    return out


class Items:
    """A block of benchmark items: their passages in latent space, and postings of the rarest words, which hold most of each item's idf mass."""

    BITS = 20

    def __init__(self, items: list[tuple[int, str]], idf: np.ndarray, vectors: np.ndarray, least_words: int, least_lcs: float) -> None:
        self.ids, self.words, self.answers, self.of, latent = [], [], [], [], []
        self.flags, self.needs, rare = np.zeros(1 << self.BITS, bool), [], []
        self.short: dict[int, dict[int, list[tuple[int, np.ndarray]]]] = {}  # by length and the hash of all words
        for item_id, text in items:
            words = word_hashes(text)
            if len(words) < least_words:
                if len(words):
                    self.short.setdefault(len(words), {}).setdefault(int(_phrases(words, len(words))[0]), []).append((item_id, words))
                continue
            for at in sorted({*range(0, max(1, len(words) - PASSAGE + 1), PASSAGE // 2), max(0, len(words) - PASSAGE)}):
                f = words[at : at + PASSAGE] & (FEATURES - 1)
                latent.append((vectors[f] * idf[f, None]).sum(axis=0))
                self.of.append(len(self.ids))
            each, counts = np.unique(words, return_counts=True)
            weight = counts * idf[each & (FEATURES - 1)].astype(np.float64)
            order = np.argsort(-idf[each & (FEATURES - 1)], kind="stable")
            rank = np.searchsorted(np.cumsum(weight[order]), (1 - least_lcs / 2) * weight.sum()) + 1
            # What the common words can't bring the rare ones must.
            self.needs.append((1 - 1e-5) * least_lcs * weight.sum() - weight[order[rank:]].sum())
            rare.append((each[order[:rank]].astype(np.int64), weight[order[:rank]]))
            self.flags[each[order[:rank]] & ((1 << self.BITS) - 1)] = True
            self.ids.append(item_id)
            self.words.append(words)
            self.answers.append(answer_words(text))
        self.latent = np.array(latent, np.float32).reshape(-1, vectors.shape[1])
        self.latent /= np.maximum(np.linalg.norm(self.latent, axis=1, keepdims=True), 1e-9)
        cuts = np.searchsorted(np.array(self.of, int), np.arange(len(self.ids) + 1))
        self.rows = [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]  # each item's passages
        self.longest = max(map(len, self.words), default=0)
        self.needs = np.array(self.needs)
        owner = np.repeat(np.arange(len(rare)), [len(r[0]) for r in rare])
        words, weight = (np.concatenate([r[i] for r in rare] or [np.zeros(0, np.int64)]) for i in (0, 1))
        self.phrases = {n: np.array(sorted(of), np.uint64) for n, of in self.short.items()}
        order = np.argsort(words, kind="stable")
        self.holders, self.weight = owner[order], weight[order]
        self.vocabulary, first = np.unique(words[order], return_index=True)
        self.first = np.append(first, len(words))

    def verbatim(self, words: np.ndarray) -> set[int]:
        """Short items whose words stand in the words, one after the other."""
        found = set()
        for n, known in self.phrases.items():
            here = _phrases(words, n)
            at = np.minimum(np.searchsorted(known, here), len(known) - 1)
            for i in np.flatnonzero(known[at] == here).tolist():
                found.update(item_id for item_id, item in self.short[n][int(here[i])] if np.array_equal(words[i : i + n], item))
        return found

    def likely(self, words: np.ndarray) -> np.ndarray:
        """Items whose rare words the words hold as far as they must."""
        u = np.unique(words[self.flags[words & ((1 << self.BITS) - 1)]]).astype(np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, u), len(self.vocabulary) - 1)
        at = at[self.vocabulary[at] == u]
        if not len(at):
            return np.zeros(0, np.int64)
        held = np.concatenate([np.arange(self.first[i], self.first[i + 1]) for i in at])
        return np.flatnonzero(np.bincount(self.holders[held], self.weight[held], minlength=len(self.ids)) >= self.needs)


def _covered(words: np.ndarray, item: np.ndarray, weight: np.ndarray, lows: np.ndarray, highs: np.ndarray, least: float) -> np.ndarray:
    """Which of the ranges of words hold the least share of the item's words and of their weight."""
    each, inverse, counts = np.unique(item, return_inverse=True, return_counts=True)
    mass = np.bincount(inverse, weight)
    at = np.minimum(np.searchsorted(each, words), len(each) - 1)
    places = np.flatnonzero(each[at] == words)
    which, out = at[places], np.zeros(len(lows), bool)
    first, last = np.searchsorted(places, lows), np.searchsorted(places, highs)
    for r in np.flatnonzero(last > first).tolist():
        held = np.bincount(which[first[r] : last[r]], minlength=len(each)) > 0
        out[r] = counts[held].sum() >= least * len(item) - 1e-9 and mass[held].sum() >= (1 - 1e-6) * least * mass.sum()
    return out


def _cosines(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, passages: np.ndarray, idf: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The cosine of each window with the nearest passage of an item."""
    latent = np.zeros((len(starts), vectors.shape[1]), np.float32)
    for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        f = words[a:b] & (FEATURES - 1)
        latent[i] = (vectors[f] * idf[f, None]).sum(axis=0)
    return (latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9) @ passages.T).max(axis=1, initial=-1.0)


def search(words: np.ndarray, items: Items, idf: np.ndarray, vectors: np.ndarray, least_lcs: float, sure_lcs: float) -> list[tuple[int, float, float, bool]]:
    """(item id, cosine, share of the item in the common subsequence, answer found) of one text."""
    n = len(words)
    if not n:
        return []
    short = [(item_id, 1.0, 1.0, True) for item_id in items.verbatim(words)]
    if not len(items.ids):
        return sorted(short)
    starts = np.arange(0, max(1, n - PASSAGE // 2), PASSAGE // 2)
    ends = np.minimum(starts + PASSAGE, n)
    best: dict[int, tuple[float, float, bool]] = {}
    stretch = max(32, items.longest // PASSAGE)
    for at in range(0, len(starts), stretch):
        s, e = starts[at : at + stretch], ends[at : at + stretch]
        low = max(0, int(s[0]) - items.longest)
        part = words[low : e[-1] + items.longest]
        for k in items.likely(part).tolist():
            item = items.words[k]
            m, tail = len(item), items.answers[k]
            if k in best and best[k][1] >= sure_lcs:
                continue
            weight = idf[item & (FEATURES - 1)].astype(np.float64)
            held = np.flatnonzero(_covered(part, item, weight, np.maximum(0, s - m) - low, e + m - low, least_lcs))
            close = _cosines(words, s[held], e[held], items.latent[items.rows[k]], idf, vectors)
            for i in np.argsort(-close, kind="stable").tolist():
                a, b = int(s[held[i]]), int(e[held[i]])
                around = words[max(0, a - m) : b + m].tolist()
                share = lcs(around, item.tolist()) / m
                answer = bool(tail) and lcs(around, item[m - tail :].tolist()) >= 0.9 * tail
                if (share >= sure_lcs or share >= least_lcs and answer) and (k not in best or share > best[k][1]):
                    best[k] = (float(close[i]), share, answer)
                    if share >= sure_lcs:
                        break
    return sorted([*short, *((items.ids[k], *v) for k, v in best.items())])


def contaminated(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least_lcs: float = 0.6, sure_lcs: float = 0.75, least_words: int = 8) -> DataFrame:
    """One row for each document and benchmark item it holds: ``doc_id, item_id, cosine, lcs, answer, h1, h2`` (h1, h2: the text's content hash)."""
    spark, scratch = documents.sparkSession, Scratch(documents.sparkSession, "latent")
    schema = "doc_id long, h1 long, h2 long, item_id long, cosine double, lcs double, answer boolean"
    ids = scratch.table(hashed(documents, doc_id, text), "ids")
    total = ids.count()
    blocks = max(1, -(-benchmark.count() // ITEM_BLOCK))
    frequency = document_frequencies(ids, scratch)
    idf = np.log((1.0 + total) / (1.0 + np.minimum(frequency, total))).astype(np.float32) + 0.01
    test = np.linalg.qr(np.random.default_rng(5).standard_normal((FEATURES, RANK + EXTRA)))[0]
    vectors, values = singular_vectors(gram_times(ids, idf, test, scratch), test, RANK)
    whitened = (vectors / np.maximum(values, 1e-3 * max(float(values.max(initial=0.0)), 1e-9))).astype(np.float32)
    found = None
    for b in range(blocks):
        mine = benchmark.where(F.pmod(F.xxhash64(F.col(item_id), F.col(item_text)), F.lit(blocks)) == b).select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t"))
        block = Items([(r["i"], r["t"]) for r in mine.where("t is not null").collect()], idf, whitened, least_words, least_lcs)
        shared = spark.sparkContext.broadcast((block, idf, whitened))

        def per_batch(batch: pa.RecordBatch, shared=shared) -> Iterator[pa.RecordBatch]:
            items, idf, vectors = shared.value
            take, rows = [], []
            for i, raw in enumerate(batch.column(3).to_pylist()):
                for hit in search(np.frombuffer(raw, np.uint32), items, idf, vectors, least_lcs, sure_lcs):
                    take.append(i)
                    rows.append(hit)
            at = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in range(3)], pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.bool_())], ["doc_id", "h1", "h2", "item_id", "cosine", "lcs", "answer"])

        part = arrow_map(ids, per_batch, schema)
        found = part if found is None else found.unionByName(part)
    return scratch.table(found, "found")


def decontaminate(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """documents without those that hold a benchmark item; all columns stay."""
    one, two = unused(documents, "_l1", "_l2")
    leaks = contaminated(documents, benchmark, doc_id, text, **how).select(F.col("h1").alias(one), F.col("h2").alias(two)).distinct()
    leaks = Scratch(documents.sparkSession, "leaks").table(leaks, "texts")
    h1, h2 = hash128(F.coalesce(F.col(text).cast("string"), F.lit("")))
    return documents.join(leaks, (h1 == F.col(one)) & (h2 == F.col(two)), "left_anti")
