"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue: its documents' token ids one after another. In each round a queue's deficit counter grows by its quantum (its target
share of a window, a fixed-point number), the whole tokens of the counter are served and the fraction is carried to the next round, so
after k rounds a queue has served ``min(total, floor(k * quantum))`` tokens. The served slices, round by round and queue by queue, form one
stream that is cut every ``window`` tokens: all windows but the last are full, and a window holds its queues in target proportion to within a
token each, plus what rounding carried over. Because the deficits have this closed form, a task knows the state of the scheduler at any round
without running the rounds before it: deficits carry across partitions as well as across windows, and no task depends on another.

A source below one token a window (on average) joins one shared queue, so there are at most ``window`` + 1 queues.

Defined cases: null text counts as empty and gives the end id alone; null and empty source share a queue; doc_id may be null or repeated
(each row is packed by itself); other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

WINDOW, SCALE = 2048, 16
#: Words whose ids a Python worker keeps; texts that are encoded together.
CACHE, ROWS = 1_000_000, 2500
#: A word with signs before and after it: the pre-tokenizer parts them.
_PARTS = re.compile(r"([^\w']*)([^\W\d_]+)([^\w']*)")


class WordIds:
    """Token ids of whole texts by the tokenizers library, through a cache of the pieces between spaces and line ends.

    The vocabulary's pre-tokenizer never joins across white space, so a text's ids are its pieces' ids in order. Texts in Latin-1 are lower-cased
    first, which the tokenizer's own normalizer would do, and signs around a word are tokens of their own. New words of letters only
    are encoded many at a time, in one string, and cut behind the tokens that end a word, which is faster than an encoding for each.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.dtype = np.dtype("<u2") if len(self.last) <= 1 << 16 else np.dtype("<u4")
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache: dict[str, bytes] = {}

    def _encode(self, words: list[str]) -> None:
        for at in range(0, len(words), 2048):  # an encoding takes a kilobyte
            part = words[at : at + 2048]
            for word, found in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.cache[word] = np.array(found.ids, dtype=self.dtype).tobytes()

    def _encode_plain(self, words: list[str]) -> None:
        for at in range(0, len(words), 8192):
            part = words[at : at + 8192]
            ids = np.array(self.plain.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids)
            ends = ((np.flatnonzero(self.last[ids]) + 1) * self.dtype.itemsize).tolist()
            packed = ids.astype(self.dtype).tobytes()
            self.cache.update(zip(part, [packed[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        whole, folded = [], np.zeros(len(texts), bool)
        special: dict[int, str] = {}
        for i, text in enumerate(texts):
            text = text or ""
            if any(token in text for token in self.added):  # the tokenizer finds these before it parts words
                special[i] = text
                text = ""
            try:
                text.encode("latin-1")
                text, folded[i] = text.lower(), True
            except UnicodeEncodeError:
                pass
            whole.append(text.replace("\n", " "))
        # Words become numbers of the batch's distinct words, so that Python sees each word once a batch.
        split = pc.split_pattern(pa.array(whole, pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        at, number, words = split.offsets.to_numpy(), coded.indices.to_numpy(), coded.dictionary.to_pylist()
        cache, plain = self.cache, np.zeros(len(words), bool)
        if len(cache) > CACHE:
            cache.clear()
        plain[number[np.repeat(folded, np.diff(at))]] = True
        letters, rest, parted, others = set(), set(), [], set()
        get = cache.get
        pieces = [get(w) for w in words]
        missing = [i for i, x in enumerate(pieces) if x is None]
        for i in missing:
            w = words[i]
            if not plain[i]:
                others.add(w)
            elif w.isalpha():
                letters.add(w)
            elif (m := _PARTS.fullmatch(w)) and (parts := m.groups())[1].isalpha():
                parted.append((w, parts))
                letters.add(parts[1])
                rest.update((parts[0], parts[2]))
            else:
                rest.add(w)
        new = lambda words: [w for w in words if w not in cache]
        self._encode_plain(new(letters))
        self._encode(new(rest))
        for w, (before, word, after) in parted:
            cache[w] = cache[before] + cache[word] + cache[after]
        self._encode(new(others | set(special.values())))
        for i in missing:
            pieces[i] = cache[words[i]]
        width = self.dtype.itemsize
        n = np.fromiter(map(len, pieces), np.int64, len(pieces)) // width
        known, begin = np.frombuffer(b"".join(pieces), self.dtype), np.cumsum(n) - n
        count = n[number]
        end = np.cumsum(count)
        ids = known[np.repeat((begin[number] - end + count).astype(np.int32), count) + np.arange(end[-1] if len(end) else 0, dtype=np.int32)]
        cut = np.concatenate(([0], end))[at].tolist()
        out = [ids[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)]
        for i, text in special.items():
            out[i] = cache.pop(text)
        return out


_ENCODERS: dict[str, WordIds] = {}


def tokenised(documents: DataFrame, tokenizer: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``doc_id, source, part, before, n, ids``: ids as little-endian integers, the task that made the row, and the tokens of the same
    source that the task has seen before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if tokenizer not in _ENCODERS:
            _ENCODERS[tokenizer] = WordIds(tokenizer)
        encoder, part, seen = _ENCODERS[tokenizer], TaskContext.get().partitionId(), {}
        width, end = encoder.dtype.itemsize, np.array([end_id], dtype=encoder.dtype).tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                ids = [x + end for x in encoder.encode(batch.column(2).to_pylist())]
                sources, before = batch.column(1).to_pylist(), []
                for s, x in zip(sources, ids, strict=True):
                    before.append(seen.get(s, 0))
                    seen[s] = before[-1] + len(x) // width
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(np.full(len(ids), part, np.int64)), pa.array(before, pa.int64()), pa.array([len(x) // width for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "source", "part", "before", "n", "ids"],
                )

    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, source string, part long, before long, n long, ids binary")


class Schedule:
    """The scheduler's state after any number of rounds. totals: tokens of each queue; weights: their target shares."""

    def __init__(self, totals: list[int], weights: list[float], window: int = WINDOW) -> None:
        self.window = window
        self.totals = np.array(totals, dtype=np.int64)
        whole = math.fsum(weights) or 1.0
        self.quanta = np.array([max(1, round(w / whole * window * (1 << SCALE))) for w in weights], dtype=np.int64)
        self.dry = np.array([-(-(int(t) << SCALE) // int(q)) for t, q in zip(self.totals, self.quanta, strict=True)], dtype=np.int64)

    def served(self, rounds: np.ndarray) -> np.ndarray:
        """Tokens that each queue has served after so many rounds: [rounds, queues]."""
        return np.minimum(self.totals, (np.minimum(rounds[:, None], self.dry) * self.quanta) >> SCALE)

    def place(self, queue: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """Pieces of documents that hold tokens first to first + n of their queue: (document, start, length, window, offset)."""
        q = self.quanta[queue]
        turn = lambda t: -(-((t + 1) << SCALE) // q) - 1  # noqa: E731  the round that serves token t
        k0, k1 = turn(first), turn(first + n - 1)
        # A queue of less than a token a round is not served in most rounds; its tokens have a round each.
        slow = q < 1 << SCALE
        each = np.where(slow, n, k1 - k0 + 1)
        doc = np.repeat(np.arange(len(queue)), each)
        step = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
        k = np.where(slow[doc], -(-((first[doc] + step + 1) << SCALE) // q[doc]) - 1, k0[doc] + step)
        low, position = np.empty(len(doc), np.int64), np.empty(len(doc), np.int64)
        high, step = np.empty(len(doc), np.int64), max(1, (1 << 21) // len(self.totals))
        for at in range(0, len(doc), step):
            rows = slice(at, at + step)
            now, after, own = self.served(k[rows]), self.served(k[rows] + 1), queue[doc[rows]]
            ahead = np.cumsum(after - now, axis=1) - (after - now)
            i = np.arange(len(own))
            low[rows], high[rows] = now[i, own], after[i, own]
            position[rows] = now.sum(axis=1) + ahead[i, own]
        begin, end = np.maximum(low, first[doc]), np.minimum(high, (first + n)[doc])
        position, length = position + begin - low, end - begin
        some = length > 0
        doc, begin, position, length = doc[some], begin[some], position[some], length[some]
        # Turns that follow each other without another queue between them are one piece.
        head = np.ones(len(doc), bool)
        head[1:] = (doc[1:] != doc[:-1]) | (position[1:] != position[:-1] + length[:-1])
        heads = np.flatnonzero(head)
        length = np.add.reduceat(length, heads) if len(heads) else length
        doc, begin, position = doc[heads], begin[heads], position[heads]
        w0 = position // self.window
        cuts = (position + length - 1) // self.window - w0 + 1
        of = np.repeat(np.arange(len(doc)), cuts)
        w = np.repeat(w0 - np.concatenate(([0], np.cumsum(cuts)[:-1])), cuts) + np.arange(len(of))
        a, b = np.maximum(position[of], w * self.window), np.minimum((position + length)[of], (w + 1) * self.window)
        return doc[of], begin[of] + a - position[of] - first[doc[of]], b - a, w, a - w * self.window


def pack(documents: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = 1, weights: Mapping[str, float] | None = None, temper: float = 1.0, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Packs all documents: one row per piece, ``doc_id, source, start, length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset``. weights: target share by source (default: the corpus' own shares); sources that are not named share what their tokens would get. temper: the default shares
    are the corpus' to this power, so that below 1 small sources get more of each window than they have of the corpus, until they run dry."""
    spark, scratch = documents.sparkSession, Scratch(documents.sparkSession, "pack")
    docs = scratch.table(tokenised(documents, tokenizer, end_id, doc_id, text, source), "ids")
    sums = scratch.table(docs.groupBy("part", "source").agg(F.sum("n").alias("tokens")), "sums")
    by_source = sums.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    total = sums.agg(F.sum("tokens")).first()[0] or 0
    large = sorted((r["source"], r["tokens"]) for r in by_source.where(F.col("tokens") * window >= total).collect())  # window rows at most
    names, totals = [s for s, _ in large], [t for _, t in large]
    totals.append(total - sum(totals))
    shares = [float(t) ** temper for t in totals]
    if weights:
        named = sum(weights.values()) or 1.0
        rest = sum(t for s, t in large if s not in weights) + totals[-1]
        shares = [weights[s] / named * (total - rest) if s in weights else float(t) for s, t in large] + [float(totals[-1])]
    schedule = Schedule(totals, shares, window)
    numbers = spark.createDataFrame([(s, i) for i, s in enumerate(names)], "source string, queue int")
    queued = sums.join(F.broadcast(numbers), "source", "left").withColumn("queue", F.coalesce("queue", F.lit(len(names))))
    ahead = queued.groupBy("queue", "part").agg(F.sum("tokens").alias("t")).withColumn("ahead", F.sum("t").over(Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    inside = F.sum("tokens").over(Window.partitionBy("queue", "part").orderBy("source").rowsBetween(Window.unboundedPreceding, -1))
    # Written, so that its size is known: where it is small the join below is a broadcast and the ids are not shuffled.
    bases = queued.withColumn("inside", inside).join(ahead.select("queue", "part", "ahead"), ["queue", "part"]).select("part", "source", "queue", (F.coalesce("ahead", F.lit(0)) + F.coalesce("inside", F.lit(0))).alias("base"))
    bases = scratch.table(bases, "bases")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for encoder in _ENCODERS.values():
            encoder.cache.clear()  # a worker that has tokenised before needs its cache no more
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                queue, first, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
                ids = batch.column(5).to_pylist()
                if not ids:
                    continue
                width = len(ids[0]) // int(n[0])
                doc, start, length, sequence, offset = schedule.place(queue, first, n)
                wide = [np.frombuffer(x, dtype=f"<u{width}").astype("<u4").tobytes() for x in ids]
                pieces = [wide[d][4 * a : 4 * b] for d, a, b in zip(doc.tolist(), start.tolist(), (start + length).tolist(), strict=True)]
                index = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(index), batch.column(1).take(index), pa.array(start), pa.array(length), pa.array(pieces, pa.binary()), pa.array(n[doc]), pa.array(sequence), pa.array(offset)],
                    ["doc_id", "source", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

    placed = docs.join(bases, ["part", "source"]).select("doc_id", "source", "queue", (F.col("base") + F.col("before")).alias("first"), "n", "ids")
    return placed.mapInArrow(cut, "doc_id long, source string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
