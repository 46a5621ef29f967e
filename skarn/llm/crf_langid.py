"""Language identification with a linear-chain conditional random field over words.

Emission scores come from hashed affix and character n-gram features and from per-language lexicons; the transition matrix is learned with
them by gradient ascent on the sequences' conditional likelihood (forward-backward in the log domain's normalised form). Training sequences are
code-switched: spans of the labelled sample in random languages, one after another, so the transitions learn how languages follow each other.
Inference runs forward-backward over all words of each whole text; a text's language is the label with the largest mean posterior.

The model is fitted on a bounded sample: ``sample_per_label`` labelled rows of each label at most, those with the smallest hashes of id and text, and of each the span of ``span_chars`` characters
at a hashed place; every label is learned. Prediction reads the text only.

Defined cases: null text and text without a letter give ``und`` with score 0; with no labelled rows every text is ``und``; doc_id may be null (such rows
are predicted, never learned from) or repeated; other columns are carried through, those named like an output are replaced; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, without

WORD = re.compile(r"[^\W\d_]+")
BITS = 16
#: Words whose scores a Python worker keeps; words in one forward-backward block.
CACHE, BLOCK = 600_000, 250_000


def features(word: str) -> list[int]:
    """Hashed affixes (1 to 3 characters), bounded character bigrams and trigrams, and the word itself."""
    mask, w = (1 << BITS) - 1, f"<{word}>"
    names = [f"p{word[:k]}" for k in (1, 2, 3)] + [f"s{word[-k:]}" for k in (1, 2, 3)] + [f"w{word}"]
    names += [w[i : i + 2] for i in range(len(w) - 1)] + [w[i : i + 3] for i in range(len(w) - 2)]
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) & mask for n in names]


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray
    lexicon: dict[str, int]
    lexicon_weights: np.ndarray
    seen: dict[str, int] = field(default_factory=dict)
    table: np.ndarray | None = None

    def scores(self, words: list[str]) -> np.ndarray:
        """Emission scores of words: [words, labels]."""
        ids = [features(w) for w in words]
        flat = np.fromiter((i for x in ids for i in x), np.int64, sum(map(len, ids)))
        starts = np.cumsum([0] + [len(x) for x in ids[:-1]]) if ids else np.zeros(0, np.int64)
        out = np.add.reduceat(self.weights[flat], starts, axis=0) if len(words) else np.zeros((0, len(self.labels)), np.float32)
        for i, w in enumerate(words):
            if (k := self.lexicon.get(w)) is not None:
                out[i] += self.lexicon_weights[k]
        return out

    def index(self, texts_words: list[list[str]]) -> list[np.ndarray]:
        """Row numbers of words in ``table``, which holds exp(score - largest score)."""
        if self.table is None:
            self.table = np.zeros((0, len(self.labels)))
        new = list(set().union(*texts_words) - self.seen.keys())
        for at in range(0, len(new), 50_000):
            part = new[at : at + 50_000]
            s = self.scores(part).astype(np.float64)
            self.seen.update(zip(part, range(len(self.table), len(self.table) + len(part)), strict=True))
            self.table = np.concatenate([self.table, np.maximum(np.exp(s - s.max(axis=1, keepdims=True)), 1e-30)])
        get = self.seen.__getitem__
        return [np.fromiter(map(get, words), np.int32, len(words)) for words in texts_words]

    def posteriors(self, sequences: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
        """Forward-backward over word rows: each non-empty sequence's number and its words' posteriors. Sequences of like length share a
        block, and only a block is held."""
        order = sorted((i for i, s in enumerate(sequences) if len(s)), key=lambda i: -len(sequences[i]))
        if not self.labels:
            return
        move, begin = np.exp(self.transitions - self.transitions.max()), np.exp(self.start - self.start.max())
        at = 0
        while at < len(order):
            block, size = [], 0
            while at < len(order) and (not block or size + len(sequences[order[at]]) <= BLOCK):
                block.append(order[at])
                size += len(sequences[order[at]])
                at += 1
            n = np.array([len(sequences[i]) for i in block])
            offset = np.concatenate(([0], np.cumsum(n)[:-1]))
            emit = self.table[np.concatenate([sequences[i] for i in block])]
            alpha = np.empty_like(emit)
            active = np.searchsorted(-n, -np.arange(n[0]), side="left")  # sequences longer than t
            a = emit[offset] * begin
            a /= a.sum(axis=1, keepdims=True)
            alpha[offset] = a
            for t in range(1, n[0]):
                rows = offset[: active[t]] + t
                a = (a[: active[t]] @ move) * emit[rows]
                a /= a.sum(axis=1, keepdims=True)
                alpha[rows] = a
            beta = np.ones((len(block), len(self.labels)))
            for t in range(n[0] - 2, -1, -1):
                rows = offset[: active[t + 1]] + t
                b = (emit[rows + 1] * beta[: active[t + 1]]) @ move.T
                b /= b.sum(axis=1, keepdims=True)
                beta[: active[t + 1]] = b
                alpha[rows] *= b
            alpha /= alpha.sum(axis=1, keepdims=True)
            for k, i in enumerate(block):
                yield i, alpha[offset[k] : offset[k] + n[k]]


def fit(spans: list[tuple[str, str]], sequences: int = 1600, length: int = 40, epochs: int = 14, seed: int = 11) -> Crf:
    """Learns from ``(label, text)`` spans; both counts and steps are fixed, whatever the corpus."""
    by: dict[str, list[list[str]]] = {}
    for label, text in spans:
        if words := WORD.findall(text.lower()):
            by.setdefault(label, []).append(words)
    labels = sorted(by)
    n = len(labels)
    crf = Crf(labels, np.zeros((1 << BITS, n), np.float32), np.zeros((n, n)), np.zeros(n), {}, np.zeros((n, n), np.float32))
    if not labels:
        return crf
    held: dict[str, Counter] = {}
    for k, label in enumerate(labels):
        for words in by[label]:
            for w in set(words):
                held.setdefault(w, Counter())[k] += 1
    for w, c in held.items():  # a lexicon holds words found in three spans or more, nearly all of one label
        k, top = c.most_common(1)[0]
        if top >= 3 and top >= 0.9 * sum(c.values()):
            crf.lexicon[w] = k
    rng = np.random.default_rng(seed)
    x: list[list[str]] = []
    y = np.zeros((sequences, length), np.int64)
    for s in range(sequences):
        words: list[str] = []
        at = int(rng.integers(n))
        while len(words) < length:
            span = by[labels[at]][int(rng.integers(len(by[labels[at]])))]
            take = int(rng.integers(4, 21))
            begin = int(rng.integers(max(1, len(span) - take + 1)))
            part = span[begin : begin + take]
            y[s, len(words) : len(words) + len(part)] = at
            words += part
            at = int(rng.integers(n))
        x.append(words[:length])
    vocabulary = sorted(set().union(*x))
    number = {w: i for i, w in enumerate(vocabulary)}
    ids = [features(w) for w in vocabulary]
    width = max(map(len, ids))
    padded = np.zeros((len(ids), width), np.int64)
    real = np.zeros((len(ids), width), np.float32)
    for i, f in enumerate(ids):
        padded[i, : len(f)], real[i, : len(f)] = f, 1
    in_lexicon = np.array([crf.lexicon.get(w, -1) for w in vocabulary])
    rows = np.array([[number[w] for w in words] for words in x])
    g2 = [np.full(a.shape, 1e-4) for a in (crf.weights, crf.transitions, crf.start, crf.lexicon_weights)]
    for _ in range(epochs):
        shuffled = rng.permutation(sequences)
        for at in range(0, sequences, 200):
            pick = shuffled[at : at + 200]
            used, inverse = np.unique(rows[pick], return_inverse=True)
            emit = (crf.weights[padded[used]] * real[used][:, :, None]).sum(axis=1)
            known = in_lexicon[used]
            emit[known >= 0] += crf.lexicon_weights[known[known >= 0]]
            e = emit[inverse.reshape(rows[pick].shape)].astype(np.float64)
            grad_e, grad_t, grad_s = _gradient(e, y[pick], crf.transitions, crf.start)
            per_word = np.zeros((len(used), n))
            np.add.at(per_word, inverse.ravel(), grad_e.reshape(-1, n))
            touched, place = np.unique(padded[used][real[used] > 0], return_inverse=True)  # of the weights a step moves these alone
            grad_w = np.zeros((len(touched), n))
            np.add.at(grad_w, place.ravel(), np.repeat(per_word, real[used].sum(axis=1).astype(int), axis=0))
            grad_w -= 1e-3 * crf.weights[touched]
            g2[0][touched] += grad_w * grad_w
            crf.weights[touched] += (0.15 * grad_w / np.sqrt(g2[0][touched])).astype(crf.weights.dtype)
            grad_l = np.zeros(crf.lexicon_weights.shape)
            np.add.at(grad_l, known[known >= 0], per_word[known >= 0])
            for value, grad, total in ((crf.transitions, grad_t - 1e-3 * crf.transitions, g2[1]), (crf.start, grad_s, g2[2]), (crf.lexicon_weights, grad_l - 1e-3 * crf.lexicon_weights, g2[3])):
                total += grad * grad
                value += (0.15 * grad / np.sqrt(total)).astype(value.dtype)
    return crf


def _gradient(e: np.ndarray, y: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Observed minus expected counts of emissions, transitions and starts."""
    count, length, n = e.shape
    emit, move = np.exp(e - e.max(axis=2, keepdims=True)), np.exp(transitions)
    alpha, beta, scale = np.empty_like(emit), np.ones_like(emit), np.empty((count, length))
    a = emit[:, 0] * np.exp(start)
    for t in range(length):
        if t:
            a = (a @ move) * emit[:, t]
        scale[:, t] = a.sum(axis=1)
        a = a / scale[:, t, None]
        alpha[:, t] = a
    for t in range(length - 2, -1, -1):
        beta[:, t] = ((emit[:, t + 1] * beta[:, t + 1]) @ move.T) / scale[:, t + 1, None]
    gamma = alpha * beta
    grad_e, eye = -gamma, np.eye(n)
    grad_e += eye[y]
    expected = np.einsum("sti,ij,stj->ij", alpha[:, :-1], move, emit[:, 1:] * beta[:, 1:] / scale[:, 1:, None])
    observed = np.einsum("sti,stj->ij", eye[y[:, :-1]], eye[y[:, 1:]])
    return grad_e, observed - expected, (eye[y[:, 0]] - gamma[:, 0]).sum(axis=0)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "lang", sample_per_label: int = 500, span_chars: int = 2500) -> Crf:
    """Fits on a bounded sample of the labelled rows that aren't held out: each label's rows with the smallest hashes, one span of each text."""
    usable = documents.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(doc_id)))
    label_text, words = F.col(label).cast("string"), F.col(text).cast("string")
    begin = F.pmod(F.xxhash64(F.lit("span"), F.col(doc_id)), F.greatest(F.char_length(words) - span_chars, F.lit(1)).cast("long")).cast("int")
    drawn = usable.select(label_text.alias("label"), words.substr(begin + 1, F.lit(span_chars)).alias("span"), F.col(doc_id).cast("string").alias("id"), F.xxhash64(F.lit("sample"), F.col(doc_id), words).alias("draw"))
    # First the largest hash of each label's sample, from hashes alone; each task keeps as many as are wanted at most before they meet.
    rank = lambda *order: F.row_number().over(Window.partitionBy("label").orderBy(*order))
    largest = drawn.select("label", "draw").withColumn("rank", rank("draw")).where(F.col("rank") <= sample_per_label).groupBy("label").agg(F.max("draw").alias("largest"))
    largest = drawn.sparkSession.createDataFrame(largest.collect(), "label string, largest long")  # a row for each label
    chosen = drawn.join(F.broadcast(largest), "label").where(F.col("draw") <= F.col("largest"))
    rows = chosen.withColumn("rank", rank("draw", "id", "span")).where(F.col("rank") <= sample_per_label).select("label", "span", "id").collect()
    return fit([(r["label"], r["span"]) for r in sorted(rows, key=lambda r: (r["id"], r["span"]))])


def predict(documents: DataFrame, model: Crf, text: str = "text", with_spans: bool = False) -> DataFrame:
    """documents with ``lang_pred`` and ``lang_score`` and, on request, ``lang_spans``: runs of words of one label as
    (start, end, lang), code points, end exclusive."""
    kind = "array<struct<start:int,end:int,lang:string>>"
    source = without(documents, ["lang_pred", "lang_score", "lang_spans"])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields)
    ship(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at_text = source.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        for batch in batches:
            lang, score, spans = _label(crf, batch.column(at_text).cast(pa.string()).to_pylist(), with_spans)
            columns, names = [*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names, "lang_pred", "lang_score"]
            if with_spans:
                columns.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))))
                names.append("lang_spans")
            yield pa.RecordBatch.from_arrays(columns, names)

    return source.mapInArrow(run, f"{fields}, lang_pred string, lang_score double" + (f", lang_spans {kind}" if with_spans else ""))


def _label(crf: Crf, texts: list[str | None], with_spans: bool) -> tuple[list[str], list[float], list]:
    known = [t if t and crf.labels and any(map(str.isalpha, t)) else "" for t in texts]
    lang, score, spans = ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
    if len(crf.seen) > CACHE:
        crf.seen, crf.table = {}, None
    rows: list[np.ndarray] = []
    for at in range(0, len(known), 500):
        rows += crf.index([WORD.findall(t.lower()) for t in known[at : at + 500]])
    for i, p in crf.posteriors(rows):
        mean = p.mean(axis=0)
        best = int(np.argmax(mean))
        lang[i], score[i] = crf.labels[best], float(min(1.0, max(0.0, mean[best])))
        if with_spans:
            top = p.argmax(axis=1)
            places = [m.span() for m in WORD.finditer(known[i])] if len(known[i]) == len(known[i].lower()) else []
            if len(places) == len(top):
                edges = [0, *(np.flatnonzero(np.diff(top)) + 1).tolist(), len(top)]
                spans[i] = [{"start": places[a][0], "end": places[b - 1][1], "lang": crf.labels[int(top[a])]} for a, b in zip(edges, edges[1:], strict=False)]
    return lang, score, spans
