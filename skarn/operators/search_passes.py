"""Passes over texts for the persisted index: posting lists and trigrams of some thousand documents at a time, over arrays of characters instead of token by token."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: A text with a character that this finds is not simple: its tokens come from ``code_tokens``. Others are Latin letters and punctuation, whose classes and lower case are in the tables below.
NOT_SIMPLE = r"[\x{130}\x{250}-\x{1FFF}\x{2070}-\x{10FFFF}]"  # a negated class takes eight times as long
_WORD, _LOWER, _UPPER = 1, 2, 4
#: Characters and documents that are held at once, unless a single text has more.
CHARACTERS, DOCUMENTS = 1 << 22, 4096
LISTS = "field string, term string, postings binary, positions binary, summary binary"
POSTING = np.dtype([("doc", "<i8"), ("tf", "<i4"), ("length", "<i4"), ("block", "<i8")])
SUMMARY = np.dtype([("block", "<i8"), ("tf", "<i4"), ("length", "<i4")])


def _tables() -> tuple[np.ndarray, np.ndarray]:
    kinds, lower = np.zeros(0x2070, np.uint8), np.arange(0x2070, dtype=np.uint16)
    for c in [*range(0x130), *range(0x131, 0x250)]:
        category = unicodedata.category(chr(c))
        kinds[c] = _WORD * (category[0] in "LN") + _LOWER * (category == "Ll") + _UPPER * (category == "Lu")
        lower[c] = ord(chr(c).lower())
    return kinds, lower


_KINDS, _LOWERED = _tables()


def _chunks(batches: Iterator[pa.RecordBatch], texts: tuple[int, ...]) -> Iterator[list[list]]:
    """The columns of some rows at a time; texts: the columns whose characters count."""
    held: list[list] = []
    size = 0
    for batch in batches:
        for first in range(0, batch.num_rows, 64):
            columns = [c.slice(first, 64).to_pylist() for c in batch.columns]
            held = [a + b for a, b in zip(held, columns, strict=True)] if held else columns
            size += sum(len(t) for c in texts for t in columns[c])
            if size >= CHARACTERS or len(held[0]) >= DOCUMENTS:
                yield held
                held, size = [], 0
    if held:
        yield held


def _strings(data: bytes, offsets: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))


def simple_tokens(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """``code_tokens`` of simple texts, one after another, and how many each has."""
    c = np.frombuffer(("\n".join(texts) + "\n").encode("utf-16-le"), np.uint16)  # all of two bytes
    kinds = _KINDS[c]
    word, lower, upper = (kinds & _WORD).astype(bool), (kinds & _LOWER).astype(bool), (kinds & _UPPER).astype(bool)
    start = word.copy()
    start[1:] &= ~word[:-1] | (lower[:-1] & upper[1:])
    start[1:-1] |= upper[:-2] & upper[1:-1] & lower[2:]
    kept = _LOWERED[c[word]]
    ends = np.append(0, np.cumsum(1 + (kept >= 0x80).astype(np.int64) + (kept >= 0x800)))
    tokens = _strings(kept.tobytes().decode("utf-16-le").encode(), ends[np.append(np.flatnonzero(start[word]), len(kept))])
    until = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    return tokens, np.diff(np.searchsorted(np.flatnonzero(start), until), prepend=0)


def _field_tokens(texts: list[str], given: list[list[str] | None]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All tokens, the place of each one's document among ``texts``, and how many each document has; given: the tokens of texts that are not simple."""
    simple = np.fromiter((g is None for g in given), bool, len(given))
    tokens, counted = simple_tokens([t for t, s in zip(texts, simple, strict=True) if s])
    counts = np.zeros(len(texts), np.int64)
    counts[simple] = counted
    owner = np.repeat(np.flatnonzero(simple), counted)
    if not simple.all():
        others = np.flatnonzero(~simple)
        counts[others] = [len(given[i]) for i in others]
        tokens = pa.concat_arrays([tokens, pa.array([t for i in others for t in given[i]], pa.string())])
        owner = np.append(owner, np.repeat(others, counts[others]))
    return tokens, owner, counts


def _packed(records: np.ndarray, firsts: np.ndarray) -> pa.Array:
    """The bytes of the records from each of ``firsts`` to the next."""
    offsets = np.append(firsts, len(records)) * records.dtype.itemsize
    return pa.BinaryArray.from_buffers(pa.binary(), len(firsts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(records.tobytes())])


def _records(kind: np.dtype, *columns: np.ndarray) -> np.ndarray:
    out = np.empty(len(columns[0]), kind)
    for name, column in zip(kind.names, columns, strict=True):
        out[name] = column
    return out


def unpacked(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> Iterator[pa.RecordBatch]:
    """A row for each record of ``field, term, segment, packed``: ``field, term, segment`` and the record's fields."""
    for batch in batches:
        for n in range(batch.num_rows):
            records = np.frombuffer(batch.column(3)[n].as_buffer(), kind)
            same = [pa.repeat(batch.column(c)[n], len(records)) for c in range(3)]
            yield pa.RecordBatch.from_arrays([*same, *[pa.array(records[f].astype(np.int64)) for f in kind.names]], ["field", "term", "segment", *kind.names])


def posting_lists(batches: Iterator[pa.RecordBatch], partition: int, block: int) -> Iterator[pa.RecordBatch]:
    """``LISTS`` of ``doc, content, path, content tokens, path tokens`` (null where the text is simple): for each term of some thousand documents its ``POSTING`` records, its positions in each
    document (the first, then the steps to the next) and the ``SUMMARY`` of each block. They are bytes, as Spark handles a list number by number. A row with an empty term has all the documents, so lengths
    and counts of documents without any token too. Documents of about the same length make a block."""
    base = partition << 32
    for docs, contents, paths, *given in _chunks(batches, (1, 2)):
        n, ids = len(docs), np.array(docs, np.int64)
        fields = [_field_tokens(texts, tokens) for texts, tokens in zip((contents, paths), given, strict=True)]
        by_length = np.argsort(fields[0][2], kind="stable")
        rank = np.empty(n, np.int64)
        rank[by_length] = np.arange(n)
        ranked_ids, ranked_blocks = ids[by_length], base + np.arange(n) // block
        for field, (tokens, owner, counts) in zip(("content", "path"), fields, strict=True):
            encoded = tokens.dictionary_encode()
            at = _positions(owner)
            key = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + rank[owner]
            order = np.argsort(key, kind="stable")
            key = key[order]
            pair = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
            tf, (code, place) = np.diff(np.append(pair, len(key))), np.divmod(key[pair], n)
            lengths, changes = counts[by_length][place], np.append(True, code[1:] != code[:-1])[: len(code)]
            row = np.flatnonzero(changes)
            part = np.flatnonzero(changes | np.append(True, place[1:] // block != place[:-1] // block)[: len(code)])
            block_tf, block_length = (f.reduceat(x, part) if len(part) else x for f, x in ((np.maximum, tf), (np.minimum, lengths)))
            terms = encoded.dictionary.take(pa.array(code[row]))
            at = at[order]
            steps = np.diff(at, prepend=0).astype("<i4")
            steps[pair] = at[pair]
            postings = _records(POSTING, np.append(ranked_ids, ranked_ids[place]), np.append(np.zeros(n, np.int64), tf), np.append(counts[by_length], lengths), np.append(ranked_blocks, ranked_blocks[place]))
            columns = [  # the row of all documents stands first
                pa.array([field] * (len(row) + 1), pa.string()), pa.concat_arrays([pa.array([""], pa.string()), terms]), _packed(postings, np.append(0, n + row)),
                _packed(steps, np.append(0, pair[row])), _packed(_records(SUMMARY, ranked_blocks[place[part]], block_tf, block_length), np.append(0, np.searchsorted(part, row))),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["field", "term", "postings", "positions", "summary"])
        base += -(-n // block)


def _positions(owner: np.ndarray) -> np.ndarray:
    """Each token's place in its document, whose tokens stand together."""
    begins = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])[: len(owner)])
    return np.arange(len(owner)) - np.repeat(begins, np.diff(np.append(begins, len(owner))))


def gram_bucket(gram: str, buckets: int) -> int:
    a, b, c = map(ord, gram)
    return int(_dealt(np.array([a << 42 | b << 21 | c], np.uint64), buckets)[0])


def _dealt(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(buckets)


def grams_by_bucket(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """``doc, terms, bucket``: the distinct trigrams of ``doc, content``, a row for each bucket that has some."""
    for docs, texts in _chunks(batches, (1,)):
        c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        keys = np.zeros(len(c), np.uint64)
        if len(c) > 2:
            keys[:-2] = c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:]
        real, begin = np.ones(len(c), bool), 0
        for end in ends.tolist():
            last = max(begin, end - 2)  # what begins there crosses the text's end
            real[last:end] = False
            some = keys[begin:last]
            some.sort()
            real[begin + 1 : last] = some[1:] != some[:-1]
            begin = end
        kept = np.flatnonzero(real)
        owner, keys = np.searchsorted(ends, kept, "right"), keys[kept]
        cell = owner * buckets + _dealt(keys, buckets).astype(np.int64)
        order = np.argsort(cell.astype(np.uint16) if len(docs) * buckets <= 1 << 16 else cell, kind="stable")
        keys, cell = keys[order], cell[order]
        letters = np.stack([keys >> np.uint64(42), keys >> np.uint64(21) & np.uint64(0x1FFFFF), keys & np.uint64(0x1FFFFF)], 1).astype(np.uint32).ravel()
        widths = 1 + (letters >= 0x80).astype(np.int64) + (letters >= 0x800) + (letters >= 0x10000)
        grams = _strings(letters.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.append(0, np.cumsum(widths))[::3])
        row = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])[: len(cell)])
        rows = cell[row]
        terms = pa.ListArray.from_arrays(pa.array(np.append(row, len(cell)), pa.int32()), grams)
        yield pa.RecordBatch.from_arrays([pa.array(np.array(docs, np.int64)[rows // buckets]), terms, pa.array(rows % buckets, pa.int32())], ["doc", "terms", "bucket"])
