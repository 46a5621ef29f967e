"""Byte-level BPE encoding and decoding by a monoid tree reduction.

``encode`` is a homomorphism from texts under concatenation to encodings under :func:`join`: a text is halved down to leaves, leaves are encoded by
themselves, and neighbours are joined up the tree. A join encodes a window around the boundary anew, from a token start on its left to a token
end on its right, and grows it until both edges hold, so that the tokens outside are provably those of the whole text:

* The pattern's matches depend on nothing before them and look at two characters behind them at most, so where a match ends before that the rest is the same.
* A match holds white space at its beginning only (or is nothing else), so a cut before white space and behind anything else lies between matches.
* Inside a match, tokens are those of the whole match if each two neighbours are: greedy merging takes the lowest rank, leftmost first, so the first
  merge across a border would also be taken among the two tokens alone. An edge therefore holds if the two tokens at it encode to themselves.

Edges behind white space or beside an apostrophe, where what follows may change a match that ends there, are never taken. Decoding concatenates the tokens' bytes up the same tree.

Texts above ``block`` bytes are split over tasks, block by block, and joined by row. The ranks (a vocabulary file, a megabyte or so) are read on the driver and broadcast.
Every token must be the encoding of its own bytes, as in every trained vocabulary (:meth:`Codec.unreachable` tells).

Defined cases: null and empty text have no tokens; special tokens' strings are ordinary text; doc_id may be null or repeated, each row is encoded
by itself; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import accumulate
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, ship

#: Characters of a leaf; bytes of a text that one task encodes; tokens on each side of a boundary that the first window takes.
LEAF, BLOCK, WINDOW = 2048, 1 << 20, 4
#: Unicode's White_Space, which the pattern's \s means (fixed values).
_SPACE = tuple(chr(c).encode() for c in [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
#: A match looks at this many bytes (two characters) behind its end at most.
_AHEAD = 8


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks from a file of base64 tokens and numbers."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, Path(path).read_bytes().splitlines())}


class Codec:
    """Encodings ``(bytes, ids)`` of texts and their monoid operation."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF) -> None:
        import tiktoken

        self.base = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.piece = self.base._core_bpe.encode_single_piece
        self.ranks, self.leaf, self.known = ranks, leaf, {}
        self.token = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token
        self.size = np.array([len(t) for t in self.token], np.int64)

    def unreachable(self) -> list[bytes]:
        """Tokens that greedy merging of their own bytes doesn't give; must be empty."""
        return [t for t in self.ranks if len(t) > 1 and not any(t[:i] in self.ranks and t[i:] in self.ranks and self._merged(t, i) for i in range(1, len(t)))]

    def _merged(self, token: bytes, cut: int) -> bool:
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                return False
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return len(parts[0]) == cut

    def _apart(self, left: int, right: int) -> bool:
        """Whether the two tokens encode to themselves when they meet inside a match."""
        key = (left, right)
        if key not in self.known:
            if len(self.known) > 1_000_000:
                self.known.clear()
            self.known[key] = self.piece(self.token[left] + self.token[right]) == [left, right]
        return self.known[key]

    def _holds(self, around: bytes, at: int, left: int, right: int) -> bool:
        """Whether a window may begin or end at ``at`` in ``around``, between tokens left and right."""
        if around[at] & 0xC0 == 0x80 or b"'" in around[max(at - 2, 0) : at + 1]:  # inside a character, or beside an apostrophe
            return False
        before = around[max(at - 4, 0) : at]
        if before.endswith(_SPACE):
            return False
        return around.startswith(_SPACE, at) or self._apart(left, right)

    def join(self, x: tuple[bytes, list[int]], y: tuple[bytes, list[int]]) -> tuple[bytes, list[int]]:
        """The encoding of the concatenation of two encoded texts."""
        (xb, xi), (yb, yi) = x, y
        if not xi or not yi:
            return xb + yb, xi + yi
        both, border = xb + yb, len(xb)
        token = self.token
        m = n = WINDOW  # tokens of the left and the right side in the window
        while True:
            m, n = min(m, len(xi)), min(n, len(yi))
            a = border - sum(len(token[i]) for i in xi[len(xi) - m :])
            b = border + sum(len(token[i]) for i in yi[:n])
            # Move edges out to where they may stand at all, before anything is encoded.
            while m < len(xi) and (border - a < _AHEAD or both[a] & 0xC0 == 0x80):
                m += 1
                a -= len(token[xi[-m]])
            while n < len(yi) and both[b] & 0xC0 == 0x80:
                b += len(token[yi[n]])
                n += 1
            new = self.base.encode_ordinary(both[a:b].decode())
            left = m == len(xi) or self._holds(both, a, xi[-m - 1], new[0])
            right = n == len(yi) or self._holds(both, b, new[-1], yi[n])
            if left and right:
                return both, xi[: len(xi) - m] + new + yi[n:]
            m, n = m if left else 2 * m, n if right else 2 * n

    def tree(self, parts: list[tuple[bytes, list[int]]]) -> tuple[bytes, list[int]]:
        """Neighbours joined level by level."""
        while len(parts) > 1:
            pairs = [self.join(parts[i], parts[i + 1]) for i in range(0, len(parts) - 1, 2)]
            parts = pairs + parts[2 * len(pairs) :]
        return parts[0]

    def encode(self, text: str) -> tuple[bytes, list[int]]:
        if not text:
            return b"", []
        leaves = [text[i : i + self.leaf] for i in range(0, len(text), self.leaf)]
        return self.tree([(leaf.encode(), self.base.encode_ordinary(leaf)) for leaf in leaves])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids: leaves' bytes, concatenated level by level."""
        parts = [b"".join(map(self.token.__getitem__, ids[i : i + self.leaf].tolist())) for i in range(0, len(ids), self.leaf)] or [b""]
        while len(parts) > 1:
            parts = [b"".join(parts[i : i + 2]) for i in range(0, len(parts), 2)]
        return parts[0]


_CODECS: dict[tuple, Codec] = {}


def _codec(ranks, pattern: str, leaf: int) -> Codec:
    """One for each worker and broadcast."""
    key = (ranks.id if hasattr(ranks, "id") else id(ranks), pattern, leaf)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(ranks.value, pattern, leaf)
    return _CODECS[key]


def _lists(ids: list[list[int]]) -> pa.Array:
    offsets = np.zeros(len(ids) + 1, np.int32)
    offsets[1:] = list(accumulate(map(len, ids)))
    flat = np.empty(offsets[-1], np.int32)
    for i, x in enumerate(ids):
        flat[offsets[i] : offsets[i + 1]] = x
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _blocks(text: str, block: int) -> list[str]:
    """The text in pieces of at most ``block`` characters."""
    return [text[i : i + block] for i in range(0, len(text), block)]


def encode(documents: DataFrame, ranks: dict[bytes, int], pattern: str, doc_id: str = "doc_id", text: str = "text", leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """``doc_id, ids array<int>`` of whole texts."""
    ship(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(ranks)
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    whole, long = F.octet_length("text") <= block, F.octet_length("text") > block

    def short(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, pattern, leaf)
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield pa.RecordBatch.from_arrays([part.column(0), _lists([codec.encode(t.as_py())[1] for t in part.column(1)])], ["doc_id", "ids"])

    def split(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row, i, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for k, piece in enumerate(_blocks(t, block)):
                yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([i], pa.int64()), pa.array([k]), pa.array([piece])], ["row", "doc_id", "block", "text"])

    def leaves(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, pattern, leaf)
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            raw, ids = codec.encode(row.column(3)[0].as_py())
            yield pa.RecordBatch.from_arrays([*row.columns[:3], pa.array([raw], pa.binary()), _lists([ids])], ["row", "doc_id", "block", "raw", "ids"])

    def joined(group: pa.Table) -> pa.Table:
        codec = _codec(shared, pattern, leaf)
        order = np.argsort(group["block"].to_numpy())
        _, ids = codec.tree([(group["raw"][k].as_py(), group["ids"][k].values.to_numpy().tolist()) for k in order.tolist()])
        return pa.table({"doc_id": group["doc_id"].slice(0, 1), "ids": _lists([ids])})

    pieces = arrow_map(docs.where(long).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), split, "row long, doc_id long, block long, text string")
    encoded = arrow_map(pieces.repartition("row", "block"), leaves, "row long, doc_id long, block long, raw binary, ids array<int>")
    return arrow_map(docs.where(whole), short, "doc_id long, ids array<int>").unionByName(encoded.groupBy("row").applyInArrow(joined, "doc_id long, ids array<int>"))


def decode(encoded: DataFrame, ranks: dict[bytes, int], leaf: int = LEAF) -> DataFrame:
    """encoded with ``decoded binary``, the bytes of its ``ids``; unknown ids raise."""
    ship(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)
    table: dict[int, Codec] = {}

    def per_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not table:
            table[0] = _Bytes(shared.value, leaf)
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            found = [table[0].decode(x.values.to_numpy()) if x.is_valid else None for x in part.column("ids")]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.binary())], [*part.schema.names, "decoded"])

    return arrow_map(encoded, per_batch, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in encoded.schema)}, decoded binary")


class _Bytes:
    """The decoding half of a codec, without its tables for merging."""

    decode = Codec.decode

    def __init__(self, ranks: dict[bytes, int], leaf: int) -> None:
        self.leaf, self.token = leaf, [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token
