"""Exact removal of long repeated substrings with a logarithmic family of sparse suffix arrays.

Every window of ``length`` bytes samples one suffix: the leftmost one whose first ``gram`` bytes, its lead, have the smallest hash among the window's suffixes. Equal windows
sample the same suffix, so it is enough to index sampled suffixes, about one in (length - gram) / 2 bytes, each with the range of windows that it stands for.

A batch's suffix array is a run of its sampled suffixes in the order of their first ``SORTED`` bytes and then of a 64-bit fingerprint of the lead. Two neighbours can share a
repeated window only if their longest common prefix reaches ``gram``; such neighbours collapse into one row with their first and last occurrence, so that a run has a row for each
lead, however often it occurs, and no stored pair of neighbours has a common prefix that matters. A new batch's run is merge-scanned against the runs of the existing levels: while
the lowest levels are full, they and the new run merge into a run of the next level, which shows the matches as it merges; the levels above are scanned by a sorted merge join. Runs of a level have about the same size,
so sizes grow geometrically and a suffix is merged a logarithmic number of times.

Suffixes whose lead occurs elsewhere are candidates. Candidates whose whole context (all bytes of their windows) occurs elsewhere are repeated
altogether. For what is left, one text of each context brings its bytes, and the windows of contexts with the same lead are compared by
64-bit hashes: in sorted streams for ordinary leads, and by a search tree over ranges of windows, spread over the cluster, for leads with more than ``crowd`` contexts. Repeated windows
become byte intervals of their texts. Texts are identified by a 128-bit content hash; a text that occurs twice is repeated altogether.

Python holds a block of ``BLOCK`` bytes of text (a segment of a longer text) or of contexts at a time, whatever the batches of rows hold.

Defined cases: null text counts as empty; texts shorter than ``length`` lose nothing; matches never cross texts but may overlap within one; repeated rows are other
documents; doc_id may be null or repeated; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, hash128

LENGTH, GRAM = 400, 128
#: Bytes of a suffix that order a run, in longs of eight.
SORTED, _KEYS = 24, ("s1", "s2", "s3")
#: Bytes hashed at once; a longer text is indexed in segments.
BLOCK, SEGMENT = 1 << 17, 1 << 18
#: Bytes of contexts or kept texts in one batch that Python returns.
SLICE = 1 << 21
_RNG = np.random.default_rng(20240229)
_BYTES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 5
_POSITION = 20


def _powers(n: int, base: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    k = 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * np.uint64(pow(base, k, 1 << 64))
        k += m
    return out


_UP, _DOWN = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _prefix(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of byte values times powers of the base, and the inverse powers: the hash of [i, j) is (sums[j] - sums[i]) * inverse[i]."""
    global _UP, _DOWN
    n = len(data) + 1
    if len(_UP) < n:
        _UP, _DOWN = _powers(2 * n, _BASE), _powers(2 * n, pow(_BASE, -1, 1 << 64))
    sums = np.zeros(n, np.uint64)
    np.cumsum(_BYTES[data] * _UP[: n - 1], out=sums[1:])
    return sums, _DOWN[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def sample(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Sampled suffixes of the texts data[starts:ends]: (text, position, first window, last window, leading hash, context hash), positions
    counted from data's start."""
    n, span = len(data), length - gram + 1
    counts = np.maximum(ends - starts - length + 1, 0)
    total = int(counts.sum())
    if n < length or not total:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),) * 2
    if n > 1 << _POSITION:
        raise ValueError(f"blocks hold {1 << _POSITION} bytes at most")
    sums, inverse = _prefix(data)
    lead = _mix((sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1])
    best = (lead >> np.uint64(_POSITION) << np.uint64(_POSITION)) | np.arange(len(lead), dtype=np.uint64)
    width = 1
    while width < span:
        step = min(width, span - width)
        best = np.minimum(best[:-step], best[step:])
        width += step
    chosen = (best & np.uint64((1 << _POSITION) - 1)).astype(np.int32)  # for the window at each position
    valid = np.zeros(len(chosen) + 1, np.int8)  # windows inside one text
    np.add.at(valid, starts[counts > 0], 1)
    np.add.at(valid, (starts + counts)[counts > 0], -1)
    inside = np.cumsum(valid[:-1], dtype=np.int8) > 0
    head = np.ones(len(chosen), bool)
    head[1:] = chosen[1:] != chosen[:-1]
    head[starts[counts > 0]] = True
    first = np.flatnonzero(head & inside)
    tail = np.ones(len(chosen), bool)
    tail[:-1] = head[1:] | ~inside[1:]
    last = np.flatnonzero(tail & inside)
    pos, own = chosen[first].astype(np.int64), np.searchsorted(starts, first, side="right") - 1
    context = _mix(((sums[last + length] - sums[first]) * inverse[first]) ^ ((pos - first).astype(np.uint64) << np.uint64(40)) ^ ((last - first).astype(np.uint64) << np.uint64(20)))
    return own, pos, first, last, lead[pos], context


def order_keys(data: np.ndarray, pos: np.ndarray, gram: int) -> list[np.ndarray]:
    """The first bytes of suffixes as longs that compare as the bytes do; bytes behind the lead count as zero."""
    held = np.zeros((len(pos), SORTED), np.uint8)
    k = min(SORTED, gram)
    held[:, :k] = data[pos[:, None] + np.arange(k)]
    longs = held.view(">u8").astype(np.uint64) ^ np.uint64(1 << 63)
    return [longs[:, i].view(np.int64) if longs.flags.f_contiguous else np.ascontiguousarray(longs[:, i]).view(np.int64) for i in range(SORTED // 8)]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings without nulls, and where each row begins and ends in them, without a copy."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def entries(texts: DataFrame, length: int, gram: int, block: int = BLOCK, segment: int = SEGMENT) -> DataFrame:
    """``h1, h2, pos, lo, hi, s1, s2, s3, lead, context`` of the sampled suffixes of ``texts(h1, h2, text)``."""
    names = ["h1", "h2", "pos", "lo", "hi", *_KEYS, "lead", "context"]

    def emit(data: np.ndarray, starts: np.ndarray, rows: np.ndarray, shift: int, h1: np.ndarray, h2: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of the texts between consecutive starts (from data's begin) that stand in these rows; shift: of data in its text."""
        own, pos, lo, hi, lead, context = sample(data, starts[:-1], starts[1:], length, gram)
        if len(own):
            move = shift - starts[own]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h1[rows[own]], h2[rows[own]], pos + move, lo + move, hi + move, *order_keys(data, pos, gram), lead.view(np.int64), context.view(np.int64))], names)

    def per_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        h1, h2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        data, at = text_bytes(batch.column(2))
        row = 0
        while row < batch.num_rows:
            size = at[row + 1] - at[row]
            if size > segment + length - 1:
                for shift in range(0, size - length + 1, segment):
                    part = data[at[row] + shift : min(at[row] + shift + segment + length - 1, at[row + 1])]
                    yield from emit(part, np.array([0, len(part)]), np.array([row]), shift, h1, h2)
                row += 1
            else:
                end = max(row + 1, int(np.searchsorted(at, at[row] + block, side="right")) - 1)
                yield from emit(data[at[row] : at[end]], at[row : end + 1] - at[row], np.arange(row, end), 0, h1, h2)
                row = end

    return arrow_map(texts.select("h1", "h2", "text"), per_batch, ", ".join(f"{n} long" for n in names))


class SuffixLevels:
    """Runs ``(s1, s2, s3, lead, a, z, fresh)`` in suffix order, in levels of geometric size. a, z: the least and greatest hash of an occurrence, different if there are two or more;
    fresh: there weren't before this run was made."""

    KEY = (*_KEYS, "lead")

    def __init__(self, spark: SparkSession, scratch: Scratch) -> None:
        self.spark, self.scratch = spark, scratch
        self.levels: list[DataFrame | None] = []
        self._paths: dict[int, str] = {}
        self._matches: list[DataFrame] = []

    def _run(self, suffixes: DataFrame, name: str) -> tuple[DataFrame, str]:
        """A run of rows with ``KEY, a, z``."""
        each = suffixes.groupBy(*self.KEY).agg(F.min("a").alias("a"), F.max("z").alias("z"), F.max((F.col("a") != F.col("z")).cast("int")).alias("known"))
        fresh = ((F.col("a") != F.col("z")) & (F.col("known") == 0)).alias("fresh")
        run = self.scratch.table(each.select(*self.KEY, "a", "z", fresh).sortWithinPartitions(*self.KEY), name)
        return run, self.scratch.paths[-1]

    def add(self, batch: DataFrame) -> DataFrame:
        """Adds a batch of entries; leads that occur twice in it, or in it and in what was there, and weren't known to. May repeat a lead."""
        place = F.xxhash64("h1", "h2", "pos")
        run, path = self._run(batch.select(*self.KEY, place.alias("a"), place.alias("z")), "run")
        level, merging = 0, [run]
        while level < len(self.levels) and self.levels[level] is not None:
            merging.append(self.levels[level])
            level += 1
        found = [run.join(other.select(*self.KEY), [*self.KEY], "left_semi").select("lead") for other in self.levels[level + 1 :] if other is not None]
        used = [self._paths.pop(k) for k in range(level)]
        if level:
            union = merging[0]
            for other in merging[1:]:
                union = union.unionByName(other)
            merged, merged_path = self._run(union, "merged")
            found.append(merged.where("fresh").select("lead"))
            used.append(path)
        else:
            merged, merged_path = run, path
        found.append(run.where("fresh").select("lead"))
        matches = found[0]
        for x in found[1:]:
            matches = matches.unionByName(x)
        matches = self.scratch.table(matches, "matches")
        self._matches.append(matches)
        self.levels[:level] = [None] * level
        self.levels += [None] * (level + 1 - len(self.levels))
        self.levels[level], self._paths[level] = merged, merged_path
        for x in used:  # merged away, and read by nothing any more
            self.scratch.drop(x)
        return matches

    def repeated(self) -> DataFrame:
        """Leads with two occurrences or more in all that was added."""
        out = self._matches[0] if self._matches else self.spark.createDataFrame([], "lead long")
        for x in self._matches[1:]:
            out = out.unionByName(x)
        return out.distinct()


def _windows(contexts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, window, hash) of all windows of contexts."""
    sizes = np.array([len(c) for c in contexts])
    starts, n = np.cumsum(sizes) - sizes, sizes - length + 1
    sums, inverse = _prefix(np.frombuffer(b"".join(contexts), np.uint8))
    row = np.repeat(np.arange(len(contexts)), n)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = starts[row] + offset
    return row, offset, _mix((sums[at + length] - sums[at]) * inverse[at])


def _runs(flags_row: np.ndarray, flags_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of consecutive windows of a row: (row, first, last); input sorted by row and window."""
    head = np.ones(len(flags_row), bool)
    head[1:] = (flags_row[1:] != flags_row[:-1]) | (flags_at[1:] != flags_at[:-1] + 1)
    first = np.flatnonzero(head)
    last = np.concatenate([first[1:], [len(flags_row)]]) - 1
    return flags_row[first], flags_at[first], flags_at[last]


def compare_streams(contexts: DataFrame, length: int) -> DataFrame:
    """``lead, context, first, last``: runs of windows that another context of the same leading hash holds. contexts: lead, context, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []

        def flush(rows: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
            if not rows:
                return
            lead, context = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
            row, offset, value = _windows([r[2] for r in rows], length)
            value = _mix(value ^ lead.view(np.uint64)[row])
            order = np.argsort(value, kind="stable")
            same = value[order][1:] == value[order][:-1]
            twice = np.zeros(len(value), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            r, a, z = _runs(row[twice], offset[twice])
            if len(r):
                yield pa.RecordBatch.from_arrays([pa.array(lead[r]), pa.array(context[r]), pa.array(a), pa.array(z)], ["lead", "context", "first", "last"])

        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if held and row[:2] == held[-1][:2]:
                    continue  # brought by an equal row
                if len(held) >= 1000 and row[0] != held[-1][0]:
                    yield from flush(held)
                    held = []
                held.append(row)
        yield from flush(held)

    return contexts.select("lead", "context", "bytes").repartition("lead").sortWithinPartitions("lead", "context").mapInArrow(run, "lead long, context long, first long, last long")


def _hash_slices(joined: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums, inverse = _prefix(joined)
    return _mix((sums[ends] - sums[starts]) * inverse[starts] ^ (ends - starts).astype(np.uint64))


def compare_spread(contexts: DataFrame, scratch: Scratch, length: int, gram: int) -> list[DataFrame]:
    """The same for crowded leading hashes, by a search tree over the windows' offsets from the suffix.

    A piece of a context is a range of its windows. On each level pieces are cut at a grid of offsets; pieces of a cell meet if the bytes that all windows of the cell
    share (its core) are equal. Pieces with equal bytes are repeated altogether; those that differ but share a core go to the next, finer level, one
    representative each. On the last level a piece is a window. A context has a few pieces a level, however crowded its leading hash is.
    """
    span, out = length - gram + 1, []
    fields = "lead long, context long, base long, offset long, cell long, n long, core long, whole long, bytes binary"
    pieces = contexts.select("lead", "context", F.lit(0).cast("long").alias("base"), (F.lit(span - 1) - F.col("shift")).alias("offset"), "bytes")
    for width in (35, 6, 1):

        def cut(batch: pa.RecordBatch, width: int = width) -> Iterator[pa.RecordBatch]:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                raw = part.column(4).to_pylist()
                base, offset = part.column(2).to_numpy(), part.column(3).to_numpy()
                size = np.array([len(x) for x in raw])
                origin, n = np.cumsum(size) - size, size - length + 1
                c0, c1 = offset // width, (offset + n - 1) // width
                row = np.repeat(np.arange(len(raw)), c1 - c0 + 1)
                cell = np.arange(len(row)) - np.repeat(np.cumsum(c1 - c0 + 1) - (c1 - c0 + 1), c1 - c0 + 1) + c0[row]
                lo, hi = np.maximum(cell * width, offset[row]), np.minimum((cell + 1) * width, (offset + n)[row]) - 1
                joined = np.frombuffer(b"".join(raw), np.uint8)
                first = origin[row] + lo - offset[row]
                core = _hash_slices(joined, origin[row] + (cell + 1) * width - 1 - offset[row], origin[row] + cell * width - offset[row] + length)
                whole = _mix(_hash_slices(joined, first, first + hi - lo + length) ^ (lo.astype(np.uint64) << np.uint64(32)))
                take, data = pa.array(row), joined.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), pa.array(base[row] + lo - offset[row]), pa.array(lo), pa.array(cell), pa.array(hi - lo + 1), pa.array(core.view(np.int64)), pa.array(whole.view(np.int64)),
                     pa.array([data[a:b] for a, b in zip(first.tolist(), (first + hi - lo + length).tolist(), strict=True)], pa.binary())],
                    ["lead", "context", "base", "offset", "cell", "n", "core", "whole", "bytes"],
                )

        rows = scratch.table(arrow_map(pieces, cut, fields), "pieces")
        key = ["lead", "cell", "core"]
        equal = rows.groupBy(*key, "whole").agg(F.min("context").alias("one"), F.max("context").alias("other"))
        equal = scratch.table(equal, "equal")
        hit = rows.join(equal.where("one <> other").select(*key, "whole"), [*key, "whole"], "left_semi")
        out.append(hit.select("lead", "context", F.col("base").alias("first"), (F.col("base") + F.col("n") - 1).alias("last")))
        if width == 1:
            break
        open_keys = equal.groupBy(*key).agg(F.count(F.lit(1)).alias("ways")).where("ways > 1").select(*key)
        on = equal.join(open_keys, key, "left_semi").select(*key, "whole", F.col("one").alias("context"))
        pieces = rows.join(on, [*key, "whole", "context"], "left_semi").select("lead", "context", "base", "offset", "bytes")
    return out


def remove_repeats(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, arrivals: int = 4, crowd: int = 200, block: int = BLOCK, segment: int = SEGMENT) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept`` (binary). The documents arrive in ``arrivals`` batches, one after the other."""
    spark, scratch = documents.sparkSession, Scratch(documents.sparkSession, "suffix")
    filled = F.coalesce(F.col(text).cast("string"), F.lit(""))
    h1, h2 = hash128(filled)
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), filled.alias("text"), h1.alias("h1"), h2.alias("h2"))
    long_texts = docs.where(F.octet_length("text") >= length)
    found = scratch.table(entries(long_texts, length, gram, block, segment).withColumn("batch", F.pmod("h1", F.lit(arrivals)).cast("int")), "entries", ["batch"])
    family = SuffixLevels(spark, scratch)
    for b in range(arrivals):
        family.add(found.where(F.col("batch") == b))
    candidates = scratch.table(found.drop("batch", *_KEYS).join(family.repeated(), "lead", "left_semi"), "candidates")
    occurrence = F.struct("h1", "h2", "pos", "lo", "hi")
    place = F.struct("h1", "h2", "pos")
    contexts = scratch.table(candidates.groupBy("lead", "context").agg(F.min(place).alias("a"), F.max(place).alias("z"), F.min(occurrence).alias("at")).select("lead", "context", (F.col("a") != F.col("z")).alias("whole"), "at"), "contexts")
    crowds = scratch.table(contexts.groupBy("lead").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("whole"), 0).otherwise(1)).alias("open")).where("n > 1 and open = 1").select("lead", "n"), "crowds")
    wanted = contexts.join(crowds, "lead").select("at.h1", "at.h2", F.struct("lead", "context", "n", (F.col("at.pos") - F.col("at.lo")).alias("shift"), "at.lo", "at.hi").alias("want")).groupBy("h1", "h2").agg(F.collect_list("want").alias("wants"))
    texts = scratch.table(long_texts.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies"), F.max(F.octet_length("text")).alias("n")), "texts")

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, at = text_bytes(batch.column(0))
        wants = batch.column(1)
        first, fields = wants.offsets.to_numpy(), {n: wants.values.field(n).to_numpy() for n in ("lead", "context", "n", "shift", "lo", "hi")}
        row = np.repeat(np.arange(batch.num_rows), np.diff(first))
        fields = {n: x[first[0] : first[-1]] for n, x in fields.items()}
        a, z = at[row] + fields["lo"], at[row] + fields["hi"] + length
        ends = np.cumsum(z - a)
        w = 0
        while w < len(row):
            e = max(w + 1, int(np.searchsorted(ends, (ends[w - 1] if w else 0) + SLICE, side="right")))
            raw = pa.array([data[x:y].tobytes() for x, y in zip(a[w:e].tolist(), z[w:e].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(pa.array(fields[n][w:e]) for n in ("lead", "context", "n", "shift")), raw], ["lead", "context", "n", "shift", "bytes"])
            w = e

    # One row of each text brings the bytes; copies fall together before the shuffle.
    with_text = long_texts.groupBy("h1", "h2").agg(F.first("text").alias("text")).join(wanted, ["h1", "h2"]).select("text", "wants")
    brought = scratch.table(arrow_map(with_text, cut, "lead long, context long, n long, shift long, bytes binary"), "bytes")
    hits = compare_streams(brought.where(F.col("n") <= crowd), length)
    crowded = brought.where(F.col("n") > crowd)
    for found_there in [] if crowded.isEmpty() else compare_spread(crowded, scratch, length, gram):
        hits = hits.unionByName(found_there)
    part = scratch.table(hits.join(contexts.where("not whole").select("lead", "context"), ["lead", "context"], "left_semi"), "hits")
    spans = candidates.join(part, ["lead", "context"]).select("h1", "h2", (F.col("lo") + F.col("first")).alias("s"), (F.col("lo") + F.col("last") + length).alias("e"))
    spans = spans.unionByName(candidates.join(contexts.where("whole").select("lead", "context"), ["lead", "context"], "left_semi").select("h1", "h2", F.col("lo").alias("s"), (F.col("hi") + length).alias("e")))
    spans = spans.unionByName(texts.where("copies > 1").select("h1", "h2", F.lit(0).cast("long").alias("s"), F.col("n").cast("long").alias("e")))
    removed = scratch.table(spans.groupBy("h1", "h2").agg(F.collect_set(F.struct("s", "e")).alias("spans")), "removed")

    def apply(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, at = text_bytes(batch.column(1))
        ids, spans = batch.column(0), batch.column(2)
        out: tuple[list, ...] = ([], [], [], [])
        since = size = 0
        for i in range(batch.num_rows):
            raw = data[at[i] : at[i + 1]]
            pieces, end, runs = [], 0, 0
            for s, e in sorted((x["s"], x["e"]) for x in spans[i].as_py() or ()):
                if s > end or not runs:
                    pieces.append(raw[end:s].tobytes())
                    runs, end = runs + 1, e
                else:
                    end = max(end, e)
            pieces.append(raw[end:].tobytes())
            rest = b"".join(pieces)
            for column, value in zip(out, (len(raw), len(raw) - len(rest), runs, rest), strict=True):
                column.append(value)
            size += len(rest)
            if size >= SLICE or i == batch.num_rows - 1:
                yield pa.RecordBatch.from_arrays([ids.slice(since, i + 1 - since), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])
                out, since, size = ([], [], [], []), i + 1, 0

    final = docs.join(removed, ["h1", "h2"], "left").select("doc_id", "text", "spans")
    return arrow_map(final, apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
