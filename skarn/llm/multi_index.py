"""Approximate nearest neighbours with an inverted multi-index.

A vector's two halves are quantised separately, each with its own k-means codebook, so k centroids a half make k * k cells. A query scores
the centroids of both halves and walks the pairs in order of their summed score with a heap (each pair's successors are the next centroid
of one half), down to the summed score below which too few of its nearest are to be expected; the entries of the cells it has met are reranked by the exact inner product in double precision.

How far a query walks follows from the data, not from their number: an entry's score differs from its cell's by what the query makes of the entry's residual, about normally with the residuals' variance, so the cells' counts
and scores tell how many entries beyond any score to expect in each. The walk ends where the cells that are left hold less than ``1 - recall`` of the expected nearest. Where the vectors have clusters that
is a few cells, where they have none it is a third or half of all.
Codebooks are fitted on a bounded sample chosen by hash; every row is indexed.

Entries are grouped by the first half's centroid and dealt into blocks of bounded size, so a group that holds a third of all rows (say copies of a
vector) is many tasks; the queries are a stated set, compared block by block, and only each block's nearest leave a task.

Defined cases: vectors that are null, zero, hold null or non-finite components, or are of another length than most take no part; a null id
takes no part; a query finds every other id, copies too; ties go to the smaller id; fewer candidates give fewer rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_map

#: Rows of the codebooks' sample, entries of a block, queries of a block.
SAMPLE, BLOCK_ROWS, QUERY_ROWS = 20_000, 8192, 32_768


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Plain k-means; an empty cluster takes the point that is worst served."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near, far = nearest(x, centres)
        sums, n = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, x)
        full = n > 0
        centres[full] = sums[full] / n[full, None]
        for c, i in zip(np.flatnonzero(~full), np.argsort(-far), strict=False):
            centres[c] = x[i]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of, and squared distance to, each row's nearest centre."""
    near, far = np.empty(len(x), np.int64), np.empty(len(x))
    for at in range(0, len(x), 4096):
        d = (x[at : at + 4096] ** 2).sum(1)[:, None] - 2 * x[at : at + 4096] @ centres.T + (centres**2).sum(1)
        near[at : at + 4096] = d.argmin(1)
        far[at : at + 4096] = d.min(1)
    return near, far


def walk(first: np.ndarray, second: np.ndarray, held: np.ndarray, floor: float) -> list[tuple[int, int]]:
    """Pairs of centroids in order of their summed score, down to ``floor``; empty cells are passed over."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    heap, seen, out = [(-(first[a[0]] + second[b[0]]), 0, 0)], {(0, 0)}, []
    while heap:
        score, i, j = heapq.heappop(heap)
        if -score < floor:
            break
        if held[a[i], b[j]]:
            out.append((int(a[i]), int(b[j])))
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (-(first[a[x]] + second[b[y]]), x, y))
    return out


_erfc = np.vectorize(math.erfc, otypes=[float])
#: The upper tail of the normal distribution, tabled.
_TAIL_AT = np.linspace(-9.0, 9.0, 3601)
_TAIL = 0.5 * _erfc(_TAIL_AT / math.sqrt(2.0))


def floor_of(first: np.ndarray, second: np.ndarray, held: np.ndarray, spread: float, k: int, recall: float, bins: int = 256) -> float:
    """The summed score down to which cells hold ``recall`` of the k entries nearest to be expected. spread: the standard deviation of an entry's score about its cell's."""
    scores = (first[:, None] + second[None, :]).ravel()
    n, total = held.ravel().astype(np.float64), float(held.sum())
    low, high = float(scores.min()), float(scores.max())
    if total <= k or high - low < 1e-12:
        return low
    at = np.minimum(((scores - low) * (bins / (high - low))).astype(np.int64), bins - 1)
    count = np.bincount(at, n, minlength=bins)
    edge = low + (high - low) / bins * np.arange(bins)
    centre = edge + (high - low) / bins / 2
    tail = lambda t: count * np.interp((t - centre) / max(spread, 1e-12), _TAIL_AT, _TAIL, left=1.0, right=0.0)
    under, over = low - 9 * spread, high + 9 * spread
    for _ in range(40):  # the score that k entries are expected to exceed
        middle = (under + over) / 2
        under, over = (middle, over) if tail(middle).sum() > k else (under, middle)
    expected = tail(under)
    missed = np.cumsum(expected)  # by a walk that ends above this bin
    last = int(np.searchsorted(missed, (1.0 - recall) * expected.sum(), side="right"))
    return float(edge[min(last, bins - 1)])


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return np.asarray(column.flatten()).reshape(len(column), -1).astype(np.float64)


def _best(entries: np.ndarray, ids: np.ndarray, cells: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, visited: np.ndarray, k: int) -> tuple[list, list, list]:
    """Each query's k best entries among the cells it visits: (query, entry, exact score)."""
    out: tuple[list, list, list] = ([], [], [])
    for at in range(0, len(queries), 256):
        rough = queries[at : at + 256] @ entries.T
        rough[~visited[at : at + 256][:, cells]] = -np.inf
        rough[query_ids[at : at + 256, None] == ids[None, :]] = -np.inf
        floor = np.partition(rough, -k, axis=1)[:, -k] if rough.shape[1] > k else rough.min(axis=1)
        slack = 1e-9 * (1.0 + np.abs(np.where(np.isfinite(floor), floor, 0.0)))
        for r in range(len(rough)):
            near = np.flatnonzero((rough[r] >= floor[r] - slack[r]) & np.isfinite(rough[r]))
            # Summed row by row, so that equal vectors have equal scores.
            exact = (entries[near] * queries[at + r]).sum(axis=1)
            order = np.lexsort((ids[near], -exact))[:k]
            out[0].extend([int(query_ids[at + r])] * len(order))
            out[1].extend(ids[near][order].tolist())
            out[2].extend(exact[order].tolist())
    return out


def usable(vector: Column) -> Column:
    """Neither null nor zero nor with null or non-finite components."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def neighbours(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", recall: float = 0.97, most: int = 128) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row that ``queries`` holds of, its k largest inner products among all other rows.
    recall: the share of them that the walk is to find in expectation; most: centroids a half, at most."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "index")
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), queries.alias("is_query")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    empty = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], empty)
    width, total = lengths[0]["n"], lengths[0]["count"]
    rows = rows.where(F.size("v") == width)
    half, size = max(1, width // 2), min(most, max(4, round(1.25 * total**0.5)))
    sample = rows.select("v").orderBy(F.xxhash64(F.lit("codebook"), F.col("vec_id")), "vec_id").limit(SAMPLE).collect()
    known = np.array([r["v"] for r in sample])
    books = (kmeans(known[:, :half], size), kmeans(known[:, half:], size) if half < width else np.zeros((1, 0)))
    across = len(books[1])
    # The sample's residuals, an independent part for each half.
    rest = [float(nearest(x, c)[1].mean()) / max(1, x.shape[1]) if x.shape[1] else 0.0 for x, c in ((known[:, :half], books[0]), (known[:, half:], books[1]))]

    def assign(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = _matrix(batch.column(1))
        i = nearest(x[:, :half], books[0])[0]
        j = nearest(x[:, half:], books[1])[0] if half < width else np.zeros(len(x), np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(i), pa.array(j)], ["vec_id", "v", "is_query", "i", "j"])

    index = scratch.table(arrow_map(rows, assign, "vec_id long, v array<double>, is_query boolean, i long, j long"), "entries")
    held = np.zeros((len(books[0]), across), np.int64)
    for r in index.groupBy("i", "j").count().collect():  # most * most cells at most
        held[r["i"], r["j"]] = r["count"]
    salts = np.maximum(1, -(-held.sum(axis=1) // BLOCK_ROWS))
    asked = index.where("is_query")
    parts = max(1, -(-asked.count() // QUERY_ROWS))

    def visit(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x, ids = _matrix(batch.column(1)), batch.column(0).to_numpy()
        first, second = x[:, :half] @ books[0].T, x[:, half:] @ books[1].T if half < width else np.zeros((len(x), 1))
        cells, salt, who, lists = [], [], [], []
        for q in range(len(x)):
            by: dict[int, list[int]] = {}
            spread = math.sqrt(float((x[q, :half] ** 2).sum()) * rest[0] + float((x[q, half:] ** 2).sum()) * rest[1])
            for a, b in walk(first[q], second[q], held, floor_of(first[q], second[q], held, spread, k, recall)):
                by.setdefault(a, []).append(b)
            for a, bs in by.items():
                for s in range(salts[a]):
                    cells.append(a)
                    salt.append(s)
                    who.append(q)
                    lists.append(bs)
        for at in range(0, len(who), 20_000):
            part = slice(at, at + 20_000)
            take = pa.array(who[part], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(cells[part], pa.int64()), pa.array(salt[part], pa.int64()), pa.array(ids[np.array(who[part], int)] % parts, pa.int64()), batch.column(0).take(take), batch.column(1).take(take), pa.array(lists[part], pa.list_(pa.int64()))], ["i", "salt", "part", "query_id", "q", "js"])

    visits = arrow_map(asked.select("vec_id", "v"), visit, "i long, salt long, part long, query_id long, q array<double>, js array<long>")
    salted = F.element_at(F.array(*[F.lit(int(s)) for s in salts]), (F.col("i") + 1).cast("int"))
    entries = index.select("vec_id", "v", "i", "j", F.pmod(F.xxhash64(F.lit("salt"), F.col("vec_id")), salted).alias("salt")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    def rerank(own: pa.Table, asking: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if own.num_rows and asking.num_rows:
            visited = np.zeros((asking.num_rows, across), bool)
            for r, js in enumerate(asking.column("js").to_pylist()):
                visited[r, js] = True
            out = _best(_matrix(own.column("v")), own.column("vec_id").to_numpy(), own.column("j").to_numpy(), _matrix(asking.column("q")), asking.column("query_id").to_numpy(), visited, k)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    found = entries.groupBy("i", "salt", "part").cogroup(visits.groupBy("i", "salt", "part")).applyInArrow(rerank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
