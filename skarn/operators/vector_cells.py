"""Nearest vectors and pairs above a similarity over cells of angles, exact, without comparing everything with everything.

A bounded sample of the vectors are pivots; each vector lies in the cell of its nearest pivot, and a cell knows its radius (the largest angle to the pivot). Angles are
a metric, so a vector at angle d from a pivot is at least d - radius from all of the cell, and at least ``d - own angle`` from each vector in it. A search first scans each
query's nearest cells, which bounds its k-th angle, and then only cells within reach of that bound; a join sends a vector to the cells within reach of the threshold.
Where vectors cluster, most cells are out of reach; where they don't, more are read, but the result is the same. ``visit`` caps the cells of a query, for an approximate answer.

An index is a table in cell order, so that a reader skips other cells; queries come in blocks of bounded size, and no vector is shuffled to a query. The join takes
neighbouring cells as groups of a tile's rows; cells of any size are split into tiles, so no task holds more than two tiles.

Defined cases: vectors that are null, zero, not finite or of another length than the index take no part; neither do null ids; ids may repeat, rows count by themselves. Scores are
rounded to 12 decimals before they are compared, ties go to the smaller id; an empty table has no answers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import finite, norm

#: Most pivots; bytes of queries that are asked together; candidates that a task keeps before it reduces them; queries and candidates that are compared at once; rows of a tile;
#: decimals of a score.
PIVOTS, QUERY_BYTES, KEPT, ASKED, OFFERED, TILE, DECIMALS = 4096, 8 << 20, 1 << 17, 512, 1024, 16384, 12
#: What rounding may add to an angle.
SLACK = 1e-7


def _unit(vectors: DataFrame, size: int | None, id_col: str, vector: str) -> DataFrame:
    """``id, v`` of usable vectors, of unit length."""
    v = F.transform(vector, lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    rows = rows.where((F.size("v") == size) if size else (F.size("v") > 0)).where(finite(F.col("v")) & (norm(F.col("v")) > 0))
    return rows.select("id", F.transform("v", lambda x: x / norm(F.col("v"))).alias("v"))


def _matrix(column: pa.ListArray, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _groups(pivots: np.ndarray, count: np.ndarray, most: int) -> np.ndarray:
    """The group of each cell: neighbouring cells together have ``most`` rows at most; a larger cell is a group of its own."""
    order, open_ = [], [np.arange(len(pivots))]
    while open_:
        some = open_.pop()
        if len(some) < 3:
            order.extend(some.tolist())
            continue
        some = some[np.argsort(pivots[some][:, pivots[some].var(axis=0).argmax()], kind="stable")]
        open_ += [some[len(some) // 2 :], some[: len(some) // 2]]
    group, rows, n = np.zeros(len(pivots), np.int32), 0, 0
    for cell in order:
        if rows and rows + count[cell] > most:
            n, rows = n + 1, 0
        group[cell], rows = n, rows + count[cell]
    return group


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def _nearest_of(batches: Iterator[pa.RecordBatch], q: np.ndarray, visit: np.ndarray, bound: np.ndarray, pivots: np.ndarray, k: int) -> pa.RecordBatch:
    """``query, id, similarity``: the k best of the rows (cell, angle, id, v) for each query. Besides a batch of rows and the queries it holds ``ASKED`` by ``OFFERED`` scores
    and some ``KEPT`` candidates, whatever the cells' sizes."""
    kept, held, waiting = [np.zeros((0, 2), np.int64)], [np.zeros(0)], 0

    def best() -> None:
        pairs, score = np.concatenate(kept), np.concatenate(held)
        order = np.lexsort((pairs[:, 1], -score, pairs[:, 0]))
        pairs, score = pairs[order], score[order]
        first = np.searchsorted(pairs[:, 0], pairs[:, 0])
        some = np.arange(len(pairs)) - first < k
        kept[:], held[:] = [pairs[some]], [score[some]]

    for batch in batches:
        cell, angle, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        v = _matrix(batch.column(3), q.shape[1])
        for c in np.unique(cell).tolist():
            asking, offered = np.flatnonzero(visit[:, c]), np.flatnonzero(cell == c)
            for i, j in ((i, j) for i in range(0, len(asking), ASKED) for j in range(0, len(offered), OFFERED)):
                some, own = asking[i : i + ASKED], offered[j : j + OFFERED]
                near = np.abs(_angles(q[some] @ pivots[c])[:, None] - angle[own][None, :]) <= bound[some][:, None]
                score = np.where(near, np.round(q[some] @ v[own].T, DECIMALS), -2.0)
                least = np.partition(score, max(0, len(own) - k), axis=1)[:, max(0, len(own) - k)]
                x, y = np.nonzero((score >= least[:, None]) & (score > -2.0))
                kept.append(np.stack([some[x], ids[own[y]]], axis=1))
                held.append(score[x, y])
                waiting += len(x)
                if waiting > KEPT:
                    best()
                    waiting = 0
    best()
    return pa.RecordBatch.from_arrays([pa.array(kept[0][:, 0]), pa.array(kept[0][:, 1]), pa.array(held[0])], ["query", "id", "similarity"])


@dataclass
class Cells:
    """``cell, angle, id, v`` in cell order below ``path``; pivots, and the radius and rows of each cell, are bounded by ``PIVOTS``."""

    spark: SparkSession
    path: str
    pivots: np.ndarray
    radius: np.ndarray
    count: np.ndarray

    @classmethod
    def build(cls, vectors: DataFrame, path: str, id_col: str = "id", vector: str = "embedding", most: int = PIVOTS) -> Cells | None:
        """Writes an index; its length is that of the vector with the smallest hash of its id. None for a table without usable vectors."""
        spark, usable = vectors.sparkSession, _unit(vectors, None, id_col, vector)
        order = [F.xxhash64("id"), F.col("id"), F.col("v")]
        first = usable.orderBy(*order).limit(1).collect()
        if not first:
            return None
        rows = _unit(vectors, size := len(first[0]["v"]), id_col, vector)
        wanted = max(1, min(most, math.isqrt(rows.count())))
        sample = rows.orderBy(*order).limit(wanted).collect()  # ``most`` vectors at most
        pivots = np.unique(np.array([r["v"] for r in sample]), axis=0)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    cosines = _matrix(part.column(1), size) @ pivots.T
                    cell = cosines.argmax(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(_angles(cosines[np.arange(len(cell)), cell])), *part.columns], ["cell", "angle", "id", "v"])

        schema = "cell int, angle double, id long, v array<double>"
        rows.mapInArrow(assign, schema).repartitionByRange("cell", "angle", F.xxhash64("id")).sortWithinPartitions("cell", "angle").write.option("compression", "zstd").parquet(path)
        cells = cls(spark, path, pivots, np.zeros(len(pivots)), np.zeros(len(pivots), np.int64))
        for r in cells.rows().groupBy("cell").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n")).collect():  # a row a pivot at most
            cells.radius[r["cell"]], cells.count[r["cell"]] = r["radius"], r["n"]
        return cells

    def rows(self) -> DataFrame:
        return self.spark.read.schema("cell int, angle double, id long, v array<double>").parquet(self.path)

    # Search

    def _scan(self, queries: np.ndarray, visits: np.ndarray, bounds: np.ndarray, k: int) -> DataFrame:
        """``query, id, similarity``: each task's k best vectors for each query among the cells that it visits (a query and cell matrix)."""
        shared = self.spark.sparkContext.broadcast((queries, visits, bounds, self.pivots))
        wanted = np.flatnonzero(visits.any(axis=0)).tolist()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield _nearest_of(batches, *shared.value, k)

        return self.rows().where(F.col("cell").isin(wanted)).mapInArrow(run, "query long, id long, similarity double")

    def _top(self, found: DataFrame, k: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    def nearest(self, queries: DataFrame, k: int, id_col: str = "id", vector: str = "embedding", visit: int | None = None, own: bool = False) -> DataFrame:
        """``query, rank, id, similarity``: each query row's k nearest vectors by cosine. own: whether rows with the query's id count. visit: cells of a query, at most."""
        size, parts = self.pivots.shape[1], []
        block, rows = max(1, QUERY_BYTES // (16 * size + 2 * len(self.pivots))), _unit(queries, size, id_col, vector)  # vectors and visits, of two scans
        held: list = []

        def ask() -> None:
            ids, q = np.array([r["id"] for r in held]), np.array([r["v"] for r in held])
            held.clear()
            need = k + (0 if own else 1)
            first, last = np.zeros((len(q), len(self.pivots)), bool), np.full(len(q), 4.0)
            slices = [slice(at, at + ASKED) for at in range(0, len(q), ASKED)]
            for s in slices:
                order = np.argsort(_angles(q[s] @ self.pivots.T), axis=1, kind="stable")
                # The nearest cells that hold enough vectors, then all that can hold a nearer one than the last of these.
                enough = (np.cumsum(self.count[order], axis=1) < need).sum(axis=1) + 1
                first[s] = np.argsort(order, axis=1, kind="stable") < np.minimum(enough, visit or len(self.pivots))[:, None]
            near = self._top(self._scan(q, first, np.full(len(q), 4.0), need), need).select("query", "id", "similarity").toArrow()  # k rows for each query of a bounded block
            asked, least = near.column("query").to_numpy(), np.full(len(q), 1.0)
            full = np.bincount(asked, minlength=len(q)) == need
            np.minimum.at(least, asked, near.column("similarity").to_numpy())
            last[full] = _angles(least[full]) + SLACK
            reach = np.zeros_like(first)
            for s in slices:
                angles = _angles(q[s] @ self.pivots.T)
                reach[s] = (angles - self.radius[None, :] <= last[s][:, None]) & ~first[s] & (self.count > 0)[None, :]
                if visit:
                    reach[s] &= np.argsort(np.argsort(angles, axis=1, kind="stable"), axis=1, kind="stable") < visit
            everything = self.spark.createDataFrame(near)
            if reach.any():
                everything = everything.unionByName(self._scan(q, reach, last, need))
            names = self.spark.createDataFrame(pa.table({"query": np.arange(len(ids)), "asked": ids}))
            found = everything.join(F.broadcast(names), "query")
            found = found if own else found.where("id <> asked")
            parts.append(self._top(found, k).select(F.col("asked").alias("query"), F.col("rank"), "id", "similarity"))

        for row in rows.toLocalIterator():  # a stated query set, block by block
            held.append(row)
            if len(held) >= block:
                ask()
        if held:
            ask()
        if not parts:
            return self.spark.createDataFrame([], "query long, rank int, id long, similarity double")
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    # Join

    def pairs(self, threshold: float, tile: int = TILE) -> DataFrame:
        """``a, b, similarity`` of all pairs of rows with a cosine above the threshold, a <= b, each once. Cells meet in groups, and a vector goes to a group once, so that
        it is copied as often as there are groups of a tile's rows at most, not cells."""
        group, size = _groups(self.pivots, self.count, min(tile, max(1024, int(self.count.sum()) // 16))), self.pivots.shape[1]
        reach = math.acos(max(-1.0, min(1.0, threshold))) + SLACK
        starts = np.flatnonzero(np.diff(np.sort(group), prepend=-1))
        by_group = np.argsort(group, kind="stable")
        shared = self.spark.sparkContext.broadcast((self.pivots[by_group], self.radius[by_group], self.count[by_group], group, starts))

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pivots, radius, count, group, starts = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    home = group[part.column(0).to_numpy()]
                    goes = (_angles(_matrix(part.column(3), size) @ pivots.T) - radius[None, :] <= reach) & (count > 0)[None, :]
                    goes = np.logical_or.reduceat(goes, starts, axis=1)
                    goes &= np.arange(len(starts))[None, :] > home[:, None]  # of two groups, the first one's vectors go
                    row, cell = np.nonzero(goes)
                    row, cell, guest = np.concatenate((np.arange(len(home)), row)), np.concatenate((home, cell)), np.arange(len(home) + len(row)) >= len(home)
                    moved = part.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(guest), moved.column(2), moved.column(3)], ["cell", "guest", "id", "v"])

        sent = self.rows().mapInArrow(send, "cell int, guest boolean, id long, v array<double>")
        counts = {(r["cell"], r["guest"]): r["count"] for r in sent.groupBy("cell", "guest").count().collect()}  # two rows a pivot at most
        tiles = lambda guest: F.create_map(*[F.lit(x) for (c, g), n in counts.items() if g == guest for x in (c, -(-n // tile))]) if any(g == guest for _, g in counts) else F.lit(None).cast("map<int,int>")
        hosts, guests = F.coalesce(tiles(False)[F.col("cell")], F.lit(0)), F.coalesce(tiles(True)[F.col("cell")], F.lit(0))
        own = F.pmod(F.xxhash64("id", "v"), F.when(F.col("guest"), guests).otherwise(hosts))
        upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        meet = F.when(F.col("guest"), F.transform(upto(hosts), lambda h: F.struct(h.cast("long").alias("i"), (-1 - F.col("tile")).alias("j")))).otherwise(
            F.concat(
                F.transform(upto(guests), lambda g: F.struct(F.col("tile").alias("i"), (-1 - g).cast("long").alias("j"))),
                F.transform(upto(hosts), lambda h: F.struct(F.least(F.col("tile"), h).cast("long").alias("i"), F.greatest(F.col("tile"), h).cast("long").alias("j"))),
            )
        )
        dealt = sent.withColumn("tile", own.cast("long")).withColumn("pair", F.explode(meet)).select("cell", "pair.i", "pair.j", "tile", "guest", "id", "v")

        def compare(table: pa.Table) -> pa.Table:
            table = table.combine_chunks()
            j, ids, at = table.column("j")[0].as_py(), table.column("id").to_numpy(), table.column("tile").to_numpy()
            guest, v = table.column("guest").to_numpy(), _matrix(table.column("v").chunk(0) if table.column("v").num_chunks else table.column("v"), size)
            left = np.flatnonzero(~guest & (at == table.column("i")[0].as_py()))
            right, same = (np.flatnonzero(guest), False) if j < 0 else (np.flatnonzero(~guest & (at == j)), j == table.column("i")[0].as_py())
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            other = np.ascontiguousarray(v[right].T)
            for k in range(0, len(left), 256):
                part = left[k : k + 256]
                score = v[part] @ other
                r, c = np.nonzero(score > threshold - 10.0**-DECIMALS)
                score = np.round(score[r, c], DECIMALS)
                r, c, score = r[score > threshold], c[score > threshold], score[score > threshold]
                once = part[r] < right[c] if same else np.ones(len(r), bool)
                x, y = ids[part[r]][once], ids[right[c]][once]
                found.append((np.minimum(x, y), np.maximum(x, y), score[once]))
            return pa.table({n: pa.array(np.concatenate([f[i] for f in found])) for i, n in enumerate(("a", "b", "similarity"))})

        return dealt.groupBy("cell", "i", "j").applyInArrow(compare, "a long, b long, similarity double")
