"""Vector cells against all pairs: results are exact, and clusters are mostly out of each other's reach."""

from __future__ import annotations

import numpy as np
import pytest

from skarn.operators import vector_cells as vc
from skarn.operators.vector_cells import Cells

SCHEMA = "id long, embedding array<double>"


def clustered(seed, groups=24, each=25, size=12, spread=0.08):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, size))
    rows = [(g * each + i, (centres[g] / np.linalg.norm(centres[g]) + spread * rng.normal(size=size) / 3).tolist()) for g in range(groups) for i in range(each)]
    return rows + [(10_000 + i, rows[0][1]) for i in range(40)]  # copies


ODD = [(None, [1.0] * 12), (20_000, None), (20_001, [0.0] * 12), (20_002, [float("nan")] + [1.0] * 11), (20_003, [1.0, 2.0]), (20_004, [None] + [1.0] * 11), (20_005, [])]


def plain(rows):
    ids = np.array([i for i, _ in rows])
    v = np.array([x for _, x in rows])
    v /= np.linalg.norm(v, axis=1)[:, None]
    return ids, np.round(v @ v.T, 12)


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rows = clustered(1)
    table = spark.createDataFrame(rows + ODD, SCHEMA).repartition(3)
    return Cells.build(table, str(tmp_path_factory.mktemp("cells") / "index")), rows, table


def test_nearest_are_exact_and_few_cells_are_read(built, monkeypatch):
    cells, rows, table = built
    ids, close = plain(rows)
    scans, scan = [], Cells._scan
    monkeypatch.setattr(Cells, "_scan", lambda self, q, visits, bounds, k: (scans.append((visits * self.count).sum() / (len(q) * self.count.sum())), scan(self, q, visits, bounds, k))[1])
    monkeypatch.setattr(vc, "QUERY_BYTES", 8 * 60 * 40)
    queries = table.where("id % 7 = 0 OR id > 9990")
    got = sorted((r["query"], r["rank"], r["id"], round(r["similarity"], 9)) for r in cells.nearest(queries, 5).collect())
    want = []
    for n in [n for n, i in enumerate(ids) if i % 7 == 0 or i > 9990]:
        order = sorted((m for m in range(len(ids)) if ids[m] != ids[n]), key=lambda m: (-close[n, m], ids[m]))[:5]
        want += [(ids[n], r + 1, ids[m], round(close[n, m], 9)) for r, m in enumerate(order)]
    assert got == sorted(want)
    assert len(scans) > 2 and np.mean(scans) < 0.35


def test_a_capped_search_has_most_of_the_nearest(built):
    cells, rows, table = built
    exact = {(r["query"], r["id"]) for r in cells.nearest(table.where("id % 11 = 0"), 5).collect()}
    capped = {(r["query"], r["id"]) for r in cells.nearest(table.where("id % 11 = 0"), 5, visit=6).collect()}
    assert len(exact & capped) >= 0.9 * len(exact)


@pytest.mark.parametrize("threshold, tile", [(0.9, 16), (0.5, 2048)])
def test_pairs_are_exact(built, threshold, tile):
    cells, rows, _ = built
    ids, close = plain(rows)
    want = sorted((min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in zip(*np.nonzero(np.triu(close > threshold, 1)), strict=True))
    assert sorted((r["a"], r["b"]) for r in cells.pairs(threshold, tile).collect()) == want


def test_small_and_empty_tables(spark, tmp_path):
    assert Cells.build(spark.createDataFrame([], SCHEMA), str(tmp_path / "none")) is None
    one = Cells.build(spark.createDataFrame([(1, [3.0, 4.0])], SCHEMA), str(tmp_path / "one"))
    assert one.nearest(spark.createDataFrame([(1, [3.0, 4.0]), (2, [6.0, 8.0]), (3, None)], SCHEMA), 3).collect() == [(2, 1, 1, 1.0)]
    assert one.pairs(0.5).collect() == [] == one.nearest(spark.createDataFrame([], SCHEMA), 3).collect()


def test_memory_is_bounded_by_slices(built, monkeypatch):
    """A task gets a query's vector and a byte a cell, and holds slices of scores, however large a cell is."""
    import pickle
    import tracemalloc

    import pyarrow as pa

    cells, rows, table = built
    queries, sizes, context = table.where("id % 2 = 0 AND id < 600"), [], cells.spark.sparkContext
    send = type(context).broadcast
    monkeypatch.setattr(type(context), "broadcast", lambda self, value: (sizes.append(len(pickle.dumps(value))), send(self, value))[1])
    assert cells.nearest(queries, 5).count() == 1500
    assert len(sizes) == 2 and max(sizes) < 300 * (8 * 12 + len(cells.pivots) + 8) + cells.pivots.nbytes + 2000

    rng = np.random.default_rng(5)
    q, v = rng.normal(size=(600, 8)), rng.normal(size=(40_000, 8))
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(v), np.int32)), pa.array(np.zeros(len(v))), pa.array(np.arange(len(v))), pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, 8, dtype=np.int32)), pa.array(v.ravel()))], ["cell", "angle", "id", "v"])
    tracemalloc.start()
    found = vc._nearest_of(iter([batch]), q, np.ones((600, 1), bool), np.full(600, 4.0), np.ones((1, 8)), 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 << 20
    best = np.argsort(-np.round(q @ v.T, vc.DECIMALS), axis=1, kind="stable")[:, :3]
    assert found.column("query").to_pylist() == np.repeat(np.arange(600), 3).tolist() and found.column("id").to_pylist() == best.ravel().tolist()
