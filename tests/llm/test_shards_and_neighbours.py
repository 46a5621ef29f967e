from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from llm_fixtures import frame, prose
from pyspark.sql import functions as F

from skarn.llm.kd_shards import shard
from skarn.llm.multi_index import floor_of, kmeans, nearest, neighbours, walk


def _law(rows, shards):
    for s in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert 0 <= s < shards and slots == list(range(len(slots)))


def test_shards_are_even_and_keep_copies(spark, odd, none):
    rng = np.random.default_rng(1)
    rows = [(i, prose(i, int(rng.integers(5, 300))), "en", "a") for i in range(600)] + [(1000 + i, prose(7777, 100), "en", "b") for i in range(12)]
    got = shard(frame(spark, rows), 8).collect()
    assert len(got) == len(rows)
    _law(got, 8)
    bytes_ = Counter()
    for r in got:
        assert r["size"] == len((r["text"] or "").encode()) + 16
        bytes_[r["shard"]] += r["size"]
    assert max(bytes_.values()) / min(bytes_.values()) < 1.03 and len(bytes_) == 8
    assert len({r["shard"] for r in got if r["doc_id"] >= 1000}) == 1
    hot = shard(frame(spark, rows + [(5000 + i, "copy " * 40, "en", "c") for i in range(3000)]), 8).collect()
    sums = Counter()
    for r in hot:
        sums[r["shard"]] += r["size"]
    _law(hot, 8)
    assert max(sums.values()) / min(sums.values()) < 1.15
    few = shard(odd.withColumn("slot", F.lit("x")).withColumns({c: F.lit(7) for c in ("_bucket", "_start", "_row", "_homes", "row", "_deal", "_h1", "_key0", "text2")}), 5).collect()
    assert len(few) == odd.count() and {r[c] for r in few for c in ("_bucket", "_start", "_row", "_homes", "row", "_deal", "_h1", "_key0", "text2")} == {7}
    _law(few, 5)
    assert shard(none, 5).collect() == []


def test_groups_without_ids_and_of_few_rows_are_dealt_evenly(spark):
    plain = [(i, prose(i, 60), "en", "a") for i in range(400)]
    for group in ([(None, "equal text " * 20, "en", "b")] * 3000, [(7, "one long text " * 800, "en", "b")] * 200):
        got = shard(frame(spark, plain + group), 8).collect()
        _law(got, 8)
        sums = Counter()
        for r in got:
            sums[r["shard"]] += r["size"]
        assert len(got) == 400 + len(group) and max(sums.values()) / min(sums.values()) < 1.15
    whole = shard(frame(spark, plain + [(None, "equal text " * 20, "en", "b")] * 25), 8).collect()  # a group below a shard stays whole
    assert len({r["shard"] for r in whole if r["doc_id"] is None}) == 1


def test_cuts_are_weighted_medians_of_one_dimension(spark):
    rng = np.random.default_rng(2)
    rows = [(i, prose(i, int(rng.integers(2, 200))).replace(" ", "\n", int(rng.integers(40))) + " é" * int(rng.integers(60)), "en", "a") for i in range(500)]
    for shards in (2, 3):
        got = shard(frame(spark, rows), shards).collect()
        left, right = [r for r in got if r["shard"] < shards // 2], [r for r in got if r["shard"] >= shards // 2]
        ways = (lambda t: len(t.encode()), lambda t: t.count("\n"), lambda t: len(t.encode()) / len(t))
        assert any(max(f(r["text"]) for r in left) <= min(f(r["text"]) for r in right) for f in ways)
        share = sum(r["size"] for r in left) / sum(r["size"] for r in got)
        assert abs(share - (shards // 2) / shards) < 0.01


def test_walk_is_in_order_of_the_sum():
    rng = np.random.default_rng(3)
    a, b, held = rng.normal(size=6), rng.normal(size=7), rng.integers(0, 3, (6, 7))
    cells = walk(a, b, held, -np.inf)
    sums = [a[i] + b[k] for i, k in cells]
    assert sums == sorted(sums, reverse=True) and len(cells) == (held > 0).sum()
    assert walk(a, b, held, 0.5) == [(i, k) for i, k in cells if a[i] + b[k] >= 0.5]


def _vectors(spark, v, extra=()):
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(1500, 16)).astype(np.float32)
    v[100:700] = v[100]
    odd_rows = [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] + [1.0] * 15), (5003, [None] + [1.0] * 15), (5004, [1.0] * 3), (None, [1.0] * 16), (5020, [float("inf")] * 16)]
    table = _vectors(spark, v, odd_rows).withColumn("i", F.lit(1)).withColumn("v", F.lit(2))
    got = neighbours(table, F.col("vec_id") % 20 == 0, k=10).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    assert set(by) == set(range(0, 1500, 20))
    w, hit = v.astype(float), 0
    for q, rows in by.items():
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, 11))
        assert all(abs(r["score"] - float((w[q] * w[r["vec_id"]]).sum())) < 1e-9 for r in rows)
        assert [(-r["score"], r["vec_id"]) for r in rows] == sorted((-r["score"], r["vec_id"]) for r in rows)
        s = (w * w[q]).sum(axis=1)
        s[q] = -np.inf
        hit += len({r["vec_id"] for r in rows} & set(np.lexsort((np.arange(1500), -s))[:10].tolist()))
    assert hit / (10 * len(by)) >= 0.9
    copies = sorted(r["vec_id"] for r in by[120])
    assert copies == [100, 101, 102, 103, 104, 105, 106, 107, 108, 109]


def _clusters(rng, n, width=32, centres=100):
    return (rng.normal(size=(centres, width))[rng.integers(centres, size=n)] + 0.3 * rng.normal(size=(n, width))).astype(np.float32)


def test_recall_on_many_vectors_with_and_without_clusters(spark):
    rng, n, k = np.random.default_rng(8), 20_000, 20
    for v, most_visited in ((_clusters(rng, n), 0.05), (rng.normal(size=(n, 32)).astype(np.float32), 0.7)):
        table = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), 32).cast(pa.list_(pa.float32()))}))
        got = neighbours(table, F.col("vec_id") % 200 == 0, k=k).toPandas()
        w, hit = v.astype(float), 0
        for q, own in got.groupby("query_id"):
            s = w @ w[q]
            s[q] = -np.inf
            hit += len(set(own["vec_id"]) & set(np.argsort(-s)[:k].tolist()))
        assert len(got) == n // 200 * k and hit >= 0.9 * len(got)
        books = kmeans(w[:5000, :16], 64), kmeans(w[:5000, 16:], 64)
        (i, ri), (j, rj) = nearest(w[:, :16], books[0]), nearest(w[:, 16:], books[1])
        held = np.zeros((64, 64), int)
        np.add.at(held, (i, j), 1)
        shares = []
        for q in range(0, n, 400):
            a, b = w[q, :16] @ books[0].T, w[q, 16:] @ books[1].T
            spread = np.sqrt((w[q, :16] ** 2).sum() * ri.mean() / 16 + (w[q, 16:] ** 2).sum() * rj.mean() / 16)
            shares.append(sum(held[c] for c in walk(a, b, held, floor_of(a, b, held, spread, k, 0.97))) / n)
        assert np.mean(shares) < most_visited


def test_few_and_none(spark):
    few = neighbours(_vectors(spark, np.eye(4)), F.col("vec_id") == 0).collect()
    assert [(r["rank"], r["vec_id"]) for r in few] == [(1, 1), (2, 2), (3, 3)]
    assert neighbours(_vectors(spark, np.zeros((0, 2))), F.lit(True)).collect() == []
