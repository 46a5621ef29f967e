"""The versioned graph store: a stream's graph is that of batch syncs, replays count once, deltas are the difference of snapshots."""

from __future__ import annotations

import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from skarn.operators.graph import sync
from skarn.operators.sets import graph_diff
from skarn.streaming import graph_store as gs
from skarn.streaming import watch as w

NODES = "file string, id string, label string, category string, risk_score double"
EDGES = "source string, target string, relation string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def store(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "a", "a", "file", 0.1), ("a", "a1", "f", "symbol", 0.2), ("a", "a2", "g", "symbol", 0.3), ("b", "b", "b", "file", 0.0), ("b", "b1", "h", "symbol", 0.0)], NODES)
    edges = spark.createDataFrame([("a1", "b1", "calls"), ("b1", "a2", "calls"), ("b1", "a1", "calls")], EDGES)
    return gs.GraphStore.create(spark, str(tmp_path / "graph"), nodes, edges, buckets=3)


def apply(spark, store, changed, nodes, edges, epoch):
    return store.apply(spark.createDataFrame([(c,) for c in changed], "path string"), spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), epoch)


def test_an_epoch_removes_what_a_file_owned_and_its_outgoing_edges(spark, store):
    assert apply(spark, store, ["a"], [("a", "a", "a", "file", 0.1), ("a", "a1", "f", "symbol", 0.9)], [("a1", "x", "calls")], 0)
    nodes, edges = store.snapshot()
    assert {r[1] for r in rows(nodes)} == {"a", "a1", "b", "b1"}
    assert rows(edges) == [("a1", "x", "calls"), ("b1", "a1", "calls"), ("b1", "a2", "calls")]  # the edge into a2 stays
    assert rows(store.deltas(-1, 0).select("kind", "id", "source", "target")) == sorted([("edge_added", None, "a1", "x"), ("edge_removed", None, "a1", "b1"), ("node_removed", "a2", None, None), ("node_updated", "a1", None, None)], key=str)
    assert rows(store.commits().where("epoch = 0")) == [(0, 1, 2, 1, 1, 1)]
    assert apply(spark, store, ["b"], [], [], 1) and {r[1] for r in rows(store.snapshot()[0])} == {"a", "a1"}
    assert rows(store.snapshot()[1]) == [("a1", "x", "calls")]
    assert {r[1] for r in rows(store.snapshot(-1)[0])} == {"a", "a1", "a2", "b", "b1"}  # older versions stay readable


def test_replays_count_once(spark, store):
    args = (["a"], [("a", "a9", "f", "symbol", 0.9)], [("a9", "b1", "calls")])
    # A first attempt that wrote its logs and died before the commit.
    store._write(store._node_rows(spark.createDataFrame([("a", "ghost", "", "", 0.0)], NODES), True, 0), "nodes", 0)
    assert "ghost" not in {r[1] for r in rows(store.snapshot()[0])}
    assert apply(spark, store, *args, 0)
    state, commits = [rows(x) for x in store.snapshot()], rows(store.commits())
    assert not apply(spark, store, *args, 0)
    assert [rows(x) for x in store.snapshot()] == state and rows(store.commits()) == commits and "ghost" not in str(state)


def test_ids_that_files_share_and_null_keys(spark, store):
    assert apply(spark, store, ["b"], [("b", "a1", "moved", "symbol", 0.5), ("b", None, "", "", 0.0)], [(None, "z", "calls")], 0)
    assert [r for r in rows(store.snapshot()[0]) if r[1] == "a1"] == [("b", "a1", "moved", "symbol", 0.5)]
    store.compact()
    assert apply(spark, store, ["a"], [], [], 1)  # it owned a1 before
    assert {r[1] for r in rows(store.snapshot()[0])} == set()


@pytest.mark.parametrize("seed", [1])
def test_random_epochs_equal_batch_syncs(spark, tmp_path, seed):
    rng = random.Random(seed)
    store = gs.GraphStore.create(spark, str(tmp_path / "g"), buckets=4)
    nodes, edges = {}, set()
    owned: dict[str, list[str]] = {}
    snapshots = [({}, set())]
    for epoch in range(4):
        changed = rng.sample("abcdef", rng.randrange(1, 4))
        new_nodes = {f"{f}{i}": (f, f"{f}{i}", "l", "symbol", rng.random()) for f in changed if rng.random() < 0.8 for i in range(rng.randrange(4))}
        new_edges = {(s, rng.choice("abcdef") + "0", rng.choice(["calls", "uses"])) for s in new_nodes for _ in range(2)}
        apply(spark, store, changed, list(new_nodes.values()), list(new_edges), epoch)
        removed = [i for f in changed for i in owned.get(f, [])]
        frame = lambda r, s: spark.createDataFrame(list(r), s)
        want_nodes, want_edges = sync(frame(nodes.values(), NODES), frame(edges, EDGES), frame([(i,) for i in removed], "id string"), frame(new_nodes.values(), NODES), frame(new_edges, EDGES))
        nodes, edges = {r["id"]: tuple(r) for r in want_nodes.select("file", "id", *gs.NODE).collect()}, {tuple(r) for r in want_edges.collect()}
        owned |= {f: [i for i, n in new_nodes.items() if n[0] == f] for f in changed}
        got_nodes, got_edges = store.snapshot()
        assert {tuple(r) for r in got_nodes.collect()} == set(nodes.values()) and {tuple(r) for r in got_edges.collect()} == edges
        snapshots.append((nodes, edges))
        if epoch == 2:
            store.compact()
            assert {tuple(r) for r in store.snapshot()[0].collect()} == set(nodes.values())
    plain = spark.createDataFrame([], NODES).drop("file")
    for a, b in [(-1, 3), (1, 3)]:
        sides = [(spark.createDataFrame([n[1:] for n in snapshots[k + 1][0].values()], plain.schema), spark.createDataFrame(list(snapshots[k + 1][1]), EDGES)) for k in (a, b)]
        n, e = graph_diff(sides[0][0], sides[1][0], sides[0][1], sides[1][1])
        names = {"ADDED": "added", "DELETED": "removed", "MODIFIED": "updated"}
        want = {(f"node_{names[r['change']]}", r["id"]) for r in n.collect()} | {(f"edge_{names[r['change']]}", (r["source"], r["target"], r["relation"])) for r in e.collect()}
        got = {(r["kind"], r["id"] or (r["source"], r["target"], r["relation"])) for r in store.deltas(a, b).collect()}
        assert got == want


def test_a_stream_keeps_the_graph_in_step_and_publishes_deltas(spark, tmp_path):
    events = [[("a.rs", "Modify", 1), ("b.rs", "Modify", 2), ("a.rs", "Unknown", 3)], [("c.txt", "Modify", 4)], [("b.rs", "Remove", 5), ("a.rs", "Modify", 6)]]
    for batch in events:
        spark.createDataFrame(batch, "path string, kind string, seq long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    store = gs.GraphStore.create(spark, str(tmp_path / "graph"), buckets=2)
    seen = []

    def index(last):
        nodes = last.select(F.col("path").alias("file"), F.concat("path", F.lit("::f")).alias("id"), F.lit("f").alias("label"), F.lit("symbol").alias("category"), F.col("seq").cast("double").alias("risk_score"))
        return nodes, nodes.select(F.col("id").alias("source"), F.lit("a.rs::f").alias("target"), F.lit("calls").alias("relation"))

    step, tell = gs.keep_in_step(store, index, ["rs"]), gs.publish(store, lambda df, epoch: seen.append((epoch, sorted({r["kind"] for r in df.collect()}))))

    def both(batch, epoch):
        step(batch, epoch)
        tell(batch, epoch)

    schema = "path string, kind string, seq long"
    w.watch(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema).writeStream.option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(both).trigger(availableNow=True).start().awaitTermination()
    assert seen == [(0, ["edge_added", "node_added"]), (1, ["heartbeat"]), (2, ["edge_removed", "node_removed", "node_updated"])]
    assert rows(store.snapshot()[0].select("id", "risk_score")) == [("a.rs::f", 6.0)]


def test_sessions_do_not_depend_on_arrival(spark, tmp_path):
    rng = random.Random(7)
    events = [(i, f"{p}.rs", rng.choice(["Modify", "Unknown"]), t) for p in "ab" for i, t in enumerate(sorted(rng.sample(range(4000), 60)))] + [(99, "z.rs", "Modify", 100_000)]
    table = spark.createDataFrame(events, "seq long, path string, kind string, t long").select("seq", "path", "kind", F.timestamp_seconds("t").alias("ts"))
    want = rows(w.quiet_sessions(table, "30 seconds").where("path <> 'z.rs'"))
    for order in range(2):
        rng.shuffle(events)
        events.sort(key=lambda e: e[3] > 50_000)  # the last one lets the watermark pass
        for k in range(0, len(events), 30):
            part = spark.createDataFrame(events[k : k + 30], "seq long, path string, kind string, t long").select("seq", "path", "kind", F.timestamp_seconds("t").alias("ts"))
            part.coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{order}"))
        stream = w.quiet_sessions(w.watch(spark, str(tmp_path / f"in{order}"), table.schema), "30 seconds", "2 hours")
        run = stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / f"cp{order}")).format("memory").queryName(f"sessions{order}").trigger(availableNow=True).start()
        run.awaitTermination()
        assert rows(spark.table(f"sessions{order}")) == want


def test_an_arrival_of_many_files_is_one_epoch(spark, tmp_path):
    from skarn.queries import Inputs
    from skarn.queries_streams import _stored

    rows = spark.range(0, 60_000, 1, 4).selectExpr("id AS event_id", "timestamp_seconds(1704067200 + id % 30 * 86400) AS ts", "id % 900 AS user_id", "IF(id % 50 = 7, 'error', 'view') AS event_type", "double(id % 100) AS value", "CAST(NULL AS STRING) AS props")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    assert rows.rdd.getNumPartitions() == 4
    store = _stored(Inputs(spark, str(tmp_path)))
    assert store.epochs() == [-1, 0, 1, 2, 3]
    landed = {p.name for p in Path(store.path).parent.glob("in/part-*.parquet")}
    assert len(landed) > 4  # one a part before
