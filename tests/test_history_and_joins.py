"""Tiny frames with answers worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skarn.operators import joins as j
from skarn.operators import predicates as p
from skarn.operators import sets as u
from skarn.plans import history as h


def commits(spark, sets):
    return spark.createDataFrame([(i, False, f) for i, files in enumerate(sets) for f in files], "commit_idx long, is_merge boolean, file string")


def symbols(spark, rows):
    return spark.createDataFrame(rows, "file_path string, cognitive_complexity int, cyclomatic_complexity int")


def test_files_that_always_change_together(spark):
    got = h.temporal_coupling(commits(spark, [["a", "b"]] * 10), 0.8).collect()
    assert [(r["file_a"], r["file_b"]) for r in got] == [("a", "b"), ("b", "a")] and all(r["score"] > 0.95 for r in got)


def test_coupling_has_a_direction(spark):
    got = h.temporal_coupling(commits(spark, [["a", "b"]] * 5 + [["a", "x"], ["a"], ["a"], ["a"], ["a"]]), 0.6, min_revisions=3).collect()
    assert [(r["file_a"], r["file_b"]) for r in got] == [("b", "a")]


def test_too_little_history(spark):
    with pytest.raises(h.TooLittleHistory):
        h.temporal_coupling(commits(spark, [["a"]] * 5))


def test_merges_and_large_commits_do_not_count(spark):
    rows = commits(spark, [["a", "b"], [f"f{i}" for i in range(51)]]).union(spark.createDataFrame([(2, True, "a")], "commit_idx long, is_merge boolean, file string"))
    assert {(r["commit_idx"], r["file"]) for r in p.eligible_commits(rows).collect()} == {(0, "a"), (0, "b")}


def test_hotspot_order_ties_and_filters(spark):
    s = symbols(spark, [("a", 10, 1), ("b", 20, 2), ("c", 3, 20)])
    got = h.hotspots(commits(spark, [["a", "b", "c"], ["a", "b", "c"], ["a"]]), s)
    assert [r["file"] for r in got.collect()] == ["b", "c", "a"]
    c = commits(spark, [["src/a.rs", "tests/a.rs", "src/a.py"]])
    assert [r["file"] for r in h.hotspots(c, symbols(spark, [("src/a.rs", 1, 1)]), directory="src", language="rs").collect()] == ["src/a.rs"]


def test_hotspots_of_simple_code_are_zero(spark):
    got = h.hotspots(commits(spark, [["a", "b"]]), symbols(spark, [("a", 0, 0), ("b", None, None)])).collect()
    assert [r["score"] for r in got] == [0.0, 0.0] and all(r["display"] == 0.0 for r in got)


def test_fallback_never_replaces_a_primary_zero(spark):
    base = spark.createDataFrame([("a",), ("b",), ("c",)], "file string")
    v = lambda rows: spark.createDataFrame(rows, "file string, complexity int")
    got = {r["file"]: r["complexity"] for r in j.with_fallback(base, v([("a", 0)]), v([("a", 5), ("b", 7), ("c", 0)]), "file", "complexity").collect()}
    assert got == {"a": 0, "b": 7, "c": 0}


def test_history_scan_stops_at_age_and_commit(spark):
    log = spark.sql("SELECT concat('c', id) AS commit, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(id AS int)) AS commit_ts, id = 3 AS is_merge, 'f' AS file FROM range(10)")
    assert h.scan_history(log, first_days=4).count() == 5
    got = h.scan_history(log, since_commit="c5").orderBy("commit_idx").collect()
    assert [r["commit"] for r in got] == ["c9", "c8", "c7", "c6"]
    assert h.scan_history(log).where("commit = 'c3'").first()["file"] is None


def test_longest_prefix(spark):
    paths = spark.createDataFrame([("a/b/c.py",), ("a/x.py",), ("z.py",), ("ab/q.py",)], "path string")
    roots = spark.createDataFrame([("a",), ("a/b",), (".",)], "prefix string")
    assert {r["path"]: r["prefix"] for r in j.longest_prefix(paths, roots).collect()} == {"a/b/c.py": "a/b", "a/x.py": "a", "z.py": ".", "ab/q.py": "."}


def test_import_suffixes(spark):
    imports = spark.createDataFrame([("x.rs", ["crate::util", "util::path"]), ("y.rs", ["other"])], "file_path string, imported_from array<string>")
    changed = spark.createDataFrame([("src/util/path.rs",)], "path string")
    assert [tuple(r) for r in j.import_suffixes(imports, changed).collect()] == [("x.rs", "src/util/path.rs")]


def test_overrides_last_rule_wins(spark):
    rules = spark.createDataFrame([(0, "*.rs", "review", ["a"]), (1, "src/**", None, ["b", "a"]), (2, "src/x.rs", "block", [])], "idx int, pattern string, mode string, required_verifications array<string>")
    got = {r["path"]: (r["mode"], r["required_verifications"]) for r in p.resolve_overrides(spark.createDataFrame([("src/x.rs",), ("docs/y.md",), ("lib.rs",)], "path string"), rules).collect()}
    assert got == {"src/x.rs": ("block", ["a", "b"]), "docs/y.md": ("analyze", []), "lib.rs": ("review", ["a"])}


def test_unknown_never_erases_a_known_event(spark):
    rows = spark.createDataFrame([("a.rs", "Modify", 1), ("a.rs", "Unknown", 2), ("b.rs", "Unknown", 3), ("c.txt", "Modify", 4)], "path string, kind string, seq long")
    assert {tuple(r) for r in p.latest_events(rows, ["rs"]).collect()} == {("a.rs", "Modify"), ("b.rs", "Unknown")}


def test_id_resolution(spark):
    t = spark.createDataFrame([("abc1", "PENDING", "src/Main.rs"), ("abd2", "COMMITTED", "lib.rs")], "tx_id string, status string, entity string")
    assert [p.resolve_id(t, w) for w in ("abc1", "abd", "main")] == ["abc1", "abd2", "abc1"]
    with pytest.raises(ValueError):
        p.resolve_id(t, "ab")
    with pytest.raises(LookupError):
        p.resolve_id(t, "nothing")


def test_diff_and_drift(spark):
    a, b = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int"), spark.createDataFrame([("y", 3), ("z", 4)], "k string, v int")
    assert {tuple(r) for r in u.diff(a, b, ["k"], F.col("v")).collect()} == {("x", "DELETED"), ("y", "MODIFIED"), ("z", "ADDED")}
    e = spark.createDataFrame([("f", 3), ("f", 1)], "entity string, ts int")
    state = u.drift_counts(e)
    assert tuple(u.drift_counts(e.withColumn("ts", F.col("ts") + 5), state).first()) == ("f", 4, 1, 8)


def test_bridge_records_follow_the_chain(spark):
    rows = spark.createDataFrame([("f", 0, "h0", None, 1), ("f", 1, "h1", "zz", 3), ("f", 2, "h2", "h0", 2)], "file string, seq long, hash string, parent_hash string, privacy int")
    assert [(r["seq"], r["accepted"], r["privacy_so_far"]) for r in p.chain_accept(rows).orderBy("seq").collect()] == [(0, True, 1), (1, False, 1), (2, True, 2)]


def test_similar_pairs_do_not_depend_on_tiles(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100, [0.0] * 4), (101, None), (102, [float("nan")] * 4), (103, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    close = unit @ unit.T
    want = {(i, k) for i in range(60) for k in range(i + 1, 60) if close[i, k] > 0.7}
    for size in (7, 2048):
        assert {(r["a"], r["b"]) for r in j.similar_pairs(table, 0.7, rows_per_tile=size).collect()} == want
    within = {(i, k) for i, k in want if i % 3 == k % 3}
    assert {(r["a"], r["b"]) for r in j.similar_pairs(table, 0.7, block=F.col("id") % 3, rows_per_tile=16).collect()} == within
