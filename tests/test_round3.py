"""Cases of the third round's findings, against DuckDB or brute force."""

from __future__ import annotations

import duckdb
import pytest

import skarn.queries_lookups  # noqa: F401
from skarn.queries import QUERIES, SQL


def by_sql(name: str, folder, *tables: str) -> list[tuple]:
    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet{'/*.parquet' if (folder / f'{t}.parquet').is_dir() else ''}')")
    return con.sql(SQL[name]).fetchall()


@pytest.mark.parametrize("kind", ["many diffs", "no failure", "null command"])
def test_ordered_plan_counts_all_outcomes(spark, tmp_path, kind):
    """only a million diffs counted, none without a failure, and a null command never."""
    n = 1_000_400 if kind == "many diffs" else 300
    value = {"many diffs": "CASE WHEN range < 300 THEN 200 WHEN range % 7 = 0 THEN 150 ELSE 0 END", "no failure": "0", "null command": "CASE WHEN range % 3 = 2 THEN 200 ELSE 0 END"}[kind]
    event = {"many diffs": "CASE WHEN range < 300 THEN 'old' ELSE ['a', 'b', 'c'][1 + range % 10 // 4] END", "no failure": "['a', 'a', 'b'][1 + range % 3]", "null command": "['a', 'b', NULL][1 + range % 3]"}[kind]
    duckdb.sql(f"COPY (SELECT range AS event_id, TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * range AS ts, range AS user_id, {event} AS event_type, CAST({value} AS DOUBLE) AS value, '' AS props FROM range({n})) TO '{tmp_path}/events.parquet'")
    got = QUERIES["c8_ordered_plan"](spark, str(tmp_path))
    assert sorted((tuple(r) for r in got.select("command", "position").collect()), key=str) == sorted(by_sql("c8_ordered_plan", tmp_path, "events"), key=str)


def test_best_endpoints_equal_brute_force_by_tiles(spark):
    """a cross join compared rows one by one in the JVM; tiles give the same, also with copies, ties and unusable vectors."""
    import numpy as np

    from skarn.operators.joins import best_endpoints

    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 6)).astype(np.float32).tolist()
    x[20] = x[3]  # an endpoint equal to another one
    x[90] = x[70] = x[110] = [2 * v for v in x[3]]  # files of the same direction
    x[120], x[121], x[122], x[123] = [0.0] * 6, None, [float("nan")] * 6, [1.0, 2.0]
    rows = spark.createDataFrame(list(enumerate(x)), "id long, embedding array<float>")
    files, ends = rows.where("id >= 60 and id <> 123").withColumnRenamed("id", "path"), rows.where("id < 60 or id between 120 and 123").withColumnRenamed("id", "endpoint")
    plans: list[list] = []
    for size in (7, 1000):
        found = best_endpoints(files, ends, 0.3, limit=12, rows_per_tile=size)
        assert "CartesianProduct" not in (plan := found._jdf.queryExecution().toString()) and "BroadcastNestedLoopJoin Cross, true" not in plan
        plans.append([(r["endpoint"], r["path"], round(r["similarity"], 9)) for r in found.collect()])
    unit = {i: np.array(v, float) / np.linalg.norm(v) for i, v in enumerate(x) if v is not None and len(v) == 6 and 0 < np.linalg.norm(v) < 1e9}
    best = [min((-round(float(unit[e] @ unit[f]), 9), f) for f in unit if f >= 60) + (e,) for e in unit if e < 60]
    assert plans[0] == plans[1] == [(e, f, -s) for s, f, e in sorted(b for b in best if b[0] <= -0.3)[:12]]
    assert plans[0][:2] == [(3, 70, 1.0), (20, 70, 1.0)]


def test_mapping_of_tests_needs_no_state_of_all_pairs(spark):
    """pairs by name were aggregated after the join, which held them all; kinds are told apart before."""
    import random

    from skarn.plans.services import test_mapping as mapping

    r = random.Random(4)
    symbols = [(r.randrange(40), f"n{r.randrange(6)}", f"f{r.randrange(5)}", r.random() < 0.4) for _ in range(120)]
    symbols = [(i, n, f, t, n) for i, n, f, t in symbols] + [(90, None, "f1", False, None), (91, None, None, True, None), (None, "n1", "f2", False, "n1")]
    imports, coverage = [("f0", "f1"), ("f0", "f2"), ("f2", "f1"), ("f0", "f1"), ("f3", None)], [("f1", "f1"), ("f0", "f1"), ("f4", "f2"), ("f4", "f3"), ("f4", "f2")]
    want = {}
    for kind, confidence in (("IMPORT", 1.0), ("NAMING", 0.5), ("COVERAGE", 0.9)):
        for i, _, f, t, stripped in symbols:
            for k, name, g, u, _ in symbols:
                if t and not u and ((f, g) in imports and g is not None if kind == "IMPORT" else stripped == name and name is not None if kind == "NAMING" else (f, g) in coverage):
                    want.setdefault((i, k), (confidence, kind))
    found = mapping(spark.createDataFrame(symbols, "id long, symbol_name string, file_path string, is_test boolean, stripped string"), spark.createDataFrame(imports, "file_path string, target string"), spark.createDataFrame(coverage, "test_file string, file_path string"))
    rows = [tuple(x) for x in found.select("test", "tested", "confidence", "kind").collect()]
    assert len(rows) == len(want) and {x[:2]: x[2:] for x in rows} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [test#" not in plan


def test_cells_copy_a_vector_by_groups(spark, tmp_path, monkeypatch):
    """a vector went to every cell within reach, and cells grow with the root of the rows; it goes to a group once."""
    import numpy as np

    from skarn.operators.vector_cells import Cells

    x = np.random.default_rng(8).normal(size=(3000, 8))
    cells = Cells.build(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>"), str(tmp_path / "cells"))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(np.round(unit @ unit.T, 12) > 0.8, 1)), strict=True)}
    moved, grouped = [], type(spark.range(1)).groupBy

    def counted(self, *keys):
        if keys == ("cell", "i", "j"):
            moved.append(self.count())
        return grouped(self, *keys)

    monkeypatch.setattr(type(spark.range(1)), "groupBy", counted)
    assert {(r["a"], r["b"]) for r in cells.pairs(0.8).collect()} == want
    assert moved[0] <= 8 * 3000


def test_index_deals_out_finished_postings(spark, tmp_path):
    """F6, F7, F8: every token was shuffled before it was counted, and every trigram of a document was a row."""
    from skarn.operators.search_index import SearchIndex

    texts = [(i, f"word{i % 7} same same 😀é fooBar {'xyz ' * (i % 3)}") for i in range(200)] + [(900, None), (901, ""), (902, "ab")]
    index = SearchIndex.create(spark, str(tmp_path / "index"), buckets=4)
    index.add(spark.createDataFrame(texts, "doc_id long, text string"))
    grams = index._live("grams", "doc long, terms array<string>, segment long, bucket int", index._state())
    assert grams.count() <= 4 * 200
    want = {(i, t.lower()[k : k + 3]) for i, t in texts if t for k in range(len(t) - 2)}
    got = [(r["doc"], g) for r in grams.collect() for g in r["terms"]]
    assert len(got) == len(want) and set(got) == want
    assert {r["doc"] for r in index.candidates(["e 😀", " 😀é", "xyz"][1:]).collect()} == {i for i, t in texts if t and " 😀é" in t and "xyz" in t}


def test_calls_without_a_callee_are_not_dealt_to_one_task(spark):
    from pyspark.sql import functions as F
    from skarn.operators.joins import call_projection

    symbols = spark.range(400).select("id", F.concat(F.lit("q"), "id").alias("qualified_name"))
    edges = spark.range(2000).select((F.col("id") % 400).alias("caller_symbol_id"), F.when(F.col("id") % 2 == 0, F.col("id") % 450).alias("callee_symbol_id"), F.when(F.col("id") % 4 != 0, F.concat(F.lit("u"), "id")).alias("unresolved_callee"), F.lit(1.0).alias("confidence"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        rows = call_projection(edges, symbols).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    want = {}
    for i in range(2000):
        callee = i % 450 if i % 2 == 0 else None
        target = f"q{callee}" if callee is not None and callee < 400 else f"u{i}" if i % 4 else None
        if target:
            want[(f"q{i % 400}", target)] = want.get((f"q{i % 400}", target), 0) + 1
    got = {}
    for r in rows:
        got[(r["source"], r["target"])] = got.get((r["source"], r["target"]), 0) + 1
    assert got == want
    assert len({r["task"] for r in rows if r["target"].startswith("u") and int(r["target"][1:]) % 2}) > 1
