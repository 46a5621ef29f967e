"""The prefix trie against a plain trie of nested dictionaries."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from skarn.llm import prefix_trie
from skarn.llm.prefix_trie import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows: list[tuple]) -> list[tuple]:
    turns: dict[int, list] = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in turns.items()}
    nodes: dict[tuple, dict] = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        path = turns.get(base, [])[:h] + turns[c][h:]
        for d in range(len(path) + 1):
            node = nodes.setdefault(tuple(path[:d]), {"members": [], "ends": [], "children": set()})
            node["members"].append(c)
            if d:
                nodes[tuple(path[: d - 1])]["children"].add(tuple(path[:d]))
        nodes[tuple(path)]["ends"].append(c)
    totals: dict[tuple, tuple[int, int]] = {}
    for key in sorted(nodes, key=len, reverse=True):
        node = nodes[key]
        saved = (len(node["members"]) - 1) * (len(key[-1][1]) if key else 0)
        below = [totals[k] for k in node["children"]]
        totals[key] = (sum(x for x, _ in below) or (0 if below else 1), saved + sum(y for _, y in below))
    return [
        (min(n["members"]), len(k), min(nodes[k[:-1]]["members"]) if k else None, len(n["members"]), len(n["children"]), *totals[k], hashlib.sha256(",".join(map(str, sorted(n["ends"]))).encode()).hexdigest())
        for k, n in nodes.items()
    ]


def check(spark, rows: list[tuple]) -> None:
    found = conversation_trie(spark.createDataFrame(rows, SCHEMA))
    assert found.columns == COLUMNS
    order = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(tuple, found.collect()), key=order) == sorted(plain(rows), key=order)


def test_generated_conversations(spark):
    rng = random.Random(3)
    rows = [(c, i, rng.choice(["user", "assistant"]), rng.choice("abc") * rng.randrange(3)) for c in [*range(0, 60), *range(130, 330, 3), -7, -250, 10**12] for i in range(rng.randrange(1, 9))]
    rng.shuffle(rows)
    check(spark, rows)


def test_nulls_empty_texts_repeats_and_copies(spark):
    rows = [(None, 1, "user", "x"), (5, None, None, None), (5, 1, "user", ""), (5, 1, "user", ""), (7, 0, "user", "😀é" * 10), (7, 1, None, "x" * 100_000), (100, None, "a", "b")]
    copies = [(c, i, "user", f"t{i}") for c in range(200, 260) for i in range(8)]
    check(spark, rows + copies)


def test_long_conversations_span_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    rng = random.Random(4)
    rows = [(c, i, "user", f"t{i}" if i < cut else f"t{i}.{c}") for c in range(24) for cut in [rng.randrange(30)] for i in range(rng.randrange(25, 40))]
    check(spark, rows)


def test_one_conversation_over_many_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(c, i, "user", str(i % 7)) for c in (100, 103) for i in range(500)] + [(101, 0, "user", "0")]
        check(spark, rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_table_and_clashing_columns(spark):
    assert conversation_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = spark.createDataFrame([(1, 0, "user", "x", 5, "k")], SCHEMA + ", depth int, k1 string")
    assert len(conversation_trie(rows).collect()) in (1, 2)


def test_query_equals_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from skarn.llm.queries import op11_prefix_trie, oracle_sql

    con = duckdb.connect()
    con.sql("CREATE VIEW conversations AS SELECT * FROM read_parquet('/root/testdata/sf0.001/conversations.parquet')")
    relation = con.sql(oracle_sql()["op11_prefix_trie"])
    at = [relation.columns.index(c) for c in COLUMNS]
    order = lambda r: tuple(-1 if x is None else x for x in r)
    want = sorted((tuple(r[i] for i in at) for r in relation.fetchall()), key=order)
    assert sorted(map(tuple, op11_prefix_trie(spark, "/root/testdata/sf0.001").select(*COLUMNS).collect()), key=order) == want
