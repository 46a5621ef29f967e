"""The join of patterns and texts against plain loops."""

from __future__ import annotations

import random

import pytest
import regex

from skarn.operators import many_patterns as m
from skarn.operators.predicates import forbidden_terms


def brute(texts, patterns, words):
    def holds(text, p):
        return p in text and (not words or regex.search(r"(?<!\w)" + regex.escape(p) + r"(?!\w)", text) is not None)

    return sorted((k, t, p) for k, t in texts for p in patterns if t and p and holds(t, p))


def found(spark, texts, patterns, words=False, **how):
    t = spark.createDataFrame(texts, "id long, text string")
    p = spark.createDataFrame([(x,) for x in patterns], "pattern string")
    return sorted((r["id"], r["text"], r["pattern"]) for r in m.find_patterns(t, p, "id", "text", "pattern", words, few=0, **how).collect())


def random_case(seed):
    rng = random.Random(seed)
    letters = "ab_ .$éß中😀"
    texts = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 7, 30, 200]))) for _ in range(60)] + [None, "", "a" * 50]
    patterns = [None, "", "zz", "q" * 40]
    for t in texts:
        for size in (1, 2, 3, 7, 8, 9, 23, 24, 25, 60):
            if t and len(t) >= size:
                at = rng.randrange(len(t) - size + 1)
                patterns.append(t[at : at + size])
    return [(i // 2, t) for i, t in enumerate(texts)], sorted(set(patterns) - {None}) + [None]


@pytest.mark.parametrize("words", [False, True])
def test_equals_plain_loops(spark, words):
    texts, patterns = random_case(3)
    assert found(spark, texts, patterns, words) == brute(texts, patterns, words)


def test_without_known_grams_and_in_pieces(spark, monkeypatch):
    texts, patterns = random_case(4)
    monkeypatch.setattr(m, "PIECE", 16)
    assert found(spark, texts, patterns, most_known=10) == brute(texts, patterns, False)
    assert found(spark, texts, patterns) == brute(texts, patterns, False)


def test_broadcast_side_has_the_same_rules(spark):
    texts = spark.createDataFrame([(1, "say $x now"), (1, "say$x"), (None, "$x"), (2, None), (3, "")], "id long, text string")
    few = spark.createDataFrame([("$x",), ("$x",), (None,), ("",)], "pattern string")
    for how in (16, 0):
        assert sorted(r["text"] for r in m.find_patterns(texts, few, "id", "text", "pattern", True, few=how).collect()) == ["$x", "$x", "say $x now", "say $x now"]
    assert m.find_patterns(texts.limit(0), few, "id", "text", "pattern", few=0).isEmpty()
    assert m.find_patterns(texts, few.limit(0), "id", "text", "pattern", few=0).isEmpty()
    with pytest.raises(ValueError):
        m.find_patterns(texts, few.withColumnRenamed("pattern", "Text"), "id", "text", "Text")


def test_a_hundred_thousand_patterns(spark):
    names = spark.range(100_000).selectExpr("concat('symbol_', id) AS pattern")
    texts = spark.range(2000).selectExpr("id", "concat('use symbol_', id * 37, '; call(symbol_', id * 41, 'x, symbol_', id, ')') AS text")
    got = {(r["id"], r["pattern"]) for r in m.find_patterns(texts, names, "id", "text", "pattern", words=True).collect()}
    assert got == {(i, f"symbol_{i * 37}") for i in range(2000) if i * 37 < 100_000} | {(i, f"symbol_{i}") for i in range(2000)}


def test_symbol_dependencies(spark):
    files = spark.createDataFrame([("a.rs", "fn f() { remote_api(); }", ["x"], []), ("b.rs", "map_item", ["lib::api::v2"], []), ("c.rs", "", [], ["api"]), ("d.rs", "api", [], []), ("e.rs", "remote_api2", [], [])], "path string, content string, imports array<string>, exports array<string>")
    symbols = spark.createDataFrame([("a.rs", "f"), ("a.rs", "f"), ("b.rs", "map_item"), ("c.rs", "c"), ("e.rs", "e")], "path string, symbol_name string")
    interfaces = spark.createDataFrame([("s", "remote_api"), ("s", "api"), ("t", "api")], "sibling string, symbol string")
    assert sorted(map(tuple, m.symbol_dependencies(files, symbols, interfaces).collect())) == [("s", "c", "api"), ("s", "f", "remote_api"), ("s", "map_item", "api"), ("t", "c", "api"), ("t", "map_item", "api")]


def test_many_rules(spark):
    rules = spark.createDataFrame([(f"NO Term{i}.", None if i % 2 else r"^src/") for i in range(300)], "rule string, glob string")
    actions = spark.createDataFrame([(i, f"use tErm{i}. here", ("src/" if i % 4 else "lib/") + str(i)) for i in range(300)], "tx_id long, action string, entity string")
    assert {(r["tx_id"], r["term"]) for r in forbidden_terms(rules, actions).collect()} == {(i, f"Term{i}.") for i in range(300) if i % 4}


@pytest.mark.parametrize("piece", [1 << 17, 64])
def test_texts_of_a_batch_are_sampled_together(monkeypatch, piece):
    """Short texts don't cost a batch each, and a gram never spans two texts: each text gives what it gives alone."""
    import pyarrow as pa

    monkeypatch.setattr(m, "PIECE", piece)
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab é😀") for _ in range(rng.choice([0, 1, 5, 23, 30, 90]))) for _ in range(400)] + [None, "a" * 300, "a" * 300]
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows])], names=["key", "value"])
    grams = lambda out: {(k, g) for b in out for k, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
    for own in (False, True):
        run = m._sampler(list(m.TIERS), own)
        together = list(run([batch(list(enumerate(texts))).slice(3)]))
        assert grams(together) == set().union(*(grams(run([batch([(i, t)])])) for i, t in enumerate(texts) if i > 2 and t))
        assert piece == 64 or len(together) == len(m.TIERS)
