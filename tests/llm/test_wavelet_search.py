"""Ranked search over wavelet trees against scores of every document."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from llm_fixtures import frame, prose
from pyspark.sql import functions as F

from skarn.llm import wavelet_search
from skarn.llm.common import Scratch
from skarn.llm.wavelet_search import build, corpus_size, rank_documents, search, terms

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text: str | None) -> list[str]:
    return _TERM.findall((text or "").translate(UPPER))


def plain(docs: list[tuple], items: list[tuple], k: int = 10) -> list[tuple]:
    counts = [(i, Counter(plain_terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        words = {t for t in plain_terms(text) if t in df}
        scored = []
        for i, c in counts:
            m = 100 - 90 + 90 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in words if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return out


def rows(df) -> list[tuple]:
    order = lambda r: tuple((x is None, x or 0) for x in r)
    return sorted(map(tuple, df.collect()), key=order)


def check(spark, docs: list[tuple], items: list[tuple], parts: int = 3, k: int = 10) -> None:
    order = lambda r: tuple((x is None, x or 0) for x in r)
    table = frame(spark, [(i, t, "en", "a") for i, t in docs]).repartition(parts)
    found = rank_documents(table, spark.createDataFrame(items, "item_id long, text string"), k)
    assert rows(found) == sorted(plain(docs, items, k), key=order)


@pytest.mark.parametrize("postings", [1, 500, 1 << 20])
def test_equals_scores_of_every_document(spark, monkeypatch, postings):
    monkeypatch.setattr(wavelet_search, "STEP", 7)
    monkeypatch.setattr(build, "__defaults__", (*build.__defaults__[:-1], postings))
    rng = random.Random(postings)
    docs = [(rng.randrange(10**6), prose(s, rng.choice([1, 5, 40, 300]), rng.choice([30, 400]))) for s in range(150 if postings > 1 else 25)]
    items = [(q, prose(1000 + q, rng.choice([1, 4, 25]), 400)) for q in range(12)]
    check(spark, docs, items)
    check(spark, docs, items[:3], k=1)


def test_many_copies_tie_by_id(spark):
    copies = [(i, "alpha beta gamma") for i in range(300, 0, -1)] + [(1000, "alpha"), (None, "alpha beta gamma"), (7, "alpha beta gamma")]
    check(spark, copies, [(1, "alpha beta"), (2, "gamma"), (3, "alpha alpha delta")])
    check(spark, copies[:8] + copies[-2:], [(1, "beta")])  # the row without an id comes last


def test_odd_rows_and_terms(spark, odd, none):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    items = [(1, "tail W1 w2"), (2, None), (3, ""), (4, "!!! --"), (5, "ΟΔΟΣ οδοσ 日本語 naïve"), (None, "line same"), (5, "12345 İstanbul"), (6, "nowhere")]
    check(spark, docs, items)
    for text in [t for _, t in docs if t]:
        assert terms(text.encode()) == [t.encode() for t in plain_terms(text)]
    queries = spark.createDataFrame(items, "item_id long, text string")
    assert rank_documents(none, queries).collect() == [] == rank_documents(odd, queries.where("false")).collect()


def test_sizes_of_batches_that_begin_anywhere(spark):
    docs = frame(spark, [(i, t, None, None) for i, t in enumerate(["", "a", "b c", None, "...", "-x", "x-", "é", " ", "y"])])
    assert corpus_size(docs) == (6, 7)
    assert corpus_size(docs.where("doc_id > 2")) == (4, 4)


def test_query_blocks_and_a_kept_index(spark, monkeypatch):
    monkeypatch.setattr(wavelet_search, "QUERY_BYTES", 100)
    docs = [(i, prose(i, 60, 90)) for i in range(60)]
    items = [(q, prose(500 + q, 6, 90)) for q in range(9)]
    table = frame(spark, [(i, t, None, None) for i, t in docs])
    path = Scratch(spark, "kept").path("index")
    build(table, path, corpus_size(table), postings=900)
    kept = spark.read.parquet(path)
    assert kept.count() > 1
    queries = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("clash"))
    assert rows(search(kept, queries, corpus_size(table)[0])) == sorted(plain(docs, items))


def test_query_equals_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from skarn.llm.queries import op12_ranked_search, oracle_sql

    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/{t}.parquet')")
    relation = con.sql(oracle_sql()["op12_ranked_search"])
    at = [relation.columns.index(c) for c in ("item_id", "rank", "doc_id", "score")]
    assert rows(op12_ranked_search(spark, path)) == sorted(tuple(r[i] for i in at) for r in relation.fetchall())
