"""The passes that write the persisted index, and what an index without words or without a cap answers."""

from __future__ import annotations

import os

import pytest

from skarn.operators.search_index import SearchIndex


def test_an_index_of_trigrams_only_writes_no_words(spark, tmp_path):
    """a question for lines first made the postings, summaries and vocabulary of all texts."""
    rows = [(i, f"line one\nLicensed under the {'MIT' if i % 3 else 'CC'}\r\nİ😀x") for i in range(40)] + [(7, "zz"), (50, None)]
    index = SearchIndex.create(spark, str(tmp_path), buckets=4, words=False)
    index.add(spark.createDataFrame(rows, "doc_id long, text string"))
    index.delete(spark.createDataFrame([(1,)], "doc_id long"))
    assert not {"postings", "near", "long"} & set(os.listdir(tmp_path))
    want = {i for i in range(40) if i not in (1, 7)}  # of 7 the greatest content stays
    assert {r["doc"] for r in index.regex("under the (MIT|CC)").collect()} == want
    assert {r["doc"] for r in index.candidates(["İ😀x".lower()[-3:]]).collect()} == want
    with pytest.raises(ValueError):
        index.ranked("line")


def test_posting_lists_equal_tokens_in_place(spark, tmp_path):
    """each (term, document) was a row of its own that was shuffled and sorted, and documents were tokenised four times."""
    import random

    import numpy as np
    from skarn.functions.text import code_tokens
    from skarn.operators import search_passes as sp

    rng = random.Random(4)
    letters = "abAB1 _-éİǅŸ²ª—ΣЖx😀\nȺßÄ"
    texts = [(i, "".join(rng.choice(letters[: rng.choice((9, 10, len(letters)))]) for _ in range(rng.randrange(60)))) for i in range(300)]
    texts += [(1000 + c, f"aB{chr(c)}Cd{chr(c)}{chr(c).upper()}x {chr(c)}") for c in [*range(0x250), *range(0x2000, 0x2070)]]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    index = SearchIndex.create(spark, str(tmp_path), buckets=4, neighbourhoods=False, trigrams=False)
    index.add(frame)
    want = {r["doc_id"]: r["ts"] for r in frame.select("doc_id", code_tokens(frame["text"]).alias("ts")).collect()}
    got, lengths, rows = {i: {} for i in want}, {}, 0
    for r in spark.read.parquet(f"{tmp_path}/postings").where("field = 'content'").collect():
        records = np.frombuffer(r["postings"], sp.POSTING)
        rows += 1
        if not r["term"]:
            lengths |= {int(x["doc"]): int(x["length"]) for x in records}
            continue
        steps, at = np.frombuffer(r["positions"], "<i4"), 0
        for x in records:
            got[int(x["doc"])] |= {int(p): r["term"] for p in np.cumsum(steps[at : at + x["tf"]])}
            at += x["tf"]
            assert x["length"] == len(want[int(x["doc"])])
        assert at == len(steps)
        for s in np.frombuffer(r["summary"], sp.SUMMARY):
            mine = records[records["block"] == s["block"]]
            assert (s["tf"], s["length"]) == (mine["tf"].max(), mine["length"].min())
    assert {i: [ts[k] for k in sorted(ts)] for i, ts in got.items()} == want and lengths == {i: len(ts) for i, ts in want.items()}
    assert rows < sum(len(set(ts)) for ts in want.values()) / 2


def test_neighbourhoods_of_prefixes_lose_no_term(spark, tmp_path):
    """a term of 32 characters had 529 strings, a lookup's join partners."""
    import random

    from skarn.operators.search_index import edit_distance

    rng = random.Random(9)
    words = {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 13))) for _ in range(1500)} | {"abcdefg" + x + "z" * 24 for x in ("h", "hi", "ih", "x", "")} | {"1234567890" + str(i) for i in range(40)}
    index = SearchIndex.create(spark, str(tmp_path), buckets=2, trigrams=False)
    index.add(spark.createDataFrame([(0, " ".join(sorted(words)))], "doc_id long, text string"))
    assert spark.read.parquet(f"{tmp_path}/near").groupBy("term").count().agg({"count": "max"}).first()[0] <= 37
    for asked in ("abba", "aabbabab", "babababab", "abbaabbaabba", "abcdefgih" + "z" * 24, "21345678903", "b"):
        assert {(r["term"], r["distance"]) for r in index.terms_near(asked).collect()} == {(t, d) for t in words if (d := edit_distance(t, asked)) <= 2}


def test_long_lines_are_found_unless_a_cap_is_given(spark, tmp_path):
    """lines over 1000 bytes were left out, with no other way."""
    index = SearchIndex.create(spark, str(tmp_path), buckets=2, words=False)
    index.add(spark.createDataFrame([(1, "x" * 2000 + " needle\nneedle")], "doc_id long, text string"))
    assert {(r["doc"], r["line"]) for r in index.regex("needle").collect()} == {(1, 1), (1, 2)}
    assert {(r["doc"], r["line"]) for r in index.regex("needle", longest_line=1000).collect()} == {(1, 2)}
