"""The persisted index: writes, deletions and merges equal a rebuild; ranking, fuzzy terms and snippets against plain Python."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest

from skarn.operators import search_index as si
from skarn.operators.search_index import SearchIndex, best_piece, edit_distance

SCHEMA = "doc_id long, path string, text string"
WORDS = ["alpha", "beta", "gamma", "alpah", "delta", "license", "lisence", "licenses", "x" * 40, "x" * 39 + "y", "parseFile", "HTTPServer", "naïve", "12"]


def docs(seed, ids, most=60):
    rng = random.Random(seed)
    return [(i, f"src/{rng.choice(WORDS[:5])}/f{i}.rs", "\n".join(" ".join(rng.choice(WORDS) for _ in range(rng.randrange(6))) for _ in range(rng.randrange(most // 5)))) for i in ids]


def tokens(text):
    return [m.group().lower() for m in si._WORD.finditer(text)]


def plain_rank(rows, query, limit):
    fields = {"content": {i: tokens(t or "") for i, _, t in rows}, "path": {i: tokens(p or "") for i, p, _ in rows}}
    scores = Counter()
    for held in fields.values():
        n, mean = len(held), sum(map(len, held.values())) / len(held)
        for term in set(tokens(query)):
            df = sum(term in ts for ts in held.values())
            for i, ts in held.items():
                if tf := ts.count(term):
                    scores[i] += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ts) / mean))
    return sorted(((i, round(s, 6)) for i, s in scores.items()), key=lambda x: (-x[1], x[0]))[:limit]


def ranked(index, query, limit=10):
    return [(r["doc"], round(r["score"], 6)) for r in index.ranked(query, limit, prefilter=False).collect()]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    index = SearchIndex.create(spark, str(tmp_path_factory.mktemp("index")), buckets=4)
    first, second = docs(1, range(60)), docs(2, [*range(40, 70), 90])
    index.add(frame([*first, (None, "p", "alpha")]), path="path")
    index.add(frame([*second, (91, None, None), (92, "a", "alpha"), (92, "a", "beta")]), path="path")
    index.delete(frame([(3, None, None), (50, None, None), (1000, None, None)]))
    index.add(frame([(3, "src/back.rs", "alpha again")]), path="path")
    live = {r[0]: r for r in first} | {r[0]: r for r in second} | {91: (91, None, None), 92: (92, "a", "beta"), 3: (3, "src/back.rs", "alpha again")}
    del live[50]
    return index, list(live.values())


def test_writes_and_deletions_equal_the_live_rows(built):
    index, live = built
    assert sorted((r["doc"], r["path"], r["content"]) for r in index.documents().collect()) == sorted((i, p or "", t or "") for i, p, t in live)
    for query in ("alpha license", "parse HTTPServer src", "nowhere", ""):
        assert ranked(index, query) == plain_rank(live, query, 10)


def test_blocks_below_the_best_are_ruled_out_exactly(built, monkeypatch):
    index, live = built
    monkeypatch.setattr(si, "WAVE", 3)
    for query, limit in (("gamma beta", 3), ("alpha", 5), ("license src f7", 2)):
        assert ranked(index, query, limit) == plain_rank(live, query, limit)


def test_only_the_partitions_of_its_terms_are_read(built):
    index, _ = built
    plan = index._live("postings", si._POSTINGS, index._state(), index._of("content", ["alpha"]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:80]


def test_fuzzy_equals_distances_to_all_terms(built):
    index, live = built
    vocabulary = {t for _, _, text in live for t in tokens(text or "")}
    for term in ("alhpa", "license", "licnese", "x" * 40, "x" * 38 + "yx", "a", "", "PARSE"):
        want = {(t, d) for t in vocabulary if (d := edit_distance(t, term.lower())) <= 2}
        assert {(r["term"], r["distance"]) for r in index.terms_near(term).collect() if r["term"] in vocabulary} == want
    got = [(r["distance"], r["term"], r["doc"]) for r in index.fuzzy("alhpa", None).collect()]
    assert got == sorted(got) and {(t, d) for _, t, d in got} == {(t, i) for i, _, text in live for t in set(tokens(text or "")) if edit_distance(t, "alhpa") <= 2}


def test_distances():
    assert [edit_distance(*p) for p in (("ab", "ba"), ("ca", "abc"), ("kitten", "sitting"), ("", "xy"), ("same", "same"))] == [1, 3, 3, 2, 0]


def test_snippets_lines_and_bold():
    text = "filler words here " * 20 + "\nthe license of\nthe Apache license " + "tail " * 60
    snippet, shown, line = best_piece(text, {"license": 2.0, "apache": 3.0}, bold=("<", ">"))
    assert "Apache license" in snippet and len(snippet) <= 150 and snippet in text and shown.replace("<", "").replace(">", "") == snippet and "<Apache> <license>" in shown
    assert line == text.count("\n", 0, text.index(snippet)) + 1
    assert best_piece("nothing", {"license": 1.0}) == (None, None, None) == best_piece("", {"a": 1.0})
    assert best_piece("w" * 400 + " license", {"license": 1.0})[0] == "license"


def test_search_falls_back_to_near_terms_and_finds_paths(built):
    index, live = built
    hit = index.search("HTTPServer back", 5).collect()
    assert hit[0]["doc"] == 3 and hit[0]["snippet"] is None and hit[0]["line_count"] == 1  # only its path holds a term
    near = index.search("licensse", 4).collect()
    assert near and all(r["score"] < 0 and r["snippet"] for r in near)
    # A word's trigrams must all be in the content.
    assert {r["doc"] for r in index.ranked("alpha", 100).collect()} == {i for i, _, t in live if t and "alpha" in tokens(t)}


def test_regex_and_hybrid(built):
    index, live = built
    lines = {(i, k) for i, _, t in live for k, line in enumerate((t or "").split("\n"), 1) if "beta gamma" in line}
    assert {(r["doc"], r["line"]) for r in index.regex("beta +gamma").collect()} == lines
    rows = [tuple(r) for r in index.hybrid("gamma", "beta gamma", 8).collect()]
    assert [r[2] for r in rows] == sorted(r[2] for r in rows) and len({r[:2] for r in rows}) == len(rows)


def test_a_merge_changes_no_answer(built):
    index, live = built
    before = ranked(index, "alpha license", 20)
    index.merge()
    assert len(index._state()[1]) == 1 and ranked(index, "alpha license", 20) == before == plain_rank(live, "alpha license", 20)
    assert {r["term"] for r in index.terms_near("license").collect()} <= {t for _, _, text in live for t in tokens(text or "")}


def test_without_neighbourhoods_all_terms_are_compared(spark, tmp_path):
    index = SearchIndex.create(spark, str(tmp_path), 2, neighbourhoods=False)
    index.add(spark.createDataFrame([(1, "p", "license licnese other"), (2, "p", "a " + "x" * 40)], SCHEMA), path="path")
    assert sorted(map(tuple, index.terms_near("license").collect())) == [("license", 0), ("licnese", 1)]
    assert [tuple(r) for r in index.terms_near("b").collect()] == [("a", 1)]
