from __future__ import annotations

import re
from collections import Counter

from llm_fixtures import frame, prose
from pyspark.sql import functions as F

from skarn.llm.line_runs import LineRuns, dedup_lines
from skarn.llm.vp_simhash import near_duplicates, simhash


def _key(line):
    return re.sub(r"^[\x20\x09-\x0d]+|[\x20\x09-\x0d]+$", "", line).translate({c: c + 32 for c in range(65, 91)})


def _brute(rows, least):
    found = Counter(k for r in rows for k in {_key(x) for x in (r["text"] or "").split("\n")} if k)
    out = []
    for r in rows:
        lines = (r["text"] or "").split("\n")
        kept = [x for x in lines if found[_key(x)] < least]
        out.append((r["doc_id"] is None, r["doc_id"], len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def _got(df):
    return sorted(((r["doc_id"] is None, r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in df.collect()), key=str)


def test_lines_against_brute_force(spark, odd, none):
    rows = [(i, "\n".join(["Common Line", f"  common line\t{i % 3}", prose(i, 5), "", "Émile" if i % 2 else "émile", " COMMON line "][: 2 + i % 5]), "en", "a") for i in range(40)]
    docs = frame(spark, rows)
    for least in (2, 10):
        assert _got(dedup_lines(docs, min_docs=least)) == _brute(docs.collect(), least)
    assert _got(dedup_lines(odd.withColumn("n_lines", F.lit("x")).withColumn("h1", F.lit(1)), min_docs=2)) == _brute(odd.collect(), 2)
    assert dedup_lines(none).collect() == []


def test_runs_compact_and_saturate(spark):
    docs = frame(spark, [(i, f"all\nonly {i}\nhalf {i % 2}", "en", "a") for i in range(12)])
    runs = LineRuns(spark, min_docs=4)
    for b in range(4):
        runs.add(docs.where(F.col("doc_id") % 4 == b))
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    assert runs.finish().distinct().count() == 3


def _popcount(a, b):
    return bin(a ^ b).count("1")


def _components(rows, bits):
    fps = [simhash(r["text"]) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if _popcount(fps[i], fps[j]) <= bits:
                parent[find(i)] = find(j)
    members = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(rows[i]["doc_id"])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in members.items()}
    return sorted(((rows[i]["doc_id"], fps[i], least[find(i)]) for i in range(len(rows))), key=str)


def test_components_against_brute_force(spark, odd, none):
    base = [prose(i, 60).split() for i in range(30)]
    rows, n = [], 0
    for k, words in enumerate(base):
        for copy in range(1 + k % 5):
            edited = list(words)
            for c in range(copy):
                edited[(7 * c + k) % 60] = f"x{copy}{c}"
            rows.append((n, " ".join(edited), "en", "a"))
            n += 1
    for docs in (frame(spark, rows), odd.withColumn("fp", F.lit(1))):
        got = sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in near_duplicates(docs).collect()), key=str)
        assert got == _components(docs.collect(), 3)
    assert near_duplicates(none).collect() == []


def test_deep_trees_lose_no_pair(spark, monkeypatch):
    import numpy as np

    from skarn.llm import vp_simhash

    rng = np.random.default_rng(2)
    fps = rng.integers(0, 2**63, 600, dtype=np.uint64)
    near = fps[:300] ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64))
    every = np.unique(np.concatenate([fps, near]))
    trees = [vp_simhash.Tree(every, 5, high) for high in (False, True)]
    met = set()
    for tree in trees:
        shard, idx, home = tree.route(every, 1)
        for s in np.unique(shard):
            own, guests = idx[(shard == s) & home], idx[shard == s]
            for i in own:
                for j in guests:
                    if i != j and _popcount(int(every[i]), int(every[j])) <= 3:
                        met.add((min(i, j), max(i, j)))
    brute = {(i, j) for i in range(len(every)) for j in np.flatnonzero(np.bitwise_count(every ^ every[i]) <= 3).tolist() if i < j}
    assert met == brute and len(brute) >= 250
