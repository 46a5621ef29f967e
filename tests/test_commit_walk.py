"""The walk of commit graphs against a queue in one process, on generated graphs."""

from __future__ import annotations

import random
from collections import deque

import pytest

from skarn.operators import commit_walk as w
from skarn.sources import files as src

SCHEMA = "repo string, commit string, commit_ts long, parents array<string>"


def generated(seed, repos=4, size=60):
    rng, rows = random.Random(seed), []
    for r in range(repos):
        for i in range(size if r else 1):
            older = [f"{rng.choice('ab')}{r}-{i}"] if rng.random() < 0.05 else []  # not there
            count = rng.choice([1, 1, 1, 2, 3])
            older += [f"c{j}" for j in rng.sample(range(max(0, i - 9), i), min(i, count, i - max(0, i - 9)))]
            rows.append((f"r{r}", f"c{i}", 1000 * i + rng.randrange(-4000, 4000), older))
    return rows


def plain(rows, heads, most, not_before, since, all_parents):
    at, out = {(r, c): (t, p) for r, c, t, p in rows}, []
    for repo, head in heads:
        queue, seen, n = deque([head] if (repo, head) in at else []), {head}, 0
        while queue and n < most:
            commit = queue.popleft()
            stamp, parents = at[repo, commit]
            for p in parents if all_parents else parents[:1]:
                if p not in seen and (repo, p) in at:
                    seen.add(p)
                    queue.append(p)
            if since and commit.startswith(since):
                break
            if not_before is not None and stamp < not_before:
                if all_parents:
                    continue
                break
            out.append((repo, commit, len(parents) > 1, n))
            n += 1
    return sorted(out)


@pytest.mark.parametrize(("seed", "most", "not_before", "since", "all_parents"), [(1, 1000, None, None, True), (2, 20, 15_000, None, True), (3, 1000, 9_000, "c2", True), (4, 1000, 20_000, None, False), (5, 30, None, "c3", False)])
def test_equals_a_queue(spark, seed, most, not_before, since, all_parents):
    rows = generated(seed)
    heads = [(f"r{i}", "c59" if i else "c0") for i in range(4)] + [("gone", "c1")]
    got = w.walk_history(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(heads, "repo string, commit string"), most, not_before, since, all_parents, rows_per_block=40)
    assert sorted((r["repo"], r["commit"], r["is_merge"], r["commit_idx"]) for r in got.collect()) == plain(rows, heads, most, not_before, since, all_parents)


def test_long_history_in_few_rounds(spark):
    rows = [("r", f"c{i}", i, [f"c{i - 1}"] if i else None) for i in range(3000)] + [("r", "c5", 5, ["c4"])]
    got = w.walk_order(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("r", "c2999")], "repo string, commit string"), 1000)
    assert {(r["commit"], r["distance"], len(r["path"])) for r in got.collect()} == {(f"c{i}", 2999 - i, 0) for i in range(3000)}


def test_nothing_to_walk(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert w.walk_history(none, spark.createDataFrame([("r", "c")], "repo string, commit string")).isEmpty()
    assert w.walk_history(spark.createDataFrame(generated(1), SCHEMA), none.select("repo", "commit")).isEmpty()


def test_files_of_a_dump(spark, tmp_path):
    (tmp_path / "log").write_text("@c3 300 c2 c1\n\n@c2 200 c1\nR100\told.py\tnew.py\nM\tx.py\n@c1 100\nA\told.py\n")
    commits = src.git_commits(spark, str(tmp_path / "log"))
    changes = src.git_changes(spark, str(tmp_path / "log"))
    walk = w.walk_history(commits, commits.where("commit = 'c3'").select("repo", "commit"))
    got = {(r["commit_idx"], r["commit"], r["is_merge"], r["file"]) for r in w.walked_files(walk, changes).collect()}
    assert got == {(0, "c3", True, None), (1, "c2", False, "old.py"), (1, "c2", False, "new.py"), (1, "c2", False, "x.py"), (2, "c1", False, "old.py")}
