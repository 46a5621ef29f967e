"""Ignore rules against git itself, on generated trees, and by hand where the two differ."""

from __future__ import annotations

import random
import shutil
import subprocess

import pytest

from skarn.sources import ignore_rules as g

PARTS = ["a", "b", "src", "x.py", "y.rs", "*.py", "*", "?", "[ab]", "[!a]", "s*c", "**", "[a-c]x", "\\a", "x.*", "z w"]


def generated(root, seed):
    rng = random.Random(seed)
    folders = [""] + sorted({"/".join(rng.choice(["a", "b", "src", "cx"]) for _ in range(rng.randrange(1, 4))) for _ in range(12)})
    paths = sorted({f"{f}/{n}".lstrip("/") for f in folders for n in rng.sample(["x.py", "y.rs", "a.md", "q", "z w", "ab.py"], 4)})
    for p in paths:
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        if not (root / p).is_dir():
            (root / p).write_text("t")
    for f in rng.sample(folders, 5) + [""]:
        lines = ["# note", "", "\\#x"]
        for _ in range(rng.randrange(2, 6)):
            body = "/".join(rng.choice(PARTS) for _ in range(rng.choice([1, 1, 1, 2, 3])))
            lines.append(("!" if rng.random() < 0.35 else "") + ("/" if rng.random() < 0.25 else "") + body + ("/" if rng.random() < 0.25 else "") + ("  " if rng.random() < 0.1 else ""))
        (root / f / ".gitignore").write_text("\n".join(lines) + "\n")
    return [p for p in paths if (root / p).is_file()]


@pytest.mark.skipif(shutil.which("git") is None, reason="no git")
@pytest.mark.parametrize("seed", range(20))
def test_equals_git(spark, tmp_path, seed):
    paths = generated(tmp_path, seed)
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    (tmp_path / ".git/info/exclude").write_text("q\n!b/q\n")
    out = subprocess.run(["git", "-C", str(tmp_path), "-c", "core.quotepath=off", "check-ignore", "--no-index", "--stdin", "-z"], input="\0".join(paths), capture_output=True, text=True).stdout
    want = sorted(set(paths) - set(out.split("\0")))
    assert sorted(r["path"] for r in g.walk_repository(spark, str(tmp_path)).select("path").collect()) == want


def test_ignore_file_is_stronger_and_nulls_stay(spark):
    files = spark.createDataFrame([(".ignore", "*.py\n"), ("a/.gitignore", "!*.py\n*.rs\n"), (".gitignore", None), ("a/.other", "*")], "path string, content string")
    rows = spark.createDataFrame([("a/x.py", 1), ("a/y.rs", 2), ("a/z.md", 3), (None, 4), ("y.rs", 5), ("y.rs", 5)], "name string, n int")
    assert sorted(r["n"] for r in g.without_ignored(rows, g.ignore_rules(files), "name").collect()) == [3, 4, 5, 5]
    assert g.without_ignored(rows, g.ignore_rules(files.limit(0)), "name").count() == 6


def test_extensions_and_size(spark, tmp_path):
    for name, text in {"a/x.py": "1", "a/y.rs": "2", "gone/z.py": "3", "big.py": "4" * 99}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / ".gitignore").write_text("gone/\r\n")
    assert [r["path"] for r in g.walk_repository(spark, str(tmp_path), ["py"], 50).collect()] == ["a/x.py"]
