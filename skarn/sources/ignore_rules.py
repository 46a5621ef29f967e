"""Ignore files of a repository as rules, and the paths they leave.

A rule is looked up by the folder of its file and by what its last part says of a name: the name itself, its extension, or nothing. So paths and rules meet in an equi-join,
and only what meets is matched. The rule that decides a path is the last one that matches, of the deepest file of the strongest kind; below an ignored folder all is ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import parsed, read_files

#: Names of ignore files, the weakest first.
KINDS = (".git/info/exclude", ".gitignore", ".ignore")
_RULE = "base string, kind int, line int, negated boolean, folders_only boolean, regex string, key string"


def ignore_rules(files: DataFrame) -> DataFrame:
    """Rules of ignore files(path, content), paths relative to the repository: base (their folder), kind, line, negated, folders_only, regex (of a path below base) and key.
    Blank lines, comments and null contents give none; a backslash keeps the next character as it is."""
    kinds = KINDS

    def parse(path: str, content: str) -> Iterator[tuple]:
        import re

        kind = max((i for i, k in enumerate(kinds) if path == k or path.endswith("/" + k)), default=-1)
        if kind < 0:
            return
        base = path[: -len(kinds[kind])].rstrip("/")
        for number, line in enumerate(content.split("\n")):
            line = line.removesuffix("\r")
            while line.endswith(" ") and not line.endswith("\\ "):
                line = line[:-1]
            if not line or line.startswith("#"):
                continue
            negated = line.startswith("!")
            line = line[1:] if negated else line
            folders_only = line.endswith("/")
            line = line.removesuffix("/")
            if not line.strip("/"):
                continue
            anchored, parts = "/" in line, line.removeprefix("/").split("/")
            out = "" if anchored else "(?:.*/)?"
            for i, part in enumerate(parts):
                last = i == len(parts) - 1
                if part == "**" and anchored:
                    out += ".+" if last else "(?:.*/)?"
                    continue
                at = 0
                while at < len(part):
                    c = part[at]
                    end = part.find("]", at + 2 + (part[at + 1 : at + 2] in ("!", "^"))) if c == "[" else -1
                    if c == "*":
                        out += "[^/]*"
                    elif c == "?":
                        out += "[^/]"
                    elif end > 0:
                        inner, at = part[at + 1 : end], end
                        flip = inner[0] in "!^"
                        inner = re.sub(r"([\[\]&^\\])", r"\\\1", inner[1:] if flip else inner)
                        out += f"(?!/)[{'^' if flip else ''}{inner}]"
                    else:
                        at += c == "\\" and at + 1 < len(part)
                        out += re.sub(r"([^\w\s])", r"\\\1", part[at])
                    at += 1
                out += "" if last else "/"
            name = parts[-1]
            if not re.search(r"[*?\[\\]", name):
                key = "name " + name
            else:
                ends = re.fullmatch(r"\*\.([^.*?\[\\]+)", name)
                key = "ends " + ends[1] if ends else "any"
            yield base, kind, number, negated, folders_only, f"^{out}$", key

    return parsed(files, parse, _RULE)


def without_ignored(rows: DataFrame, rules: DataFrame, path: str = "path") -> DataFrame:
    """rows whose path, relative to the repository, no rule ignores; a null path stays."""
    parts = F.split(F.col("path"), "/")
    paths = rows.select(F.col(f"`{path}`").alias("path")).where("path is not null").distinct()
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("at"), (i < F.size(parts)).alias("folder")))
    entries = paths.select("path", F.explode(above).alias("e")).select("path", "e.at", "e.folder")
    own = F.split(F.col("at"), "/")
    bases = F.transform(F.sequence(F.lit(0), F.size(own) - 1), lambda i: F.array_join(F.slice(own, 1, i), "/"))
    tried = entries.select("at", "folder").distinct().select("at", "folder", F.element_at(own, -1).alias("name"), F.explode(bases).alias("base")).join(rules.select("base").distinct(), "base", "left_semi")
    keys = F.array(F.lit("any"), F.concat(F.lit("name "), "name"), F.concat(F.lit("ends "), F.regexp_extract("name", r"\.([^.]*)$", 1)))
    met = tried.withColumn("key", F.explode(keys)).join(rules, ["base", "key"]).where(F.col("folder") | ~F.col("folders_only"))
    below = F.when(F.col("base") == "", F.col("at")).otherwise(F.expr("substring(at, char_length(base) + 2)"))
    rank = F.struct("kind", F.char_length("base"), "line")  # bases of one path are prefixes of each other
    ignored = met.where(F.rlike(below, F.col("regex"))).groupBy("at").agg(F.max_by("negated", rank).alias("negated")).where("not negated").select("at")
    gone = entries.join(ignored, "at", "left_semi").select(F.col("path").alias("_ignored path")).distinct()
    return rows.join(gone, F.col(f"`{path}`") == F.col("`_ignored path`"), "left_anti")


def ignore_files(spark: SparkSession, root: str, paths: DataFrame) -> DataFrame:
    """(path, content) of the ignore files in the root and all folders above ``paths(path)``, read in the tasks; Spark's own readers pass hidden files over."""
    kinds = KINDS

    def run(batches: Iterator) -> Iterator:
        import pandas as pd
        from pyarrow import fs

        store, start = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
        for pdf in batches:
            out = []
            for folder in pdf["folder"]:
                for kind in kinds if folder == "" else kinds[1:]:
                    name = f"{folder}/{kind}".lstrip("/")
                    full = f"{start.rstrip('/')}/{name}"
                    if store.get_file_info(full).type == fs.FileType.File:
                        with store.open_input_stream(full) as stream:
                            out.append((name, stream.read().decode("utf-8", "replace")))
            yield pd.DataFrame(out, columns=["path", "content"])

    parts = F.split(F.col("path"), "/")
    folders = paths.select(F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("folder"))
    return folders.unionByName(spark.createDataFrame([("",)], "folder string")).distinct().mapInPandas(run, "path string, content string")


def walk_repository(spark: SparkSession, root: str, extensions: list[str] | None = None, most_bytes: int | None = None, ignored: list[str] | None = None) -> DataFrame:
    """(path, length, content) of a repository's files as :func:`skarn.sources.files.read_files` gives them, without those that its ignore files name; ``extensions``: only these."""
    found = read_files(spark, root, None, most_bytes, ignored)
    if extensions is not None:
        found = found.where(F.regexp_extract("path", r"\.([^./]*)$", 1).isin(extensions))
    rules = ignore_rules(ignore_files(spark, root, found.select("path")))
    return without_ignored(found, rules)
