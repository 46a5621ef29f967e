"""File sources and sinks. Whole files are read by Spark's own readers, so any store Spark knows works; parsers run on each file in parallel."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import clean_text
from ..functions.text import matches_any


#: The largest file that text search reads.
SEARCH_BYTES = 1_000_000


def read_files(spark: SparkSession, root: str, glob: str | None = None, most_bytes: int | None = None, ignored: list[str] | None = None) -> DataFrame:
    """(path, length, content): text files below a folder; files above ``most_bytes`` (give ``SEARCH_BYTES`` for text search; a repository walk has no limit), hidden folders and ignored globs are skipped, bad UTF-8 is replaced, control characters go."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    base = root.rstrip("/")
    rows = reader.load(root).withColumn("path", F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), "^" + re.escape(re.sub(r"^file:/+", "/", base)) + "/", ""))
    rows = rows.where(~F.col("path").rlike(r"(^|/)\.[^/]+/"))
    if most_bytes is not None:
        rows = rows.where(F.col("length") <= most_bytes)
    if ignored:
        rows = rows.where(~matches_any(F.col("path"), ignored))
    return rows.select("path", "length", clean_text(F.expr("make_valid_utf8(cast(content AS string))")).alias("content"))


def parsed(files: DataFrame, parse: Callable[[str, str], Iterable[tuple]], schema: str) -> DataFrame:
    """Rows of a per-file parser (path, content) -> rows; files that can't be parsed give none, as in a scan."""
    import pandas as pd

    names = [c.strip().split(" ")[0] for c in re.split(r",(?![^<]*>)", schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    out += list(parse(path, content or ""))
                except (ValueError, KeyError, TypeError, AttributeError):
                    continue
            yield pd.DataFrame(out, columns=names)

    return files.select("path", "content").mapInPandas(run, schema)


def git_log(spark: SparkSession, path: str) -> DataFrame:
    """(commit, commit_ts, is_merge, file) of a dump by ``git log --name-status --format='@%H %ct %P'``; a rename gives both paths."""

    def parse(_: str, text: str) -> Iterator[tuple]:
        commit = stamp = merge = None
        for line in text.splitlines():
            if line.startswith("@"):
                commit, stamp, *parents = line[1:].split(" ")
                stamp, merge = int(stamp), len([p for p in parents if p]) > 1
                yield commit, stamp, merge, None
            elif "\t" in line and commit:
                for f in line.split("\t")[1:]:
                    yield commit, stamp, merge, f

    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))
    rows = parsed(files, parse, "commit string, ts long, is_merge boolean, file string")
    return rows.select("commit", F.timestamp_seconds("ts").alias("commit_ts"), "is_merge", "file")


def _dumps(spark: SparkSession, path: str, parse: Callable[[str, str], Iterable[tuple]], schema: str) -> DataFrame:
    return parsed(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content")), parse, schema)


def git_commits(spark: SparkSession, path: str) -> DataFrame:
    """(repo, commit, commit_ts, parents) of dumps as in :func:`git_log`, one file a repository, named by it."""

    def parse(name: str, text: str) -> Iterator[tuple]:
        for line in text.splitlines():
            if line.startswith("@"):
                commit, stamp, *parents = line[1:].split(" ")
                yield name, commit, int(stamp), [p for p in parents if p]

    rows = _dumps(spark, path, parse, "repo string, commit string, ts long, parents array<string>")
    return rows.select("repo", "commit", F.timestamp_seconds("ts").alias("commit_ts"), "parents")


def git_changes(spark: SparkSession, path: str) -> DataFrame:
    """(repo, commit, file, old_file) of the same dumps; a rename or copy has an old file."""

    def parse(name: str, text: str) -> Iterator[tuple]:
        commit = None
        for line in text.splitlines():
            if line.startswith("@"):
                commit = line[1:].split(" ")[0]
            elif "\t" in line and commit:
                _, *paths = line.split("\t")
                yield name, commit, paths[-1], paths[0] if len(paths) > 1 else None

    return _dumps(spark, path, parse, "repo string, commit string, file string, old_file string")


def lcov(files: DataFrame) -> DataFrame:
    """(test_file, file_path, confidence): covered source files of lcov traces, at each end of record."""

    def parse(path: str, text: str) -> Iterator[tuple]:
        source = None
        for line in text.splitlines():
            if line.startswith("SF:"):
                source = line[3:].strip().replace("\\", "/")
            elif line.strip() == "end_of_record" and source:
                yield path, source, 0.9
                source = None

    return parsed(files, parse, "test_file string, file_path string, confidence double")


def openapi(files: DataFrame) -> DataFrame:
    """(spec_path, method, path, summary, tags, embed_text) of OpenAPI 3 and Swagger 2 documents in JSON or YAML."""
    verbs = ("get", "put", "post", "delete", "options", "head", "patch", "trace")

    def parse(path: str, text: str) -> Iterator[tuple]:
        spec = _load(path, text)
        base = spec.get("basePath", "") if "swagger" in spec else ""
        for route, item in (spec.get("paths") or {}).items():
            for verb in verbs:
                if isinstance(op := item.get(verb), dict):
                    summary, tags = op.get("summary") or op.get("description") or "", [str(t) for t in op.get("tags") or []]
                    yield path, verb.upper(), base.rstrip("/") + route, summary, tags, " ".join([verb.upper(), route, summary, *tags]).strip()

    return parsed(files, parse, "spec_path string, method string, path string, summary string, tags array<string>, embed_text string")


def _load(path: str, text: str) -> dict:
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as error:
        raise ValueError("YAML needs the yaml package") from error
    try:
        return yaml.safe_load(text) or {}
    except yaml.YAMLError as error:
        raise ValueError(str(error)) from error


def cargo_lock(files: DataFrame) -> DataFrame:
    """(lock, name, version, source, dep_name, dep_version): packages and their resolved dependencies: the only one of the name, else the one of the
    version asked for, else one of the same source, else the first."""

    def parse(path: str, text: str) -> Iterator[tuple]:
        import tomllib

        packages = tomllib.loads(text).get("package", [])
        by: dict[str, list[dict]] = {}
        for p in packages:
            by.setdefault(p["name"], []).append(p)
        for p in packages:
            wanted = p.get("dependencies") or []
            if not wanted:
                yield path, p["name"], p.get("version"), p.get("source"), None, None
            for d in wanted:
                name, _, rest = d.partition(" ")
                found = by.get(name, [])
                version = rest.split(" ")[0] if rest else None
                pick = found[0] if len(found) == 1 else next((x for x in found if version and x.get("version") == version), None) or next((x for x in found if x.get("source") == p.get("source")), None) or (found[0] if found else {})
                yield path, p["name"], p.get("version"), p.get("source"), name, pick.get("version")

    return parsed(files, parse, "lock string, name string, version string, source string, dep_name string, dep_version string")


def osv(spark: SparkSession, path: str) -> DataFrame:
    """(path, package, version, ecosystem, advisory) of scanner results."""
    one = "source struct<path:string>, packages array<struct<package:struct<name:string,version:string,ecosystem:string>,vulnerabilities:array<struct<id:string>>>>"
    rows = spark.read.schema(f"results array<struct<{one.replace('source struct', 'source:struct').replace(', packages array', ',packages:array')}>>").json(path, multiLine=True)
    p = rows.select(F.explode("results").alias("r")).select(F.replace("r.source.path", F.lit("\\"), F.lit("/")).alias("path"), F.explode_outer("r.packages").alias("p"))
    return p.select("path", F.col("p.package.name").alias("package"), "p.package.version", "p.package.ecosystem", F.explode_outer("p.vulnerabilities.id").alias("advisory"))


def openslo(files: DataFrame) -> DataFrame:
    """(path, kind, name, service, metric) of OpenSLO documents."""

    def parse(path: str, text: str) -> Iterator[tuple]:
        import yaml

        try:
            found = list(yaml.safe_load_all(text))
        except yaml.YAMLError:
            return
        for d in found:
            if isinstance(d, dict) and d.get("kind"):
                spec = d.get("spec") or {}
                indicator = spec.get("indicator") or {}
                yield path, d["kind"], (d.get("metadata") or {}).get("name"), spec.get("service"), spec.get("indicatorRef") or (indicator.get("metadata") or {}).get("name")

    return parsed(files, parse, "path string, kind string, name string, service string, metric string")


def cedar(files: DataFrame) -> DataFrame:
    """(path, effect, principal, action, resource, conditions) of Cedar policies: the head's three constraints and the when/unless bodies."""
    policy = re.compile(r"\b(permit|forbid)\s*\(([^)]*)\)\s*((?:(?:when|unless)\s*\{[^}]*\}\s*)*);", re.S)

    def parse(path: str, text: str) -> Iterator[tuple]:
        for m in policy.finditer(re.sub(r"//[^\n]*", "", text)):
            head: dict[str, str | None] = dict.fromkeys(("principal", "action", "resource"))
            for part in re.split(r",(?![^\[]*\])", m[2]):
                words = part.strip().split(None, 1)
                if words and words[0] in head:
                    head[words[0]] = words[1].strip() if len(words) > 1 else None
            yield path, m[1], head["principal"], head["action"], head["resource"], [" ".join(c.split()) for c in re.findall(r"\{([^}]*)\}", m[3])]

    return parsed(files, parse, "path string, effect string, principal string, action string, resource string, conditions array<string>")


def ci_jobs(files: DataFrame) -> DataFrame:
    """(path, platform, job_name, trigger) of GitHub Actions, GitLab, CircleCI and Makefiles."""
    keywords = {"stages", "variables", "include", "default", "workflow", "image", "services", "before_script", "after_script", "cache", "pages"}

    def parse(path: str, text: str) -> Iterator[tuple]:
        name = path.rsplit("/", 1)[-1]
        if ".github/workflows/" in f"/{path}":
            doc = _load(path, text)
            on = doc.get("on", doc.get(True))
            trigger = ",".join(sorted(on)) if isinstance(on, dict | list) else on
            for job in doc.get("jobs") or {}:
                yield path, "github_actions", job, trigger
        elif name == ".gitlab-ci.yml":
            for job, body in _load(path, text).items():
                if isinstance(body, dict) and job not in keywords and not job.startswith("."):
                    yield path, "gitlab", job, body.get("stage")
        elif path.endswith(".circleci/config.yml"):
            for job in _load(path, text).get("jobs") or {}:
                yield path, "circleci", job, None
        elif name in ("Makefile", "makefile", "GNUmakefile"):
            for m in re.finditer(r"^([A-Za-z0-9][A-Za-z0-9_.-]*)\s*:(?!=)", text, re.M):
                yield path, "makefile", m[1], None

    return parsed(files, parse, "path string, platform string, job_name string, trigger string")


def env_declarations(files: DataFrame) -> DataFrame:
    """(path, var_name, value) of dotenv, TOML and JSON files."""

    def flat(prefix: str, value: object) -> Iterator[tuple[str, str]]:
        if isinstance(value, dict):
            for k, v in value.items():
                yield from flat(f"{prefix}_{k}".strip("_").upper(), v)
        elif not isinstance(value, list):
            yield prefix, "" if value is None else str(value)

    def parse(path: str, text: str) -> Iterator[tuple]:
        name = path.rsplit("/", 1)[-1]
        if name.startswith(".env") or name.endswith(".env"):
            for line in text.splitlines():
                if m := re.match(r"\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=(.*)$", line):
                    yield path, m[1], m[2].strip().strip("\"'")
        elif name.endswith(".toml"):
            import tomllib

            yield from ((path, k, v) for k, v in flat("", tomllib.loads(text)))
        elif name.endswith(".json"):
            yield from ((path, k, v) for k, v in flat("", json.loads(text)))

    return parsed(files, parse, "path string, var_name string, value string")


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Interchange records, a JSON object a line."""
    return spark.read.schema(schema).json(path)


def write_records(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def federated_interfaces(spark: SparkSession, glob: str) -> DataFrame:
    """(sibling, symbol, file): public interfaces of sibling schema files."""
    rows = spark.read.schema("repo string, interfaces array<struct<symbol:string,file:string>>").json(glob, multiLine=True)
    return rows.select(F.col("repo").alias("sibling"), F.explode("interfaces").alias("i")).select("sibling", "i.symbol", "i.file")


def samples(rows: DataFrame) -> DataFrame:
    """(metric, label, value) of instant samples (metric, labels map, value): labels joined as sorted ``k=v``."""
    return rows.select("metric", F.array_join(F.array_sort(F.transform(F.map_entries("labels"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",").alias("label"), "value")


def imports(files: DataFrame) -> DataFrame:
    """(path, import): import lines of Rust, TypeScript, Python and Go by pattern."""
    python, rust = r"(?m)^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))", r"(?m)^\s*(?:pub\s+)?use\s+([\w:]+)"
    script = r"(?:from|require\()\s*['\"]([^'\"]+)['\"]"
    found = F.when(F.col("path").endswith(".py"), F.concat(F.regexp_extract_all("content", F.lit(python), 1), F.regexp_extract_all("content", F.lit(python), 2))).when(F.col("path").endswith(".rs"), F.regexp_extract_all("content", F.lit(rust), 1)).otherwise(F.regexp_extract_all("content", F.lit(script), 1))
    return files.select("path", F.explode(F.array_distinct(F.filter(found, lambda x: x != ""))).alias("import"))


def python_symbols(files: DataFrame) -> DataFrame:
    """(path, symbol_name, qualified_name, symbol_kind, is_public, line_start, line_end, cyclomatic_complexity) of Python files by the ast module."""

    def parse(path: str, text: str) -> Iterator[tuple]:
        import ast

        try:
            tree = ast.parse(text)
        except SyntaxError:
            return
        branch = (ast.If, ast.For, ast.While, ast.ExceptHandler, ast.With, ast.IfExp, ast.comprehension, ast.Assert, ast.AsyncFor, ast.AsyncWith)

        def visit(node: ast.AST, scope: str) -> Iterator[tuple]:
            for child in ast.iter_child_nodes(node):
                if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                    name = f"{scope}.{child.name}" if scope else child.name
                    kind = "Class" if isinstance(child, ast.ClassDef) else "Method" if scope else "Function"
                    score = None if kind == "Class" else 1 + sum(isinstance(x, branch) + (len(x.values) - 1 if isinstance(x, ast.BoolOp) else 0) for x in ast.walk(child))
                    yield path, child.name, name, kind, not child.name.startswith("_"), child.lineno, child.end_lineno, score
                    yield from visit(child, name)
                else:
                    yield from visit(child, scope)

        yield from visit(tree, "")

    return parsed(files.where(F.col("path").endswith(".py")), parse, "path string, symbol_name string, qualified_name string, symbol_kind string, is_public boolean, line_start int, line_end int, cyclomatic_complexity int")
