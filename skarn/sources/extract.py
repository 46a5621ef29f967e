"""Static extractors: rows from source text, one file at a time. Python files go through the ast module; other languages by line patterns, which approximate a parser.
Input is ``files(path, content)``; a file that can't be parsed gives no rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import basename, env_names, parent
from .files import parsed

# Route registrations by framework: method and path in order of the groups.
ROUTES = {
    "fastapi": r"@\w+\.(get|post|put|delete|patch|head|options)\(\s*['\"]([^'\"]+)['\"]",
    "express": r"\b(?:app|router)\.(get|post|put|delete|patch|all)\(\s*['\"`]([^'\"`]+)['\"`]",
    "actix": r"#\[(get|post|put|delete|patch)\(\"([^\"]+)\"",
}
AXUM = r"\.route\(\s*\"([^\"]+)\"\s*,\s*(get|post|put|delete|patch)\("
FLASK = r"@\w+\.route\(\s*['\"]([^'\"]+)['\"](?:[^)]*methods\s*=\s*\[([^\]]*)\])?"
LOG = r"\b(?:log|logger|logging|console|tracing)(?:::|\.)(trace|debug|info|warn|warning|error|critical)\b|\b(trace|debug|info|warn|error)!\("
ERRORS = r"\bexcept\b|\bcatch\s*\(|\.map_err\(|\.unwrap_or_else\(|\bResult<"
TRACE = r"\b(?:start_span|start_as_current_span|tracer\.|#\[instrument|opentelemetry)"
HTTP = {"reqwest": "reqwest", "fetch": "fetch(", "axios": "axios.", "requests": "requests.", "httpx": "httpx."}
BOUNDARIES = {"Cargo.toml": 0.9, "package.json": 0.9, "go.mod": 0.9, "pom.xml": 0.9, "Dockerfile": 0.6}


def calls(files: DataFrame) -> DataFrame:
    """(path, caller, callee, call_kind, confidence) of Python: plain calls are DIRECT, attribute calls METHOD, calls of call results DYNAMIC."""

    def parse(path: str, text: str) -> Iterator[tuple]:
        import ast

        try:
            tree = ast.parse(text)
        except SyntaxError:
            return

        def visit(node: ast.AST, scope: str) -> Iterator[tuple]:
            for child in ast.iter_child_nodes(node):
                inner = f"{scope}.{child.name}".lstrip(".") if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef) else scope
                if isinstance(child, ast.Call) and scope:
                    f = child.func
                    if isinstance(f, ast.Name):
                        yield path, scope, f.id, "DIRECT", 1.0
                    elif isinstance(f, ast.Attribute):
                        yield path, scope, f.attr, "METHOD", 1.0
                    else:
                        yield path, scope, ast.unparse(f), "DYNAMIC", 0.5
                yield from visit(child, inner)

        yield from visit(tree, "")

    return parsed(files.where(F.col("path").endswith(".py")), parse, "path string, caller string, callee string, call_kind string, confidence double")


def routes(files: DataFrame) -> DataFrame:
    """(path, method, route, framework, line): registrations of FastAPI, Flask, Express, actix and axum."""
    fixed, axum, flask = dict(ROUTES), AXUM, FLASK

    def parse(path: str, text: str) -> Iterator[tuple]:
        line = lambda m: text.count("\n", 0, m.start()) + 1
        kinds = {"py": ["fastapi"], "js": ["express"], "ts": ["express"], "tsx": ["express"], "rs": ["actix"]}.get(path.rsplit(".", 1)[-1], [])
        for kind in kinds:
            for m in re.finditer(fixed[kind], text):
                yield path, m[1].upper(), m[2], kind, line(m)
        if path.endswith(".rs"):
            for m in re.finditer(axum, text):
                yield path, m[2].upper(), m[1], "axum", line(m)
        if path.endswith(".py"):
            for m in re.finditer(flask, text):
                for method in re.findall(r"\w+", m[2] or "GET"):
                    yield path, method.upper(), m[1], "flask", line(m)

    return parsed(files, parse, "path string, method string, route string, framework string, line int")


def data_models(files: DataFrame) -> DataFrame:
    """(path, model_name, model_kind, fields): Python dataclasses and classes of annotated fields, Rust structs with derives, TypeScript interfaces."""

    def parse(path: str, text: str) -> Iterator[tuple]:
        if path.endswith(".py"):
            import ast

            try:
                tree = ast.parse(text)
            except SyntaxError:
                return
            for node in ast.walk(tree):
                if isinstance(node, ast.ClassDef):
                    names = [b.target.id for b in node.body if isinstance(b, ast.AnnAssign) and isinstance(b.target, ast.Name)]
                    marks = {ast.unparse(d).split("(")[0].split(".")[-1] for d in node.decorator_list} | {ast.unparse(b).split(".")[-1] for b in node.bases}
                    if names and marks & {"dataclass", "BaseModel", "TypedDict", "NamedTuple", "Base", "Model"}:
                        yield path, node.name, "CLASS", names
        elif path.endswith(".rs"):
            for m in re.finditer(r"#\[derive\([^)]*(?:Serialize|Deserialize)[^)]*\)\][^{;]*?struct\s+(\w+)[^{;]*\{([^}]*)\}", text):
                yield path, m[1], "STRUCT", re.findall(r"(?:pub\s+)?(\w+)\s*:", m[2])
        elif path.endswith((".ts", ".tsx")):
            for m in re.finditer(r"\binterface\s+(\w+)[^{]*\{([^}]*)\}", text):
                yield path, m[1], "INTERFACE", re.findall(r"(\w+)\??\s*:", m[2])

    return parsed(files, parse, "path string, model_name string, model_kind string, fields array<string>")


def observability(files: DataFrame, most: int = 1000) -> DataFrame:
    """(path, line, kind, level): logging, error handling and telemetry by line, at most ``most`` of a file (the original's cap), in order."""
    from pyspark.sql import Window

    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("p", "l"))
    level = F.lower(F.concat(F.regexp_extract("l", LOG, 1), F.regexp_extract("l", LOG, 2)))
    kind = F.when(F.col("l").rlike(LOG), "LOG").when(F.col("l").rlike(TRACE), "TRACE").when(F.col("l").rlike(ERRORS), "ERROR_HANDLE")
    rows = lines.select("path", (F.col("p") + 1).alias("line"), kind.alias("kind"), F.nullif(level, F.lit("")).alias("level")).where("kind is not null")
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy("line"))).where(F.col("_n") <= most).drop("_n")


def entrypoint_kind(name: Column, path: Column, decorators: Column, is_public: Column) -> Column:
    """ENTRYPOINT, HANDLER, TEST, FFI, PUBLIC_API or INTERNAL by name, decorators (a string) and place."""
    return (
        F.when(name.isin("main", "__main__"), "ENTRYPOINT").when(decorators.rlike(r"(?i)\b(route|get|post|put|delete|patch|websocket)\("), "HANDLER")
        .when(name.rlike("^test_|_test$") | decorators.rlike(r"\btest\b|pytest"), "TEST").when(decorators.rlike("no_mangle|extern"), "FFI")
        .when(is_public & path.rlike(r"(^|/)(lib\.rs|mod\.rs|index\.[jt]s|__init__\.py)$"), "PUBLIC_API").otherwise("INTERNAL")
    )


def env_references(files: DataFrame) -> DataFrame:
    """(path, var_name): environment variables that a file reads."""
    return files.select("path", F.explode(env_names(F.col("content"))).alias("var_name"))


def http_calls(files: DataFrame) -> DataFrame:
    """(path, url, client): lines that hold a client's marker, with their first quoted argument."""
    line = F.explode(F.split("content", "\n"))
    client = F.coalesce(*[F.when(F.contains(F.lower("l"), F.lit(marker)), F.lit(name)) for name, marker in HTTP.items()])
    rows = files.select("path", line.alias("l")).select("path", F.regexp_extract("l", r"['\"`]([^'\"`]+)['\"`]", 1).alias("url"), client.alias("client"))
    return rows.where("client is not null and url <> ''").distinct()


def service_boundaries(files: DataFrame, depth: int = 8) -> DataFrame:
    """(root, service, confidence): directories with a service marker, named by the marker's own name field, else the directory."""
    table = F.create_map(*[F.lit(x) for kv in BOUNDARIES.items() for x in kv])
    named = F.when(basename(F.col("path")) == "go.mod", F.regexp_extract("content", r"(?m)^module\s+\S*?([^/\s]+)\s*$", 1)).when(basename(F.col("path")) == "pom.xml", F.regexp_extract("content", r"<artifactId>([^<]+)<", 1)).otherwise(F.regexp_extract("content", r"(?m)\"?name\"?\s*[:=]\s*\"([^\"]+)\"", 1))
    rows = files.where(basename(F.col("path")).isin(*BOUNDARIES) & (F.size(F.split("path", "/")) <= depth + 1))
    root = parent(F.col("path"))
    service = F.coalesce(F.nullif(named, F.lit("")), F.nullif(basename(root), F.lit("")), F.lit("root"))
    return rows.select(root.alias("root"), service.alias("service"), F.element_at(table, basename(F.col("path"))).alias("confidence")).groupBy("root").agg(F.max_by("service", "confidence").alias("service"), F.max("confidence").alias("confidence"))


def markdown_docs(files: DataFrame) -> DataFrame:
    """(path, title, summary, sections, code_blocks, links) of Markdown files."""

    def parse(path: str, text: str) -> Iterator[tuple]:
        blocks = re.findall(r"^```(\w*)\n(.*?)^```", text, re.M | re.S)
        prose = re.sub(r"^```.*?^```\s*?$", "", text, flags=re.M | re.S)
        heads = re.findall(r"^#{1,6}\s+(.+?)\s*#*$", prose, re.M)
        first = next((p.strip() for p in re.split(r"\n\s*\n", prose) if p.strip() and not p.lstrip().startswith("#")), "")
        yield path, heads[0] if heads else None, " ".join(first.split()), heads, [b[0] for b in blocks], re.findall(r"\[[^\]]*\]\(([^)\s]+)", prose)

    return parsed(files.where(F.col("path").rlike(r"\.(md|markdown)$")), parse, "path string, title string, summary string, sections array<string>, code_blocks array<string>, links array<string>")
