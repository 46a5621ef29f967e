from __future__ import annotations

from pyspark.sql import functions as F

from skarn.sources import extract as e


def files(spark, **named):
    return spark.createDataFrame([(k.replace("__", "/").replace("_dot_", "."), v) for k, v in named.items()], "path string, content string")


def rows(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_calls_and_models(spark):
    py = "from dataclasses import dataclass\n@dataclass\nclass U:\n    id: int\n    name: str\ndef f():\n    g()\n    x.h()\n    k()()\n"
    f = files(spark, m_dot_py=py, bad_dot_py="def (", s_dot_rs="#[derive(Debug, Serialize)]\npub struct A { pub x: u8, y: String }", t_dot_ts="export interface B { a?: number; b: string }")
    assert rows(e.calls(f), "caller", "callee", "call_kind") == {("f", "g", "DIRECT"), ("f", "h", "METHOD"), ("f", "k", "DIRECT"), ("f", "k()", "DYNAMIC")}
    assert {(r["model_name"], r["model_kind"], tuple(r["fields"])) for r in e.data_models(f).collect()} == {("U", "CLASS", ("id", "name")), ("A", "STRUCT", ("x", "y")), ("B", "INTERFACE", ("a", "b"))}


def test_routes(spark):
    f = files(spark, a_dot_py='@app.get("/x")\ndef x(): ...\n@bp.route("/y", methods=["POST", "PUT"])\ndef y(): ...\n', b_dot_js="router.post('/z', h)", c_dot_rs='#[get("/q")]\nRouter::new().route("/r", post(h))')
    assert rows(e.routes(f), "method", "route", "framework") == {("GET", "/x", "fastapi"), ("POST", "/y", "flask"), ("PUT", "/y", "flask"), ("POST", "/z", "express"), ("GET", "/q", "actix"), ("POST", "/r", "axum")}


def test_patterns_and_boundaries(spark):
    f = files(spark, a_dot_py="logger.info('x')\ntry:\n    requests.get('http://svc/a')\nexcept E:\n    pass\ntracer.start_span()\nos.getenv('K')", svc__Dockerfile="FROM x", svc__package_dot_json='{"name": "web"}', lib__go_dot_mod="module example.com/org/tool\n")
    assert rows(e.observability(f), "line", "kind", "level") == {(1, "LOG", "info"), (4, "ERROR_HANDLE", None), (6, "TRACE", None)}
    assert rows(e.http_calls(f), "url", "client") == {("http://svc/a", "requests")} and rows(e.env_references(f), "var_name") == {("K",)}
    assert rows(e.service_boundaries(f), "root", "service", "confidence") == {("svc", "web", 0.9), ("lib", "tool", 0.9)}
    assert e.observability(f, most=1).count() == 1


def test_entrypoints_and_markdown(spark):
    t = spark.createDataFrame([("main", "a.py", "", True), ("h", "a.py", "@app.get('/x')", True), ("test_a", "a.py", "", True), ("p", "lib.rs", "", True), ("q", "a.py", "", False)], "n string, p string, d string, u boolean")
    assert [r[0] for r in t.select(e.entrypoint_kind(F.col("n"), F.col("p"), F.col("d"), F.col("u"))).collect()] == ["ENTRYPOINT", "HANDLER", "TEST", "PUBLIC_API", "INTERNAL"]
    got = e.markdown_docs(files(spark, r_dot_md="# Title\n\nFirst words\nhere.\n\n## Use\n```py\nx = 1\n```\n[a](http://b)\n")).first()
    assert (got["title"], got["summary"], got["sections"], got["code_blocks"], got["links"]) == ("Title", "First words here.", ["Title", "Use"], ["py"], ["http://b"])
