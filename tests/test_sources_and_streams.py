from __future__ import annotations

from pyspark.sql import functions as F

from skarn.operators.sets import drift_counts
from skarn.sources import files as src
from skarn.streaming import watch as w


def content(spark, path, text):
    return spark.createDataFrame([(path, text)], "path string, content string")


def test_file_walk(spark, tmp_path):
    for name, data in {"a/x.py": b"import os\nfrom a.b import c\n", "a/.hidden/y.py": b"z", "b.rs": b"use std::fs;\x00\xff", "big.py": b"x" * 2000}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r["path"]: r["content"] for r in src.read_files(spark, str(tmp_path), most_bytes=1000).collect()}
    assert set(got) == {"a/x.py", "b.rs"} and "\x00" not in got["b.rs"]
    rows = src.imports(src.read_files(spark, str(tmp_path))).collect()
    assert {(r["path"], r["import"]) for r in rows} == {("a/x.py", "os"), ("a/x.py", "a.b"), ("b.rs", "std::fs")}


def test_git_log(spark, tmp_path):
    (tmp_path / "log").write_text("@c2 200 c1 c0\n\n@c1 100 c0\nM\tx.py\nR100\told.py\tnew.py\n")
    got = {(r["commit"], r["is_merge"], r["file"]) for r in src.git_log(spark, str(tmp_path / "log")).collect()}
    assert got == {("c2", True, None), ("c1", False, None), ("c1", False, "x.py"), ("c1", False, "old.py"), ("c1", False, "new.py")}


def test_parsers(spark):
    t = lambda df: sorted(tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in df.collect())
    assert t(src.lcov(content(spark, "c.info", "SF:src/lib.rs\nDA:1,1\nend_of_record\nSF:src/main.rs\nend_of_record\n"))) == [("c.info", "src/lib.rs", 0.9), ("c.info", "src/main.rs", 0.9)]
    spec = '{"openapi": "3.0.0", "paths": {"/u": {"get": {"summary": "List", "tags": ["a"]}, "post": {}}}}'
    assert t(src.openapi(content(spark, "s.json", spec))) == [("s.json", "GET", "/u", "List", ("a",), "GET /u List a"), ("s.json", "POST", "/u", "", (), "POST /u")]
    assert src.openapi(content(spark, "s.json", "{broken")).collect() == []
    lock = '[[package]]\nname = "a"\nversion = "1"\ndependencies = ["b 2"]\n[[package]]\nname = "b"\nversion = "1"\n[[package]]\nname = "b"\nversion = "2"\n'
    assert ("l", "a", "1", None, "b", "2") in [tuple(r) for r in src.cargo_lock(content(spark, "l", lock)).collect()]
    assert t(src.cedar(content(spark, "p.cedar", 'permit(principal == User::"a", action, resource in App::"x") when { context.ok };'))) == [("p.cedar", "permit", '== User::"a"', None, 'in App::"x"', ("context.ok",))]
    assert {r["job_name"] for r in src.ci_jobs(content(spark, "Makefile", "test: build\n\tx\nV := 1\nbuild:\n")).collect()} == {"test", "build"}
    assert {r["job_name"] for r in src.ci_jobs(content(spark, ".github/workflows/a.yml", "on: push\njobs:\n  lint: {}\n  test: {}\n")).collect()} == {"lint", "test"}
    assert t(src.env_declarations(content(spark, ".env", "export A='1'\nB=\n# c\n"))) == [(".env", "A", "1"), (".env", "B", "")]
    got = src.python_symbols(content(spark, "m.py", "class C:\n    def f(self, x):\n        return 1 if x and x > 2 else 0\n"))
    assert {(r["qualified_name"], r["symbol_kind"], r["cyclomatic_complexity"]) for r in got.collect()} == {("C", "Class", None), ("C.f", "Method", 3)}


def test_osv_and_records(spark, tmp_path):
    (tmp_path / "o.json").write_text('{"results": [{"source": {"path": "a\\\\Cargo.lock"}, "packages": [{"package": {"name": "p", "version": "1", "ecosystem": "e"}, "vulnerabilities": [{"id": "V-1"}, {"id": "V-2"}]}, {"package": {"name": "q"}}]}]}')
    got = {(r["path"], r["package"], r["advisory"]) for r in src.osv(spark, str(tmp_path / "o.json")).collect()}
    assert got == {("a/Cargo.lock", "p", "V-1"), ("a/Cargo.lock", "p", "V-2"), ("a/Cargo.lock", "q", None)}
    src.write_records(spark.range(3), str(tmp_path / "r"))
    assert src.read_records(spark, str(tmp_path / "r"), "id long").count() == 3


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"src/f{i % 4}.rs", "Modify" if i % 3 else "Unknown") for i in range(30)], "seq long, path string, kind string").withColumn("ts", F.timestamp_seconds(F.col("seq") * 60))
    rows.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = w.watch(spark, str(tmp_path / "in"), rows.schema)
    pending = spark.createDataFrame([("src/f3.rs",)], "entity string")
    query = w.drift(stream, pending).writeStream.outputMode("complete").format("memory").queryName("drift").trigger(availableNow=True).start()
    query.awaitTermination()
    want = drift_counts(rows.withColumnRenamed("path", "entity").where("entity <> 'src/f3.rs'"))
    assert {tuple(r) for r in spark.table("drift").collect()} == {tuple(r) for r in want.collect()}


def test_debounced_batches_and_alerts(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a.rs", "Modify"), (2, "a.rs", "Unknown"), (3, "target/x.rs", "Modify"), (4, "b.txt", "Modify")], "seq long, path string, kind string").withColumn("ts", F.timestamp_seconds("seq"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen, fired = [], []
    couplings = spark.createDataFrame([("a.rs", "z.rs", 0.97), ("q.rs", "a.rs", 0.8)], "file_a string, file_b string, score double")
    alert = w.alerts(lambda: couplings, lambda df, epoch: fired.extend(map(tuple, df.collect())))

    def handle(batch, epoch):
        seen.extend(map(tuple, batch.collect()))
        w.persist_batches(str(tmp_path / "out"))(batch, epoch)
        alert(batch, epoch)

    w.debounced(w.watch(spark, str(tmp_path / "in"), rows.schema), handle, str(tmp_path / "cp"), ["target/**"], ["rs"], None).start().awaitTermination()
    assert seen == [("a.rs", "Modify")] and fired == [("a.rs", "z.rs", 0.97, "High")]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
