"""Bindings of the operators' inputs to the test tables, as SQL that Spark and DuckDB both read.

Each entry is a SELECT over ``{table}`` placeholders. :func:`bind` runs it in Spark; :func:`cte` gives it to a DuckDB query by name.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

BINDINGS: dict[str, str] = {
    # A commit is an order, newest first; a file is one of its suppliers.
    "log": "SELECT concat('c', o.o_orderkey) AS commit, o.o_orderdate AS commit_ts, (o.o_orderkey % 17 = 0) AS is_merge, concat('src/s', l.l_suppkey % 60, CASE WHEN l.l_suppkey % 3 = 0 THEN '.rs' ELSE '.py' END) AS file FROM {orders} o JOIN {lineitem} l ON o.o_orderkey = l.l_orderkey",
    "commit_files": "SELECT DISTINCT c.i AS commit_idx, c.is_merge AS is_merge, concat('src/s', l.l_suppkey % 60, CASE WHEN l.l_suppkey % 3 = 0 THEN '.rs' ELSE '.py' END) AS file FROM (SELECT o_orderkey, (o_orderkey % 17 = 0) AS is_merge, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) - 1 AS i FROM (SELECT * FROM {orders} ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1000) q) c JOIN {lineitem} l ON c.o_orderkey = l.l_orderkey",
    "files": "SELECT s_suppkey AS id, concat('src/s', s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '.rs' ELSE '.py' END) AS file_path, CASE WHEN s_nationkey % 5 = 0 THEN NULL ELSE concat('svc', s_nationkey % 7) END AS service_name FROM {supplier}",
    "symbols": "SELECT p_partkey AS id, 1 + p_partkey % 100 AS file_id, concat('src/s', 1 + p_partkey % 100, CASE WHEN (1 + p_partkey % 100) % 3 = 0 THEN '.rs' ELSE '.py' END) AS file_path, concat('sym', p_partkey % 700) AS symbol_name, concat('mod::sym', p_partkey) AS qualified_name, CASE WHEN p_size % 4 = 0 THEN 'Type' ELSE 'Function' END AS symbol_kind, CASE WHEN p_partkey % 41 = 0 THEN 'ENTRYPOINT' WHEN p_partkey % 43 = 0 THEN 'HANDLER' WHEN p_partkey % 47 = 0 THEN 'TEST' ELSE NULL END AS entrypoint_kind, (p_size % 2 = 0) AS is_public, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size END AS cognitive_complexity, CAST(p_partkey % 23 AS INT) AS cyclomatic_complexity FROM {part}",
    "calls": "SELECT DISTINCT l_partkey AS caller_symbol_id, CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE 1 + (l_partkey * 7 + l_suppkey) % 2000 END AS callee_symbol_id, CASE WHEN l_linenumber % 5 = 0 THEN concat('sym', l_suppkey % 900) ELSE NULL END AS unresolved_callee, CASE WHEN l_linenumber % 2 = 0 THEN 1.0 ELSE 0.5 END AS confidence FROM {lineitem}",
    "changed_symbols": "SELECT DISTINCT concat('sym', p_partkey % 700) AS symbol_name FROM {part} WHERE p_brand = 'Brand#12'",
    "changed": "SELECT concat('src/s', s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '.rs' ELSE '.py' END) AS path FROM {supplier} WHERE s_acctbal < 0",
    "routes": "SELECT o_orderkey AS id, 1 + o_orderkey % 100 AS file_id, CASE WHEN o_orderkey % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, concat('/api/', lower(o_orderstatus), '/', o_custkey % 50) AS path FROM {orders}",
    "mapping": "SELECT DISTINCT l_partkey AS test_symbol_id, l_suppkey AS tested_file_id, 1 + (l_partkey * 3) % 2000 AS tested_symbol_id FROM {lineitem}",
    "nodes": "SELECT concat('n', s_suppkey) AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'service' ELSE 'file' END AS category, CAST(s_suppkey % 10 AS DOUBLE) / 10 AS risk_score FROM {supplier}",
    "edges": "SELECT DISTINCT concat('n', l_suppkey) AS source, concat('n', 1 + l_partkey % 100) AS target, CASE WHEN l_linenumber % 2 = 0 THEN 'calls' ELSE 'imports' END AS relation FROM {lineitem}",
    "links": "SELECT concat('n', n_nationkey) AS source, concat('n', (n_nationkey * 3 + 1) % 25) AS target, 'calls' AS relation FROM {nation} UNION SELECT concat('n', n_nationkey), concat('n', (n_nationkey * 7 + n_regionkey) % 25), 'imports' FROM {nation}",
    "seeds": "SELECT concat('n', s_suppkey) AS id FROM {supplier} WHERE s_nationkey = 3",
    "outcomes": "SELECT user_id * 100 + extract(DAY FROM ts) AS diff_embedding_id, event_type AS test_file, concat('job-', event_type) AS job_name, CASE WHEN value > 100 THEN 'fail' ELSE 'pass' END AS outcome, ts AS recorded_at FROM {events}",
    "entries": "SELECT o_orderkey AS id, concat('tx', o_orderkey) AS tx_id, CASE WHEN o_orderkey % 9 = 0 THEN 'ARCHITECTURE' WHEN o_orderkey % 2 = 0 THEN 'FEATURE' ELSE 'BUGFIX' END AS category, concat('entity', o_custkey) AS entity, concat('order ', lower(o_orderpriority)) AS summary, concat('status ', lower(o_orderstatus)) AS reason, (o_orderkey % 11 = 0) AS is_breaking, o_orderdate AS committed_at, CASE WHEN o_orderkey % 4 = 0 THEN 'SIBLING' ELSE 'LOCAL' END AS origin FROM {orders}",
    "transactions": "SELECT concat('tx', o_orderkey) AS tx_id, CASE WHEN o_orderstatus = 'F' THEN 'COMMITTED' WHEN o_orderstatus = 'O' THEN 'PENDING' ELSE 'UNAUDITED' END AS status, concat('entity', o_custkey) AS entity, o_orderdate AS started_at, CAST(o_orderkey % 5 AS INT) AS drift_count FROM {orders}",
    "before": "SELECT concat('u', user_id) AS entity, event_type AS kind, count(*) AS n FROM {events} WHERE ts < TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1, 2",
    "after": "SELECT concat('u', user_id) AS entity, event_type AS kind, count(*) AS n FROM {events} WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY 1, 2",
    "urls": "SELECT page_id, replace(replace(url, 'https://', ''), 'http://', '') AS path FROM {pages}",
    "score_a": "SELECT concat('f', user_id % 120) AS path, avg(value) / 1000 AS score FROM {events} WHERE event_type <> 'error' GROUP BY 1",
    "score_b": "SELECT concat('f', user_id % 120) AS path, max(value) / 1000 AS score FROM {events} WHERE event_type = 'view' OR value > 50 GROUP BY 1",
    "history": "SELECT concat('f', user_id) AS file_path, avg(value) AS score, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS timestamp FROM {events} GROUP BY 1, 3",
    "watch": "SELECT event_id AS seq, ts, concat('src/f', user_id, CASE WHEN user_id % 3 = 0 THEN '.rs' ELSE '.txt' END) AS path, CASE WHEN event_type = 'error' THEN 'Unknown' ELSE event_type END AS kind FROM {events}",
    "service_routes": "SELECT concat(CASE o_custkey % 8 WHEN 0 THEN 'src' WHEN 1 THEN 'src/tests' WHEN 2 THEN 'docs/a' WHEN 3 THEN 'web/mod' WHEN 4 THEN 'a/b/c/d' WHEN 5 THEN 'tools' WHEN 6 THEN 'a/b/x' ELSE 'svc/pay/in/api' END, '/f', o_custkey, '.rs') AS path, concat('h', o_custkey % 400) AS handler FROM {orders} WHERE o_orderstatus = 'F'",
    "service_calls": "SELECT concat(CASE l_suppkey % 8 WHEN 0 THEN 'src' WHEN 1 THEN 'src/tests' WHEN 2 THEN 'docs/a' WHEN 3 THEN 'web/mod' WHEN 4 THEN 'a/b/c/d' WHEN 5 THEN 'tools' WHEN 6 THEN 'a/b/x' ELSE 'svc/pay/in/api' END, '/f', l_suppkey, '.rs') AS caller_file, concat('h', l_partkey % 900) AS caller_name, concat('h', (l_partkey * 7 + l_suppkey) % 1200) AS callee_name, CASE WHEN l_linenumber % 2 = 0 THEN concat(CASE l_partkey % 8 WHEN 0 THEN 'src' WHEN 1 THEN 'src/tests' WHEN 2 THEN 'docs/a' WHEN 3 THEN 'web/mod' WHEN 4 THEN 'a/b/c/d' WHEN 5 THEN 'tools' WHEN 6 THEN 'a/b/x' ELSE 'svc/pay/in/api' END, '/f', l_partkey, '.rs') END AS callee_file FROM {lineitem} WHERE l_returnflag = 'R'",
    "service_models": "SELECT concat(CASE p_size % 8 WHEN 0 THEN 'src' WHEN 1 THEN 'src/tests' WHEN 2 THEN 'docs/a' WHEN 3 THEN 'web/mod' WHEN 4 THEN 'a/b/c/d' WHEN 5 THEN 'tools' WHEN 6 THEN 'a/b/x' ELSE 'svc/pay/in/api' END, '/f', p_size, '.rs') AS path, concat('h', p_partkey % 1500) AS model FROM {part}",
    "repo_files": "SELECT DISTINCT concat(CASE l_suppkey % 8 WHEN 0 THEN 'src' WHEN 1 THEN 'src/tests' WHEN 2 THEN 'docs/a' WHEN 3 THEN 'web/mod' WHEN 4 THEN 'vendor/x/y' WHEN 5 THEN 'tools' WHEN 6 THEN '.github/workflows' ELSE 'a/b/c' END, '/f', l_suppkey, CASE l_suppkey % 5 WHEN 0 THEN '.rs' WHEN 1 THEN '.py' WHEN 2 THEN '.md' WHEN 3 THEN '.yaml' ELSE '_test.go' END) AS path FROM {lineitem}",
}


def bind(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = BINDINGS[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in sql}
    return spark.sql(sql, **used)


def cte(*names: str) -> str:
    """WITH clause of the bindings for DuckDB; aliases and tables may share a name, so the inner ones are plain."""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({re.sub(r'{(\w+)}', r'\1', BINDINGS[n])})" for n in names)
