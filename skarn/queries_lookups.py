"""More registered queries: lookups, attachments, services, reports and extractors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import scalars as s
from .operators import graph as g
from .operators import joins as j
from .operators import predicates as p
from .operators import sets as u
from .plans import history as h
from .plans import ledger as led
from .plans import prediction as pred
from .plans import risk as rk
from .plans import services as sv
from .queries import _HOT, Inputs, query


@query("l7_forbidden_terms", "SELECT o_orderkey AS tx_id, term FROM orders, (VALUES ('URGENT'), ('low')) t(term) WHERE contains(lower(concat(o_orderpriority, ' ', o_orderstatus)), lower(term))")
def _(t: Inputs) -> DataFrame:
    rules = t.spark.createDataFrame([("NO URGENT", None), ("no low", None), ("USE tests", None)], "rule string, glob string")
    actions = t.table("orders").select(F.col("o_orderkey").alias("tx_id"), F.col("o_orderpriority").alias("action"), F.col("o_orderstatus").alias("entity"))
    return p.forbidden_terms(rules, actions)


@query("l10_exported_interfaces", "SELECT file_path, symbol_name, symbol_kind FROM symbols WHERE is_public AND file_id = (SELECT max(file_id) FROM symbols)", "symbols")
def _(t: Inputs) -> DataFrame:
    sym = t("symbols").withColumn("snapshot_id", F.col("file_id"))
    return p.exported_interfaces(sym.select(F.col("snapshot_id").alias("id")), sym)


@query("l13_import_new", "SELECT tx_id, entity FROM transactions WHERE status = 'COMMITTED' UNION ALL SELECT tx_id, entity FROM transactions WHERE status = 'PENDING' AND tx_id NOT IN (SELECT tx_id FROM transactions WHERE status = 'COMMITTED')", "transactions")
def _(t: Inputs) -> DataFrame:
    tx = t("transactions").select("tx_id", "entity", "status")
    return p.import_new(tx.where("status = 'COMMITTED'").drop("status"), tx.where("status <> 'UNAUDITED'").drop("status"), ["tx_id"])


@query("l15_unindexed", "SELECT DISTINCT path FROM repo_files WHERE path LIKE '%.rs' AND path NOT IN (SELECT replace(file_path, 's', 'f') FROM files)", "repo_files", "files")
def _(t: Inputs) -> DataFrame:
    indexed = t("files").select(F.replace("file_path", F.lit("s"), F.lit("f")).alias("path"))
    return t("repo_files").where(s.extension(F.col("path")) == "rs").join(indexed, "path", "left_anti").distinct()


@query("l16_assign_in_order", "SELECT path, CASE WHEN path LIKE 'src/%' THEN 'alpha' WHEN path LIKE 'docs%' THEN 'beta' WHEN path LIKE 'a/b%' THEN 'gamma' END AS service FROM repo_files WHERE path LIKE 'src/%' OR path LIKE 'docs%' OR path LIKE 'a/b%'", "repo_files")
def _(t: Inputs) -> DataFrame:
    return sv.assign_in_order(t("repo_files"), t.spark.createDataFrame([("alpha", "src/"), ("beta", "docs"), ("gamma", "a/b"), ("omega", "src/tests")], "service string, root string"))


@query("l17_attached_routes", "SELECT f.id AS file_id, count(r.id) AS routes, coalesce(min(r.path), '') AS first FROM files f LEFT JOIN routes r ON r.file_id = f.id GROUP BY 1", "files", "routes")
def _(t: Inputs) -> DataFrame:
    rows = p.attach(t("files").select(F.col("id").alias("file_id")), t("routes"), "routes", ["path", "method"])
    return rows.select("file_id", F.size("routes").cast("long").alias("routes"), F.coalesce(F.get("routes", F.lit(0))["path"], F.lit("")).alias("first"))


@query("l18_deploy_tiers", "SELECT path, 'CiWorkflow' AS manifest_type, CASE WHEN path LIKE '%7_.yaml' THEN 3 ELSE 2 END AS risk_tier FROM repo_files WHERE path LIKE '.github/workflows/%' AND path LIKE '%.yaml'", "repo_files")
def _(t: Inputs) -> DataFrame:
    return p.deploy_tiers(sv.deploy_manifests(t("repo_files")).withColumn("coupled", F.col("path").like("%7_.yaml")))


@query("l18_mixed_tiers", ", m AS (SELECT replace(path, '.py', '.tf') AS path, CASE WHEN path LIKE '%.py' THEN 'Terraform' ELSE 'CiWorkflow' END AS manifest_type FROM repo_files WHERE path LIKE 'tools/%.py' OR (path LIKE '.github/workflows/%' AND path LIKE '%.yaml')) SELECT path, manifest_type, CASE WHEN (SELECT count(DISTINCT manifest_type) FROM m) > 1 THEN 3 ELSE 2 END AS risk_tier FROM m", "repo_files")
def _(t: Inputs) -> DataFrame:
    path = F.when(F.col("path").startswith("tools/"), F.replace("path", F.lit(".py"), F.lit(".tf"))).otherwise(F.col("path"))
    return p.deploy_tiers(sv.deploy_manifests(t("repo_files").select(path.alias("path"))).withColumn("coupled", F.lit(False)))


@query("l19_first_rows", "SELECT entity, tx_id FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY committed_at, tx_id) AS r FROM entries) z WHERE r = 1", "entries")
def _(t: Inputs) -> DataFrame:
    return p.first_rows(t("entries"), ["entity"], [F.col("committed_at"), F.col("tx_id")]).select("entity", "tx_id")


@query("p5_like_pattern", "SELECT id FROM entries WHERE entity LIKE 'entity1%5'", "entries")
def _(t: Inputs) -> DataFrame:
    return t("entries").where(p.like_user_pattern(F.col("entity"), "entity1*5")).select("id")


@query("p3_protected_paths", "SELECT path FROM repo_files WHERE path LIKE 'src/%.rs' OR path LIKE 'vendor/%'", "repo_files")
def _(t: Inputs) -> DataFrame:
    return p.protected(t("repo_files"), ["src/**/*.rs", "vendor/**"])


@query("p11_json_field", "SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k FROM events")
def _(t: Inputs) -> DataFrame:
    return t.table("events").select("event_id", p.json_field(F.col("props"), "k").alias("k"))


@query("j5_routes_with_handler", "SELECT r.id, f.file_path FROM routes r LEFT JOIN files f ON f.id = r.file_id", "routes", "files")
def _(t: Inputs) -> DataFrame:
    return t("routes").join(t("files").select(F.col("id").alias("file_id"), "file_path"), "file_id", "left").select("id", "file_path")


@query("j7_complexity_fallback", ", a AS (SELECT file_path AS file, max(cyclomatic_complexity) AS c FROM symbols WHERE is_public GROUP BY 1), b AS (SELECT file_path AS file, max(cyclomatic_complexity) AS c FROM symbols GROUP BY 1) SELECT f.file_path AS file, coalesce(a.c, CASE WHEN b.c > 0 THEN b.c END, 0) AS complexity FROM files f LEFT JOIN a ON a.file = f.file_path LEFT JOIN b ON b.file = f.file_path", "files", "symbols")
def _(t: Inputs) -> DataFrame:
    top = lambda df: df.groupBy(F.col("file_path").alias("file")).agg(F.max("cyclomatic_complexity").alias("complexity"))
    return j.with_fallback(t("files").select(F.col("file_path").alias("file")), top(t("symbols").where("is_public")), top(t("symbols")), "file", "complexity")


@query("j8_hotspots_with_centrality", _HOT + ", cen AS (SELECT file_path AS file, max(file_id) AS reachable, max(cyclomatic_complexity) / 100.0 AS pr FROM symbols GROUP BY 1) SELECT sc.file, round(ln(1 + 1000 * score) + CASE WHEN cen.file IS NULL THEN 0 ELSE ln(1 + reachable) * 0.1 + pr * 0.3 END, 5)::DOUBLE AS display FROM sc LEFT JOIN cen ON cen.file = sc.file ORDER BY score DESC, sc.file LIMIT 50", "commit_files", "symbols")
def _(t: Inputs) -> DataFrame:
    central = t("symbols").groupBy(F.col("file_path").alias("file")).agg(F.max("file_id").alias("reachable"), (F.max("cyclomatic_complexity") / 100.0).alias("rank"))
    return h.hotspots(t("commit_files"), t("symbols"), half_life=100, centrality=central).select("file", F.round("display", 5).alias("display"))


@query("j9_transactions_of_file", "SELECT DISTINCT e.tx_id FROM entries e WHERE e.tx_id IN (SELECT tx_id FROM transactions WHERE entity LIKE '%entity12')", "entries", "transactions")
def _(t: Inputs) -> DataFrame:
    return j.transactions_of(t("entries").select("tx_id"), t("transactions"), "entity12")


@query("j16_route_consumers", ", r AS (SELECT DISTINCT path AS path_pattern FROM routes WHERE method = 'GET'), d AS (SELECT path AS pattern, concat('svc', file_id % 6) AS service FROM routes WHERE method = 'POST') SELECT path_pattern, count(DISTINCT service) AS consumers FROM r LEFT JOIN d ON d.pattern = r.path_pattern GROUP BY 1", "routes")
def _(t: Inputs) -> DataFrame:
    r = t("routes").withColumnRenamed("path", "path_pattern")
    d = r.where("method = 'POST'").select(F.col("path_pattern").alias("pattern"), F.concat(F.lit("svc"), F.col("file_id") % 6).alias("service"))
    get = r.where("method = 'GET'")
    return j.route_consumers(get, d, get.select("path_pattern"))


@query("j23_federated_check", ", d AS (SELECT DISTINCT concat('sib', user_id % 9) AS sibling, event_type AS symbol FROM events), i AS (SELECT DISTINCT concat('sib', user_id % 9) AS sibling, event_type AS symbol FROM events WHERE value > 300) SELECT d.sibling, d.symbol, CASE WHEN i.symbol IS NULL THEN 'removed' ELSE 'present' END AS state, CASE WHEN i.symbol IS NULL THEN 0 ELSE (SELECT count(*) FROM events e WHERE concat('sib', e.user_id % 9) = d.sibling AND e.event_type = d.symbol AND ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 10 DAY) END AS entries FROM d LEFT JOIN i ON i.sibling = d.sibling AND i.symbol = d.symbol", "seeds")
def _(t: Inputs) -> DataFrame:
    e = t.table("events").select(F.concat(F.lit("sib"), F.col("user_id") % 9).alias("sibling"), F.col("event_type").alias("symbol"), "value", F.col("ts").alias("committed_at"))
    r = j.federated_check(e.select("sibling", "symbol").distinct(), e.where("value > 300"), e, F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'"), 10)
    return r.withColumn("entries", F.col("entries").cast("long"))


@query("j24_containment", "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def _(t: Inputs) -> DataFrame:
    return j.containment(t.table("documents").select("doc_id", "text"), t.table("benchmark").select("item_id", F.col("text").alias("needle")), "text", "needle").select("doc_id", "item_id")


@query("j25_import_suffixes", "SELECT DISTINCT concat('src/u', user_id, '.rs') AS file_path, concat('lib/', event_type, '/m', user_id % 10, '.py') AS changed_path FROM events")
def _(t: Inputs) -> DataFrame:
    e = t.table("events")
    imports = e.select(F.concat(F.lit("src/u"), "user_id", F.lit(".rs")).alias("file_path"), F.array(F.concat("event_type", F.lit("::m"), F.col("user_id") % 10)).alias("imported_from")).distinct()
    return j.import_suffixes(imports, e.select(F.concat(F.lit("lib/"), "event_type", F.lit("/m"), F.col("user_id") % 10, F.lit(".py")).alias("path")).distinct())


@query("g13_assembled_graph", "SELECT source, target, relation FROM links UNION SELECT source, target, relation FROM edges", "links", "edges")
def _(t: Inputs) -> DataFrame:
    return g.assemble([(t("nodes"), t("links")), (t("nodes"), t("edges"))])[1].select("source", "target", "relation")


@query("g15_advisories", ", pk AS (SELECT DISTINCT concat('svc', s_nationkey % 4, '/Cargo.lock') AS path, concat('pkg', s_suppkey % 20) AS package, CASE WHEN s_suppkey % 5 = 0 THEN concat('ADV-', s_suppkey) END AS advisory FROM supplier), sv AS (SELECT concat('S', i) AS id, concat('svc', i) AS root FROM range(3) r(i)) SELECT path AS source, package AS target, 'depends_on' AS relation FROM pk UNION SELECT advisory, package, 'affects' FROM pk WHERE advisory IS NOT NULL UNION SELECT id, package, 'depends_on' FROM pk JOIN sv ON path LIKE concat(root, '/%')", "seeds")
def _(t: Inputs) -> DataFrame:
    packages = t.table("supplier").select(F.concat(F.lit("svc"), F.col("s_nationkey") % 4, F.lit("/Cargo.lock")).alias("path"), F.concat(F.lit("pkg"), F.col("s_suppkey") % 20).alias("package"), F.when(F.col("s_suppkey") % 5 == 0, F.concat(F.lit("ADV-"), "s_suppkey")).alias("advisory")).distinct()
    return g.advisories(packages, t.spark.range(3).select(F.concat(F.lit("S"), "id").alias("id"), F.concat(F.lit("svc"), "id").alias("root")))


@query("g16_synced_edges", "SELECT source, target, relation FROM links WHERE source <> 'n3' AND NOT (source = 'n1' AND target = 'n4' AND relation = 'calls') UNION ALL SELECT 'n1', 'n4', 'calls'", "links")
def _(t: Inputs) -> DataFrame:
    nodes = t("nodes").select("id")
    fresh = t.spark.createDataFrame([("n1", "n4", "calls")], "source string, target string, relation string")
    return g.sync(nodes, t("links"), nodes.where("id = 'n3'"), nodes.where("id = 'n3'"), fresh)[1]


@query("u4_sdk_delta", ", b AS (SELECT DISTINCT event_type AS sdk, concat('f', user_id) AS f FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00' AND event_type <> 'click'), a AS (SELECT DISTINCT event_type AS sdk, concat('f', user_id) AS f FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' AND event_type <> 'view' AND value > 300) SELECT coalesce(x.sdk, y.sdk) AS sdk, CASE WHEN x.sdk IS NULL THEN 'added' WHEN y.sdk IS NULL THEN 'removed' ELSE 'modified' END AS change FROM (SELECT sdk, list_sort(list(f)) AS fs FROM b GROUP BY 1) x FULL JOIN (SELECT sdk, list_sort(list(f)) AS fs FROM a GROUP BY 1) y ON x.sdk = y.sdk WHERE x.sdk IS NULL OR y.sdk IS NULL OR x.fs <> y.fs", "seeds")
def _(t: Inputs) -> DataFrame:
    e = t.table("events").select("ts", F.col("event_type").alias("import"), F.concat(F.lit("f"), "user_id").alias("file_path"), "value")
    cut = F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'")
    return sv.sdk_delta(e.where((F.col("ts") < cut) & (F.col("import") != "click")), e.where((F.col("ts") >= cut) & (F.col("import") != "view") & (F.col("value") > 300)), ["CLICK", "view", "err", "sign", "purch"])


@query("u10_deleted_files", "SELECT id, file_id FROM routes WHERE file_id NOT IN (SELECT id FROM files WHERE service_name IS NULL)", "routes", "files")
def _(t: Inputs) -> DataFrame:
    gone = t("files").where("service_name is null").select(F.col("id").alias("file_id"))
    return u.delete_files({"routes": (t("routes"), "file_id")}, gone)["routes"].select("id", "file_id")


@query("c8_ordered_plan", ", pr AS (SELECT test_file AS command, (count(*) FILTER (WHERE outcome = 'fail') + 1.0) / (count(*) + 2.0) AS pb FROM outcomes GROUP BY 1) SELECT command, row_number() OVER (ORDER BY pb DESC, command) AS position FROM pr", "outcomes")
def _(t: Inputs) -> DataFrame:
    from pyspark.sql import Window

    o = t("outcomes")
    probabilities = pred.failure_probabilities(o, most_diffs=None).select(F.col("test_file").alias("command"), "probability")
    plan = pred.order_plan(o.select(F.col("test_file").alias("command")).distinct(), probabilities)
    return plan.withColumn("position", F.row_number().over(Window.orderBy(F.desc("probability"), F.asc_nulls_last("command")))).select("command", F.col("position").cast("long").alias("position"))


@query("c10_build_plan", ", x AS (SELECT DISTINCT event_type AS command, concat('From rules: ', event_type) AS d FROM events UNION SELECT DISTINCT event_type, concat('Predicted impact (Temporal) on f', user_id % 3) FROM events) SELECT command, array_to_string(list_sort(list(d)), ' | ') AS description FROM x GROUP BY 1", "seeds")
def _(t: Inputs) -> DataFrame:
    e = t.table("events")
    guessed = e.select(F.col("event_type").alias("command"), F.lit("Temporal").alias("reason"), F.concat(F.lit("f"), F.col("user_id") % 3).alias("path")).distinct()
    return pred.build_plan(e.select(F.col("event_type").alias("command")).distinct(), guessed)


@query("c11_file_weights", "SELECT path, CAST(floor(CASE WHEN path LIKE '%.rs' THEN 1.0 WHEN path LIKE '%.md' THEN 0.1 WHEN path LIKE '%.yaml' THEN 0.3 ELSE 1.0 END * 70) + 2 * floor(CASE WHEN path LIKE '%.rs' THEN 1.0 WHEN path LIKE '%.md' THEN 0.1 WHEN path LIKE '%.yaml' THEN 0.3 ELSE 1.0 END * 30) AS BIGINT) AS weight FROM repo_files", "repo_files")
def _(t: Inputs) -> DataFrame:
    zero = {c: F.lit(0) for c in ("models", "generated_models", "routes", "entrypoints", "handlers")}
    return rk.file_weights(t("repo_files").withColumns(zero | {"protected": F.lit(True), "public_symbols": F.lit(2)})).select("path", F.col("weight").cast("long").alias("weight"))


@query("c16_service_map", ", o AS (SELECT path, CASE WHEN path LIKE 'src/tests/%' THEN 'tests' WHEN path LIKE 'src/%' THEN 'core' WHEN path LIKE 'docs/%' THEN 'docs' END AS service FROM repo_files) SELECT path, service FROM o WHERE service IS NOT NULL", "repo_files")
def _(t: Inputs) -> DataFrame:
    return sv.service_of(t("repo_files"), t.spark.createDataFrame([("core", "src"), ("tests", "src/tests"), ("docs", "docs")], "service string, root string"))


@query("c17_data_flow")
def _(t: Inputs) -> DataFrame:
    paths = g.chains(t("links"), t("links").where("source = 'n2'").select(F.col("source").alias("id")), 4)
    symbols = t.table("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("symbol_name"), F.concat(F.lit("f"), F.col("n_nationkey") % 6).alias("file_path"))
    changed = symbols.where("file_path = 'f1'").select(F.col("file_path").alias("path"))
    return rk.data_flow_coupling(paths, symbols, changed, symbols.where("file_path = 'f4'").select(F.col("symbol_name").alias("model_name")))


@query("c19_coverage_delta", ", b AS (SELECT event_type AS kind, count(*) AS before FROM events WHERE ts < TIMESTAMP '2024-01-16 00:00:00' GROUP BY 1), a AS (SELECT event_type AS kind, count(*) AS after FROM events WHERE ts >= TIMESTAMP '2024-01-16 00:00:00' AND event_type <> 'signup' GROUP BY 1) SELECT b.kind, before, coalesce(after, 0) AS after FROM b LEFT JOIN a ON a.kind = b.kind WHERE coalesce(after, 0) < before", "seeds")
def _(t: Inputs) -> DataFrame:
    e = t.table("events").withColumnRenamed("event_type", "kind")
    cut = F.expr("TIMESTAMP_NTZ '2024-01-16 00:00:00'")
    return rk.coverage_delta(e.where(F.col("ts") < cut), e.where((F.col("ts") >= cut) & (F.col("kind") != "signup")))


@query("c22_test_mapping", ", m AS (SELECT id, concat('t', symbol_name) AS n, symbol_name, file_path, (entrypoint_kind = 'TEST') AS is_test FROM symbols), t AS (SELECT * FROM m WHERE is_test), r AS (SELECT * FROM m WHERE is_test IS NOT TRUE) SELECT t.id AS test, r.id AS tested, 0.5::DOUBLE AS confidence, 'NAMING' AS kind FROM t JOIN r ON r.symbol_name = t.symbol_name", "symbols")
def _(t: Inputs) -> DataFrame:
    rows = t("symbols").select("id", "symbol_name", "file_path", F.coalesce(F.col("entrypoint_kind") == "TEST", F.lit(False)).alias("is_test"), s.strip_test_affix(F.concat(F.lit("test_"), "symbol_name")).alias("stripped"))
    none = t.spark.createDataFrame([], "file_path string, target string")
    return sv.test_mapping(rows, none, t.spark.createDataFrame([], "test_file string, file_path string"))


@query("c20_entity_entries", "SELECT tx_id FROM entries WHERE entity = 'entity10' ORDER BY committed_at DESC, tx_id LIMIT 20", "entries")
def _(t: Inputs) -> DataFrame:
    return led.of_entity(t("entries"), "entity10").select("tx_id")


@query("e8_sql_tables", "SELECT item_id, coalesce(array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '(?i)(?:in|on|of)\\s+(\\w+)', 1), lambda x: lower(x)))), ','), '') AS names FROM benchmark")
def _(t: Inputs) -> DataFrame:
    names = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit("(?i)(?:in|on|of)\\s+(\\w+)"), 1), F.lower)))
    return t.table("benchmark").select("item_id", F.array_join(names, ",").alias("names"))


@query("f10_url_parts", "SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS path FROM pages")
def _(t: Inputs) -> DataFrame:
    return t.table("pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.regexp_extract("url", "^https?://[^/]+(/[^?#]*)", 1).alias("path"))


@query("f8_token_estimates", "SELECT doc_id, CAST(ceil(strlen(text) / 4.0) AS BIGINT) AS ceiling, CAST(floor(strlen(text) / 4.0) AS BIGINT) AS floor FROM documents")
def _(t: Inputs) -> DataFrame:
    return t.table("documents").select("doc_id", s.tokens_ceil(F.col("text")).alias("ceiling"), s.tokens_floor(F.col("text")).alias("floor"))
