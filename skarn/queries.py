"""Registered queries of the analytics, each over its whole tables, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bindings import bind, cte
from .functions import scalars as s
from .functions import text as x
from .functions import vectors as v
from .operators import graph as g
from .operators import joins as j
from .operators import predicates as p
from .operators import search as q
from .operators import sets as u
from .plans import history as h
from .plans import ledger as led
from .plans import prediction as pred
from .plans import risk as rk
from .plans import reports as rep
from .plans import services as sv

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NOW = "TIMESTAMP '1998-08-01 00:00:00'"


class Inputs:
    """The bound inputs of a query."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return bind(self.spark, self.sf_dir, name)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None, *bindings: str) -> Callable:
    """Registers ``f(inputs)``; sql is a SELECT, with its bindings as CTEs before it (or further CTEs after a comma)."""

    def add(f: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Inputs(spark, sf_dir))
        if sql:
            SQL[name] = f"{cte(*bindings)}{sql}" if bindings and sql.lstrip().startswith(",") else f"{cte(*bindings)}\n{sql}" if bindings else sql
        return f

    return add


def now() -> Column:
    return F.expr("TIMESTAMP_NTZ '1998-08-01 00:00:00'")


# History

_FREQ = "freq AS (SELECT file, sum(power(2.0, -CAST(commit_idx AS DOUBLE) / 100)) AS frequency FROM commit_files GROUP BY file)"
_CPLX = "cx AS (SELECT file_path AS file, max(greatest(coalesce(cognitive_complexity, 0), coalesce(cyclomatic_complexity, 0))) AS complexity FROM symbols GROUP BY file_path)"
_HOT = f", {_FREQ}, {_CPLX}, j AS (SELECT freq.file, frequency, coalesce(complexity, 0) AS complexity FROM freq LEFT JOIN cx ON freq.file = cx.file), sc AS (SELECT *, frequency / max(frequency) OVER () * complexity / greatest(max(complexity) OVER (), 1) AS score FROM j)"


@query("c1_hotspots", _HOT + " SELECT file, round(frequency, 6) AS frequency, complexity, round(score, 6) AS score, round(ln(1 + 1000 * score), 5) AS display FROM sc ORDER BY score DESC, file LIMIT 50", "commit_files", "symbols")
def _(t: Inputs) -> DataFrame:
    r = h.hotspots(t("commit_files"), t("symbols"), half_life=100, limit=50)
    return r.select("file", F.round("frequency", 6).alias("frequency"), "complexity", F.round("score", 6).alias("score"), F.round("display", 5).alias("display"))


@query("p1_path_filters", f", {_FREQ} SELECT file, round(frequency, 6) AS frequency FROM freq WHERE file LIKE 'src/s1%' AND file LIKE '%.rs'", "commit_files")
def _(t: Inputs) -> DataFrame:
    r = h.frequencies(t("commit_files"), 100, p.path_filter(F.col("file"), directory="src/s1", language="rs"))
    return r.select("file", F.round("frequency", 6).alias("frequency"))


_ELIG = "el AS (SELECT DISTINCT commit_idx, file FROM commit_files WHERE NOT is_merge AND file IS NOT NULL), ok AS (SELECT commit_idx FROM el GROUP BY 1 HAVING count(*) <= 50), e2 AS (SELECT el.* FROM el JOIN ok USING (commit_idx))"


@query("p2_eligible_commits", f", {_ELIG} SELECT commit_idx, count(*) AS files FROM e2 GROUP BY 1", "commit_files")
def _(t: Inputs) -> DataFrame:
    return p.eligible_commits(t("commit_files")).groupBy("commit_idx").agg(F.count(F.lit(1)).alias("files"))


@query("c2_temporal_coupling", f", {_ELIG}, ps AS (SELECT commit_idx, row_number() OVER (ORDER BY commit_idx) - 1 AS pos FROM (SELECT DISTINCT commit_idx FROM e2) z), w AS (SELECT e2.commit_idx, file, power(2.0, -CAST(pos AS DOUBLE) / 100) AS w FROM e2 JOIN ps USING (commit_idx)), tot AS (SELECT file, sum(w) AS total FROM w GROUP BY file HAVING count(*) >= 5), pr AS (SELECT a.file AS fa, b.file AS fb, sum(a.w) AS sh FROM w a JOIN w b ON a.commit_idx = b.commit_idx AND a.file < b.file WHERE a.file IN (SELECT file FROM tot) AND b.file IN (SELECT file FROM tot) GROUP BY 1, 2 HAVING count(*) >= 3), bo AS (SELECT fa AS file_a, fb AS file_b, sh FROM pr UNION ALL SELECT fb, fa, sh FROM pr) SELECT file_a, file_b, round(sh / total, 6) AS score FROM bo JOIN tot ON tot.file = bo.file_a WHERE sh / total > 0.05", "commit_files")
def _(t: Inputs) -> DataFrame:
    return h.temporal_coupling(t("commit_files"), threshold=0.05).select("file_a", "file_b", F.round("score", 6).alias("score"))


@query("s1_history_scan", ", c AS (SELECT commit, max(commit_ts) AS ts, bool_or(is_merge) AS m FROM log GROUP BY commit ORDER BY ts DESC, commit DESC LIMIT 1000), n AS (SELECT *, row_number() OVER (ORDER BY ts DESC, commit DESC) - 1 AS i FROM c), k AS (SELECT * FROM n WHERE ts >= (SELECT max(ts) FROM n) - INTERVAL 10 DAY) SELECT i AS commit_idx, k.commit, m AS is_merge, CASE WHEN m THEN NULL ELSE file END AS file FROM k JOIN (SELECT DISTINCT commit, file FROM log) f ON f.commit = k.commit", "log")
def _(t: Inputs) -> DataFrame:
    return h.scan_history(t("log"), 1000, 10).select("commit_idx", "commit", "is_merge", "file")


@query("c21_hotspot_budget", "SELECT file_path, round(score, 6) AS score FROM history WHERE timestamp = (SELECT max(timestamp) FROM history) AND score > 5", "history")
def _(t: Inputs) -> DataFrame:
    return h.over_budget(t("history")).select("file_path", F.round("score", 6).alias("score"))


@query("c21_hotspot_trend", "SELECT strftime(timestamp, '%Y-%m-%d') AS day, round(score, 6) AS score FROM history WHERE file_path = 'f8' AND timestamp >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 20 DAY", "history")
def _(t: Inputs) -> DataFrame:
    return h.trend(t("history"), "f8", F.expr("TIMESTAMP '2024-01-31 00:00:00'"), 20).select(F.date_format("timestamp", "yyyy-MM-dd").alias("day"), F.round("score", 6).alias("score"))


# Joins

_SC = ", sc AS (SELECT DISTINCT f.file_path AS caller_file, a.symbol_name AS caller_symbol, b.symbol_name AS callee_symbol FROM calls JOIN symbols a ON a.id = caller_symbol_id JOIN files f ON f.id = a.file_id JOIN symbols b ON b.id = callee_symbol_id WHERE b.symbol_name IN (SELECT symbol_name FROM changed_symbols))"


@query("j1_structural_coupling", _SC + " SELECT * FROM sc", "calls", "symbols", "files", "changed_symbols")
def _(t: Inputs) -> DataFrame:
    return j.structural_coupling(t("calls"), t("symbols"), t("files"), t("changed_symbols"))


@query("j2_callers", _SC + " SELECT * FROM sc UNION SELECT f.file_path, a.symbol_name, c.unresolved_callee FROM calls c JOIN symbols a ON a.id = c.caller_symbol_id JOIN files f ON f.id = a.file_id WHERE c.callee_symbol_id IS NULL AND c.unresolved_callee IN (SELECT symbol_name FROM changed_symbols)", "calls", "symbols", "files", "changed_symbols")
def _(t: Inputs) -> DataFrame:
    return j.callers(t("calls"), t("symbols"), t("files"), t("changed_symbols"))


@query("j3_tests_by_file", "SELECT f.file_path AS tested_file, array_to_string(list_sort(list(DISTINCT s.symbol_name)), ',') AS tests FROM mapping m JOIN symbols s ON s.id = m.test_symbol_id JOIN files f ON f.id = m.tested_file_id GROUP BY 1", "mapping", "symbols", "files")
def _(t: Inputs) -> DataFrame:
    return j.tests_by_file(t("mapping"), t("symbols"), t("files")).select("tested_file", F.array_join("tests", ",").alias("tests"))


@query("j4_call_projection", ", p AS (SELECT a.qualified_name AS source, coalesce(b.qualified_name, unresolved_callee) AS target FROM calls JOIN symbols a ON a.id = caller_symbol_id LEFT JOIN symbols b ON b.id = callee_symbol_id) SELECT source, target, count(*) AS n FROM p WHERE target IS NOT NULL GROUP BY 1, 2", "calls", "symbols")
def _(t: Inputs) -> DataFrame:
    return j.call_projection(t("calls"), t("symbols")).groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


@query("j10_service_summary", "SELECT service_name, count(DISTINCT f.id) AS files, count(r.id) AS routes FROM files f LEFT JOIN routes r ON r.file_id = f.id WHERE service_name IS NOT NULL GROUP BY 1", "files", "routes")
def _(t: Inputs) -> DataFrame:
    return j.service_summary(t("files"), t("routes"))


@query("j12_undeclared", "SELECT DISTINCT concat('V', c_custkey) AS var_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def _(t: Inputs) -> DataFrame:
    refs = t.table("customer").select(F.concat(F.lit("V"), "c_custkey").alias("var_name"))
    return j.undeclared(refs, t.table("orders").where("o_orderstatus = 'P'").select(F.concat(F.lit("V"), "o_custkey").alias("var_name"))).distinct()


@query("j13_config_diff", ", a AS (SELECT DISTINCT entity FROM before WHERE n > 5), b AS (SELECT DISTINCT entity FROM after WHERE n > 12) SELECT entity, 'left_only' AS side FROM a WHERE entity NOT IN (SELECT entity FROM b) UNION ALL SELECT entity, 'right_only' FROM b WHERE entity NOT IN (SELECT entity FROM a)", "before", "after")
def _(t: Inputs) -> DataFrame:
    return j.both_differences(t("before").where("n > 5"), t("after").where("n > 12"), "entity")


@query("j15_longest_prefix", ", pre AS (SELECT DISTINCT split_part(path, '/', 1) AS prefix FROM urls UNION SELECT DISTINCT concat(split_part(path, '/', 1), '/', split_part(path, '/', 2)) FROM urls) SELECT page_id, (SELECT prefix FROM pre WHERE urls.path = prefix OR urls.path LIKE concat(prefix, '/%') ORDER BY length(prefix) DESC LIMIT 1) AS prefix FROM urls", "urls")
def _(t: Inputs) -> DataFrame:
    urls = t("urls")
    part = F.split("path", "/")
    prefixes = urls.select(part[0].alias("prefix")).union(urls.select(F.concat(part[0], F.lit("/"), F.coalesce(F.get(part, F.lit(1)), F.lit(""))))).distinct()
    return j.longest_prefix(urls, prefixes.where(~F.col("prefix").endswith("/"))).select("page_id", "prefix")


@query("j17_cross_service", "SELECT concat('svc', cast(n1.n_regionkey AS VARCHAR)) AS source_service, concat('svc', cast(n2.n_regionkey AS VARCHAR)) AS target_service, count(*) AS calls FROM links l JOIN nation n1 ON concat('n', n1.n_nationkey) = l.source JOIN nation n2 ON concat('n', n2.n_nationkey) = l.target WHERE n1.n_regionkey <> n2.n_regionkey GROUP BY 1, 2", "links")
def _(t: Inputs) -> DataFrame:
    owners = t.table("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("path"), F.concat(F.lit("svc"), "n_regionkey").alias("service"))
    return j.cross_service(t("links").select(F.col("source").alias("source_file"), F.col("target").alias("target_file")), owners)


@query("j18_semantic_duplicates", ", e AS (SELECT vec_id, embedding AS v FROM embeddings) SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v::DOUBLE[], b.v::DOUBLE[]), 5) AS similarity FROM e a JOIN e b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.v::DOUBLE[], b.v::DOUBLE[]) > 0.4", "seeds")
def _(t: Inputs) -> DataFrame:
    return j.similar_pairs(t.table("embeddings"), 0.4, "vec_id").select("a", "b", F.round("similarity", 5).alias("similarity"))


@query("j19_best_endpoints", "SELECT endpoint, path, round(similarity, 5) AS similarity FROM (SELECT e.vec_id AS endpoint, f.vec_id AS path, list_cosine_similarity(e.embedding::DOUBLE[], f.embedding::DOUBLE[]) AS similarity, row_number() OVER (PARTITION BY e.vec_id ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], f.embedding::DOUBLE[]) DESC, f.vec_id) AS r FROM embeddings e, embeddings f WHERE e.label = 1 AND f.label = 0) z WHERE r = 1 AND similarity >= 0.2 ORDER BY similarity DESC, path, endpoint LIMIT 10")
def _(t: Inputs) -> DataFrame:
    e = t.table("embeddings")
    r = j.best_endpoints(e.where("label = 0").withColumnRenamed("vec_id", "path"), e.where("label = 1").withColumnRenamed("vec_id", "endpoint"), 0.2)
    return r.select("endpoint", "path", F.round("similarity", 5).alias("similarity"))


@query("j20_pattern_join", "SELECT DISTINCT e.source, e.target FROM edges e JOIN nodes a ON a.id = e.source AND a.category = 'service' JOIN nodes b ON b.id = e.target AND b.category = 'file' WHERE relation = 'calls'", "nodes", "edges")
def _(t: Inputs) -> DataFrame:
    return j.pattern_join(t("nodes"), t("edges"), "service", "calls", "file")


@query("j21_file_dependencies", "SELECT DISTINCT a.file_path AS src_file, b.file_path AS tgt_file FROM calls JOIN symbols a ON a.id = caller_symbol_id JOIN symbols b ON b.id = callee_symbol_id WHERE a.file_path <> b.file_path", "calls", "symbols")
def _(t: Inputs) -> DataFrame:
    return j.file_dependencies(t("calls"), t("symbols"))


@query("j26_call_resolution", ", n AS (SELECT symbol_name, count(*) AS n, min(id) AS id FROM symbols GROUP BY 1), c AS (SELECT DISTINCT unresolved_callee AS callee FROM calls WHERE unresolved_callee IS NOT NULL) SELECT callee, CASE WHEN n = 1 THEN id END AS callee_id, CASE WHEN n IS NULL THEN 'UNRESOLVED' WHEN n = 1 THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS status FROM c LEFT JOIN n ON n.symbol_name = c.callee", "calls", "symbols")
def _(t: Inputs) -> DataFrame:
    c = t("calls").where("unresolved_callee is not null").select(F.col("unresolved_callee").alias("callee")).distinct()
    return j.resolve_calls(c, t("symbols")).select("callee", "callee_id", "status")


# Aggregates

@query("a5_conditional_counts", "SELECT test_file, count(*) FILTER (WHERE outcome = 'fail') AS failures, count(*) AS runs, round((count(*) FILTER (WHERE outcome = 'fail') + 1.0) / (count(*) + 2.0), 6) AS probability FROM outcomes WHERE diff_embedding_id IN (SELECT diff_embedding_id FROM outcomes GROUP BY 1 ORDER BY max(recorded_at) DESC, diff_embedding_id DESC LIMIT 1000) GROUP BY 1", "outcomes")
def _(t: Inputs) -> DataFrame:
    return pred.failure_probabilities(t("outcomes")).select("test_file", "failures", "runs", F.round("probability", 6).alias("probability"))


@query("a7_churn", "SELECT entity, count(*) AS entries FROM entries GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", "entries")
def _(t: Inputs) -> DataFrame:
    return led.churn(t("entries"))


@query("a8_velocity", f"SELECT count(*) FILTER (WHERE committed_at >= {NOW} - INTERVAL 7 DAY) AS week, count(*) FILTER (WHERE committed_at >= {NOW} - INTERVAL 30 DAY) AS month, count(*) AS total FROM entries", "entries")
def _(t: Inputs) -> DataFrame:
    return led.velocity(t("entries"), now())


@query("a10_ci_failure_scores", ", hits AS (SELECT DISTINCT diff_embedding_id, CAST(diff_embedding_id % 97 AS DOUBLE) / 97 AS similarity FROM outcomes) SELECT job_name, round(avg(similarity), 6) AS score FROM outcomes JOIN hits USING (diff_embedding_id) WHERE outcome = 'fail' GROUP BY 1", "outcomes")
def _(t: Inputs) -> DataFrame:
    hits = t("outcomes").select("diff_embedding_id", ((F.col("diff_embedding_id") % 97).cast("double") / 97).alias("similarity")).distinct()
    return pred.ci_failure_scores(hits, t("outcomes")).select("job_name", F.round("score", 6).alias("score"))


@query("a9_similar_outcomes", ", hits AS (SELECT DISTINCT diff_embedding_id, CAST(diff_embedding_id % 89 AS DOUBLE) / 89 AS similarity FROM outcomes) SELECT test_file, round(avg(similarity), 6) AS mean_similarity, count(*) AS runs FROM outcomes JOIN hits USING (diff_embedding_id) GROUP BY 1", "outcomes")
def _(t: Inputs) -> DataFrame:
    hits = t("outcomes").select("diff_embedding_id", ((F.col("diff_embedding_id") % 89).cast("double") / 89).alias("similarity")).distinct()
    return pred.similar_outcomes(hits, t("outcomes"), "test_file").select("test_file", F.round("mean_similarity", 6).alias("mean_similarity"), "runs")


@query("a12_rule_scores", "SELECT concat('f', user_id) AS path, max(CASE event_type WHEN 'view' THEN 0.5 WHEN 'click' THEN 0.6 WHEN 'signup' THEN 0.7 WHEN 'purchase' THEN 0.8 ELSE 0.65 END)::DOUBLE AS score FROM events GROUP BY 1")
def _(t: Inputs) -> DataFrame:
    kinds = {"view": "TestMapping", "click": "Structural", "signup": "CallGraph", "purchase": "Temporal", "error": "Runtime"}
    reason = F.element_at(F.create_map(*[F.lit(z) for kv in kinds.items() for z in kv]), F.col("event_type"))
    return pred.rule_scores(t.table("events").select(F.concat(F.lit("f"), "user_id").alias("path"), reason.alias("reason")))


@query("a17_risk_levels", ", w AS (SELECT o_custkey AS id, CAST(sum(o_orderkey % 13) AS BIGINT) AS total FROM orders GROUP BY 1) SELECT id, total, CASE WHEN total > 50 THEN 'High' WHEN total > 20 THEN 'Medium' ELSE 'Low' END AS level FROM w", "seeds")
def _(t: Inputs) -> DataFrame:
    w = t.table("orders").groupBy(F.col("o_custkey").alias("id")).agg(F.sum(F.col("o_orderkey") % 13).alias("total"))
    return w.withColumn("level", s.weight_level(F.col("total")))


@query("a19_mean_pool", ", e AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) SELECT label, i AS position, round(avg(x::DOUBLE), 5) AS mean FROM e GROUP BY 1, 2", "seeds")
def _(t: Inputs) -> DataFrame:
    pooled = v.mean_pool(t.table("embeddings"), ["label"], "embedding")
    return pooled.select("label", F.posexplode("embedding").alias("p", "m")).select("label", (F.col("p") + 1).cast("long").alias("position"), F.round("m", 5).alias("mean"))


@query("a15_log_signals", ", l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), e AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l) SELECT substr(line, 1, 80) AS signal, count(*) AS count, CASE WHEN count(*) > 10 THEN 'Critical' WHEN count(*) > 3 THEN 'Warning' ELSE 'Normal' END AS severity FROM e WHERE regexp_matches(line, '(?i)error|license|password') GROUP BY 1", "seeds")
def _(t: Inputs) -> DataFrame:
    lines = t.table("documents").select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n", -1)).alias("seq", "line"))
    return rk.log_signals(lines, "(?i)error|license|password").select("signal", "count", "severity")


@query("w7_greedy_budget", "SELECT o_custkey AS customer, o_orderkey AS id FROM (SELECT o_custkey, o_orderkey, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS s FROM orders) z WHERE s <= 500000")
def _(t: Inputs) -> DataFrame:
    rows = t.table("orders")
    return q.greedy_budget(rows, 500_000, [F.col("o_orderdate"), F.col("o_orderkey")], "o_totalprice", ["o_custkey"]).select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("id"))


# Top-k and vectors

@query("t2_cosine_top_k", "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 5) AS similarity FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) DESC, vec_id LIMIT 10")
def _(t: Inputs) -> DataFrame:
    e = t.table("embeddings")
    wanted = e.where("vec_id = 0").first()["embedding"]
    return v.top_k(e, wanted, 10, "vec_id", "embedding").select("vec_id", F.round("similarity", 5).alias("similarity"))


@query("x11_sanitised_vectors", "SELECT vec_id, round(embedding[1] / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS first FROM embeddings")
def _(t: Inputs) -> DataFrame:
    return t.table("embeddings").select("vec_id", F.round(F.element_at(v.sanitise(F.col("embedding")), 1), 5).alias("first"))


@query("t5_paging", "SELECT tx_id, entity FROM entries ORDER BY committed_at DESC, tx_id LIMIT 20 OFFSET 40", "entries")
def _(t: Inputs) -> DataFrame:
    return t("entries").orderBy(F.desc("committed_at"), "tx_id").offset(40).limit(20).select("tx_id", "entity")


@query("t6_capped_edges", "SELECT caller_symbol_id AS caller, count(*) FILTER (WHERE r > 20) AS capped, count(*) AS edges FROM (SELECT *, row_number() OVER (PARTITION BY caller_symbol_id ORDER BY confidence DESC, callee_symbol_id) AS r FROM calls WHERE callee_symbol_id IS NOT NULL) z GROUP BY 1", "calls")
def _(t: Inputs) -> DataFrame:
    rows = t("calls").where("callee_symbol_id is not null").select(F.col("caller_symbol_id").alias("file"), "confidence", "callee_symbol_id")
    marked = j.mark_capped(rows.select("file", F.col("confidence").alias("is_public"), F.col("callee_symbol_id").alias("caller"), F.lit(0).alias("callee"), F.lit("RESOLVED").alias("status")), 20)
    return marked.groupBy(F.col("file").alias("caller")).agg(F.count_if(F.col("status") == "CAPPED").alias("capped"), F.count(F.lit(1)).alias("edges"))


# Sets

@query("u2_symbol_diff", "SELECT coalesce(b.entity, a.entity) AS entity, coalesce(b.kind, a.kind) AS kind, CASE WHEN b.entity IS NULL THEN 'ADDED' WHEN a.entity IS NULL THEN 'DELETED' ELSE 'MODIFIED' END AS change FROM before b FULL JOIN after a ON a.entity = b.entity AND a.kind = b.kind WHERE b.entity IS NULL OR a.entity IS NULL OR a.n <> b.n", "before", "after")
def _(t: Inputs) -> DataFrame:
    return u.diff(t("before"), t("after"), ["entity", "kind"], F.col("n"))


@query("u5_first_wins", "SELECT entity, kind, n, 1 AS side FROM before UNION ALL SELECT entity, kind, n, 2 FROM after a WHERE NOT EXISTS (SELECT 1 FROM before b WHERE b.entity = a.entity AND b.kind = a.kind)", "before", "after")
def _(t: Inputs) -> DataFrame:
    return u.first_wins([t("before").withColumn("side", F.lit(1)), t("after").withColumn("side", F.lit(2))], ["entity", "kind"])


@query("u7_blend", "SELECT coalesce(a.path, b.path) AS path, round(coalesce(a.score, 0) * 0.7 + coalesce(b.score, 0) * 0.3, 6) AS score FROM score_a a FULL JOIN score_b b ON a.path = b.path", "score_a", "score_b")
def _(t: Inputs) -> DataFrame:
    return u.blend_scores(t("score_a"), t("score_b")).select("path", F.round("score", 6).alias("score"))


@query("u8_change_detection", "SELECT coalesce(a.item_id, b.doc_id) AS id, CASE WHEN a.item_id IS NULL THEN 'new' WHEN b.doc_id IS NULL THEN 'orphan' WHEN sha256(a.text) = sha256(b.text) THEN 'same' ELSE 'changed' END AS state FROM benchmark a FULL JOIN documents b ON a.item_id = b.doc_id")
def _(t: Inputs) -> DataFrame:
    stored = t.table("benchmark").select(F.col("item_id").alias("id"), s.content_hash(F.col("text")).alias("content_hash"))
    return u.detect_changes(stored, t.table("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")), "id")


@query("u9_drift_counts", "SELECT path AS entity, count(*) AS drift_count, epoch(max(ts)) - epoch(min(ts)) AS seconds FROM watch GROUP BY 1", "watch")
def _(t: Inputs) -> DataFrame:
    r = u.drift_counts(t("watch").withColumnRenamed("path", "entity"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp")).cast("double") / 1e6
    return r.select("entity", "drift_count", (micros("last_seen") - micros("first_seen")).alias("seconds"))


@query("p12_latest_events", "SELECT path, arg_max(kind, CASE WHEN kind <> 'Unknown' THEN seq + 1000000000000 ELSE seq END) AS kind FROM watch WHERE path LIKE '%.rs' GROUP BY 1", "watch")
def _(t: Inputs) -> DataFrame:
    return p.latest_events(t("watch"), ["rs"])


@query("l14_merge_scores", "SELECT coalesce(a.path, b.path) AS path, round(coalesce(b.score, a.score), 6) AS score FROM score_a a FULL JOIN score_b b ON a.path = b.path", "score_a", "score_b")
def _(t: Inputs) -> DataFrame:
    return p.merge_scores(t("score_a"), t("score_b")).select("path", F.round("score", 6).alias("score"))


@query("l1_changed_flag", "SELECT f.file_path, bool_or(c.path IS NOT NULL) AS is_changed FROM files f LEFT JOIN changed c ON c.path = f.file_path GROUP BY 1", "files", "changed")
def _(t: Inputs) -> DataFrame:
    return p.changed_flag(t("files"), t("changed")).select("file_path", "is_changed")


@query("l5_endpoints", "SELECT method, path, count(*) AS n FROM routes WHERE method = 'GET' AND path LIKE '%/o/%' GROUP BY 1, 2", "routes")
def _(t: Inputs) -> DataFrame:
    return p.endpoints(t("routes"), "get", "/o/").groupBy("method", "path").agg(F.count(F.lit(1)).alias("n"))


@query("l9_ledger_status", f"SELECT count(*) FILTER (WHERE status = 'PENDING') AS pending, count(*) FILTER (WHERE status = 'UNAUDITED') AS unaudited, CAST(coalesce(sum(drift_count) FILTER (WHERE status = 'UNAUDITED'), 0) AS BIGINT) AS drift, count(*) FILTER (WHERE status = 'PENDING' AND started_at < {NOW} - INTERVAL 24 HOUR) AS stale FROM transactions", "transactions")
def _(t: Inputs) -> DataFrame:
    return led.status(t("transactions"), now())


@query("l12_federated_export", f"SELECT tx_id, entity FROM entries WHERE origin = 'LOCAL' AND committed_at >= {NOW} - INTERVAL 30 DAY", "entries")
def _(t: Inputs) -> DataFrame:
    return led.federated(t("entries"), now()).select("tx_id", "entity")


@query("c20_decisions", "SELECT e.tx_id, coalesce(CASE WHEN t.status = 'COMMITTED' THEN 'accepted' END, 'proposed') AS adr_status FROM entries e LEFT JOIN transactions t ON t.tx_id = e.tx_id WHERE e.category = 'ARCHITECTURE'", "entries", "transactions")
def _(t: Inputs) -> DataFrame:
    meta = t("transactions").where("status = 'COMMITTED'").select("tx_id", F.lit("accepted").alias("status"))
    return led.decisions(t("entries"), meta).select("tx_id", "adr_status")


@query("c20_by_origin", "SELECT origin, count(*) AS entries FROM entries GROUP BY 1", "entries")
def _(t: Inputs) -> DataFrame:
    return led.by_origin(t("entries"))


# Graph

_REACH = ", r(target, relation, hops) AS (SELECT DISTINCT e.target, e.relation, 1 FROM edges e JOIN seeds s ON s.id = e.source UNION SELECT e.target, e.relation, r.hops + 1 FROM r JOIN edges e ON e.source = r.target WHERE r.hops < 3)"


@query("g1_reach_hops", _REACH + " SELECT target, relation, hops FROM r", "edges", "seeds")
def _(t: Inputs) -> DataFrame:
    return g.reach_hops(t("edges"), t("seeds"), 3)


@query("g2_related", _REACH + " SELECT target, hops FROM r WHERE relation = 'calls'", "edges", "seeds")
def _(t: Inputs) -> DataFrame:
    return g.related(t("edges"), t("seeds"), 3, ["calls"]).select("target", "hops")


@query("g3_reachable", ", r(id) AS (SELECT target FROM links WHERE source = 'n2' UNION SELECT l.target FROM r JOIN links l ON l.source = r.id) SELECT id FROM r", "links")
def _(t: Inputs) -> DataFrame:
    return g.reachable(t("links"), t("links").where("source = 'n2'").select(F.col("source").alias("id")))


@query("g5_entry_counts", ", r(entry, id, d) AS (SELECT concat('n', n_nationkey), concat('n', n_nationkey), 0 FROM nation WHERE n_regionkey < 2 UNION SELECT entry, l.target, d + 1 FROM r JOIN links l ON l.source = r.id WHERE d < 20) SELECT id, count(DISTINCT entry) AS entries FROM r GROUP BY 1", "links")
def _(t: Inputs) -> DataFrame:
    return g.entry_counts(t("links"), t.table("nation").where("n_regionkey < 2").select(F.concat(F.lit("n"), "n_nationkey").alias("id")), 20)


@query("g6_pagerank")
def _(t: Inputs) -> DataFrame:
    return g.pagerank(t("links"), rounds=8).select("id", F.round("rank", 8).alias("rank"))


@query("g7_communities")
def _(t: Inputs) -> DataFrame:
    return g.communities(t("links"), 5)


@query("g9_neighbourhood", ", b AS (SELECT source, target FROM links UNION SELECT target, source FROM links), r(id, depth) AS (SELECT 'n1', 0 UNION SELECT b.target, r.depth + 1 FROM r JOIN b ON b.source = r.id WHERE r.depth < 2) SELECT id, min(depth) AS depth FROM r GROUP BY 1", "links")
def _(t: Inputs) -> DataFrame:
    return g.neighbourhood(t("links"), t.spark.createDataFrame([("n1",)], "id string"), 2)[0]


@query("g10_propagated_risk", "SELECT n.id, greatest(n.risk_score, coalesce(max(m.risk_score) * 0.5, 0)) AS risk_score FROM nodes n LEFT JOIN edges e ON e.target = n.id LEFT JOIN nodes m ON m.id = e.source GROUP BY n.id, n.risk_score", "nodes", "edges")
def _(t: Inputs) -> DataFrame:
    return g.propagate_risk(t("nodes"), t("edges")).select("id", "risk_score")


@query("g11_call_chains")
def _(t: Inputs) -> DataFrame:
    r = g.chains(t("links"), t("links").where("source = 'n2'").select(F.col("source").alias("id")), 5)
    return r.select(F.array_join("path", ">").alias("chain"), "cyclic")


@query("g12_touching", "SELECT DISTINCT source, target, relation FROM edges WHERE source IN (SELECT id FROM seeds) OR target IN (SELECT id FROM seeds) ORDER BY 1, 2, 3 LIMIT 50", "edges", "seeds")
def _(t: Inputs) -> DataFrame:
    return g.touching(t("edges"), t("seeds"), 50)


@query("g14_pruned", ", live AS (SELECT DISTINCT e.target FROM edges e JOIN nodes n ON n.id = e.source WHERE relation = 'imports') SELECT id FROM nodes WHERE category <> 'service' OR id IN (SELECT target FROM live)", "nodes", "edges")
def _(t: Inputs) -> DataFrame:
    return g.prune_orphans(t("nodes"), t("edges"), "service", "imports").select("id")


@query("u3_graph_diff", ", a AS (SELECT source, target FROM links WHERE relation = 'calls'), b AS (SELECT source, target FROM links WHERE relation = 'imports') SELECT coalesce(a.source, b.source) AS source, coalesce(a.target, b.target) AS target, CASE WHEN a.source IS NULL THEN 'ADDED' ELSE 'DELETED' END AS change FROM a FULL JOIN b ON a.source = b.source AND a.target = b.target WHERE a.source IS NULL OR b.source IS NULL", "links")
def _(t: Inputs) -> DataFrame:
    side = lambda r: t("links").where(F.col("relation") == r).withColumn("relation", F.lit(""))
    return u.graph_diff(t("nodes"), t("nodes"), side("calls"), side("imports"))[1].drop("relation")


# Text

def _index(t: Inputs) -> q.Index:
    return q.Index.build(t.table("documents").select("doc_id", "text"))


@query("x1_trigrams", "SELECT item_id, count(DISTINCT substr(text, i, 3)) AS grams FROM (SELECT item_id, text, unnest(range(1, CAST(length(text) - 1 AS BIGINT))) AS i FROM benchmark) z GROUP BY 1")
def _(t: Inputs) -> DataFrame:
    return t.table("benchmark").select("item_id", F.size(x.trigrams(F.col("text"))).cast("long").alias("grams"))


@query("x4_regex_lines", ", l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), e AS (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM l) SELECT doc_id AS doc, i AS line, trim(l) AS content FROM e WHERE strlen(l) <= 1000 AND regexp_matches(l, 'Licensed under (the|CC)')", "seeds")
def _(t: Inputs) -> DataFrame:
    return q.regex_scan(t.table("documents"), "Licensed under (the|CC)").select("doc", F.col("line").cast("long").alias("line"), "content")


_TOK = "tok AS (SELECT doc_id AS doc, unnest(regexp_split_to_array(lower(regexp_replace(regexp_replace(text, '([\\p{Ll}])([\\p{Lu}])', '\\1 \\2', 'g'), '([\\p{Lu}])([\\p{Lu}][\\p{Ll}])', '\\1 \\2', 'g')), '[^\\p{L}\\p{N}]+')) AS term FROM documents), tk AS (SELECT * FROM tok WHERE term <> '')"


@query("x6_bm25", f", {_TOK}, dl AS (SELECT d.doc_id AS doc, count(term) AS l FROM documents d LEFT JOIN tk ON tk.doc = d.doc_id GROUP BY 1), st AS (SELECT count(*) AS n, avg(l) AS m FROM dl), tf AS (SELECT doc, term, count(*) AS tf FROM tk WHERE term IN ('license', 'apache', 'public') GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), sc AS (SELECT tf.doc, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / m))) AS score FROM tf JOIN df USING (term) JOIN dl ON dl.doc = tf.doc, st GROUP BY 1) SELECT doc, round(score, 5) AS score FROM sc ORDER BY round(score, 9) DESC, doc LIMIT 10", "seeds")
def _(t: Inputs) -> DataFrame:
    return q.bm25_scan(t.table("documents"), "Apache license public").select("doc", F.round("score", 5).alias("score"))


@query("x7_fuzzy", f", {_TOK} SELECT term, levenshtein(term, 'lisence') AS distance, count(DISTINCT doc) AS docs FROM tk WHERE levenshtein(term, 'lisence') <= 2 GROUP BY 1, 2", "seeds")
def _(t: Inputs) -> DataFrame:
    r = _index(t).fuzzy("lisence", 2, None)
    return r.groupBy("term", F.col("distance").cast("long").alias("distance")).agg(F.count_distinct("doc").alias("docs"))


@query("x8_ledger_search")
def _(t: Inputs) -> DataFrame:
    return q.ledger_search(t("entries"), "order urgent", category="FEATURE", limit=25).select("tx_id", F.round("score", 5).alias("score"))


@query("u6_hybrid")
def _(t: Inputs) -> DataFrame:
    return _index(t).hybrid("Apache license", "Licensed under", 20)


@query("x14_word_jaccard", ", a AS (SELECT item_id AS i, list_distinct(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS w FROM benchmark) SELECT x.i AS a, y.i AS b, round(CAST(len(list_intersect(x.w, y.w)) AS DOUBLE) / len(list_distinct(list_concat(x.w, y.w))), 6) AS similarity FROM a x JOIN a y ON x.i < y.i", "seeds")
def _(t: Inputs) -> DataFrame:
    b = t.table("benchmark")
    y = b.select(F.col("item_id").alias("b"), F.col("text").alias("tb"))
    return b.select(F.col("item_id").alias("a"), F.col("text").alias("ta")).join(y, F.col("a") < F.col("b")).select("a", "b", F.round(q.word_jaccard(F.col("ta"), F.col("tb")), 6).alias("similarity"))


@query("x15_keyword_share", "SELECT doc_id, round((CASE WHEN contains(lower(text), 'license') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'under') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'version') THEN 1 ELSE 0 END) / 3.0, 6)::DOUBLE AS share FROM documents")
def _(t: Inputs) -> DataFrame:
    words = F.array(*map(F.lit, ["License", "under", "of", "version"]))
    return t.table("documents").select("doc_id", F.round(x.keyword_share(words, F.col("text")), 6).alias("share"))


@query("x17_fixed_chunks", "SELECT doc_id, CAST(i AS INT) AS chunk, substr(text, i * 1800 + 1, 2000) AS content FROM (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil((length(text) - 200) / 1800.0) AS BIGINT)))) AS i FROM documents WHERE length(text) > 0) z")
def _(t: Inputs) -> DataFrame:
    return t.table("documents").select("doc_id", F.posexplode(x.fixed_chunks(F.col("text"))).alias("chunk", "content"))


@query("x16_markdown_chunks")
def _(t: Inputs) -> DataFrame:
    docs = t.table("documents").select(F.col("doc_id").cast("string").alias("file_path"), F.concat(F.lit("# Head\n"), F.col("text")).alias("content"))
    return q.markdown_chunks(docs).select("file_path", "chunk_index", "token_count")


# Scalars

@query("f4_entropy", "SELECT s_suppkey AS id, round(entropy, 5) AS entropy FROM (SELECT s_suppkey, -sum(p * log2(p)) AS entropy FROM (SELECT s_suppkey, count(*) / CAST(sum(count(*)) OVER (PARTITION BY s_suppkey) AS DOUBLE) AS p FROM (SELECT s_suppkey, unnest(string_split(s_name, '')) AS c FROM supplier) a GROUP BY s_suppkey, c) b GROUP BY s_suppkey) z")
def _(t: Inputs) -> DataFrame:
    return t.table("supplier").select(F.col("s_suppkey").alias("id"), F.round(s.entropy(F.col("s_name")), 5).alias("entropy"))


@query("f10_secret_types", "SELECT doc_id, CASE WHEN regexp_matches(text, 'AKIA[0-9A-Z]{16}') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(text, '(?:secret|password|token|api_key|apikey|access_key)\\s*[:=]\\s*[''\"]?[A-Za-z0-9+/=_-]{20,}[''\"]?') THEN 1 ELSE 0 END AS kinds FROM documents")
def _(t: Inputs) -> DataFrame:
    return t.table("documents").select("doc_id", F.size(s.secret_types(F.col("text"))).alias("kinds"))


@query("f12_staleness", "SELECT o_orderkey AS id, CASE WHEN d < 100 THEN NULL WHEN d <= 200 THEN 'Warning' ELSE 'Critical' END AS tier FROM (SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-01') AS d FROM orders) z")
def _(t: Inputs) -> DataFrame:
    days = F.datediff(F.lit("1998-08-01").cast("date"), F.col("o_orderdate").cast("date"))
    return t.table("orders").select(F.col("o_orderkey").alias("id"), s.staleness_tier(days, 100).alias("tier"))


@query("f5_probability_levels", "SELECT path, round(least(greatest(score * 0.8 + 0.1, 0.05), 0.95), 6) AS probability, CASE WHEN least(greatest(score * 0.8 + 0.1, 0.05), 0.95) > 0.6 THEN 'High' WHEN least(greatest(score * 0.8 + 0.1, 0.05), 0.95) > 0.3 THEN 'Medium' ELSE 'Low' END AS level FROM score_b", "score_b")
def _(t: Inputs) -> DataFrame:
    pr = s.failure_probability(F.col("score"))
    return t("score_b").select("path", F.round(pr, 6).alias("probability"), s.probability_level(pr).alias("level"))


@query("f19_path_weight", "SELECT path, CASE WHEN path LIKE '%.rs' THEN 1.0 WHEN path LIKE '%.md' THEN 0.1 WHEN path LIKE '%.yaml' THEN 0.3 ELSE 1.0 END::DOUBLE AS weight FROM repo_files", "repo_files")
def _(t: Inputs) -> DataFrame:
    return t("repo_files").select("path", s.path_weight(F.col("path")).alias("weight"))


@query("f7_paths", "SELECT path, regexp_extract(path, '([^/]*)$', 1) AS base, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, regexp_extract(path, '\\.([^./]*)$', 1) AS ext FROM repo_files", "repo_files")
def _(t: Inputs) -> DataFrame:
    c = F.col("path")
    return t("repo_files").select("path", s.basename(c).alias("base"), s.parent(c).alias("parent"), s.extension(c).alias("ext"))


# Plans

@query("c5_dead_code")
def _(t: Inputs) -> DataFrame:
    symbols = t("symbols")
    days = symbols.select("file_path", (F.col("file_id") % 120).alias("days")).distinct()
    return rk.dead_code(symbols, t("calls"), days, t("mapping").select(F.col("tested_symbol_id").alias("id")), 0.3).select("id", F.round("confidence", 6).alias("confidence"))


@query("c12_observability_risk", "SELECT CASE WHEN count(*) FILTER (WHERE event_type = 'error' AND value > 500) > 0 THEN 'High' WHEN count(*) FILTER (WHERE event_type = 'error') > 3 THEN 'Elevated' ELSE 'None' END AS elevation FROM events")
def _(t: Inputs) -> DataFrame:
    sev = F.when((F.col("event_type") == "error") & (F.col("value") > 500), "Critical").when(F.col("event_type") == "error", "Warning").otherwise("Normal")
    return rk.observability_risk(t.table("events").select(sev.alias("severity")))


@query("c3_symbol_centrality")
def _(t: Inputs) -> DataFrame:
    links = t("links")
    counts = g.entry_counts(links, t.table("nation").where("n_regionkey = 1").select(F.concat(F.lit("n"), "n_nationkey").alias("id")))
    ranks = g.pagerank(links, rounds=5)
    return counts.join(ranks, "id", "full").select("id", F.coalesce("entries", F.lit(0)).alias("entries"), F.round(F.coalesce("rank", F.lit(0.0)), 8).alias("rank"))


@query("c27_topology")
def _(t: Inputs) -> DataFrame:
    return sv.topology(t("repo_files"))


@query("c29_ci_changes", "SELECT path, 'known' AS kind FROM repo_files WHERE path LIKE '.github/workflows/%' AND path LIKE '%.yaml'", "repo_files")
def _(t: Inputs) -> DataFrame:
    return sv.ci_changes(t("repo_files"))


@query("c24_module_summary", ", d AS (SELECT DISTINCT a.file_path AS src, b.file_path AS tgt FROM calls JOIN symbols a ON a.id = caller_symbol_id JOIN symbols b ON b.id = callee_symbol_id WHERE a.file_path <> b.file_path) SELECT regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS module, count(*) AS files, CAST(0 AS BIGINT) AS outgoing FROM files GROUP BY 1", "calls", "symbols", "files")
def _(t: Inputs) -> DataFrame:
    return rep.module_summary(t("files").select(F.col("file_path").alias("path")), j.file_dependencies(t("calls"), t("symbols")))


@query("c24_symbol_index", "SELECT upper(substr(symbol_name, 1, 1)) AS letter, count(*) AS symbols, min(symbol_name) AS first FROM symbols WHERE is_public GROUP BY 1", "symbols")
def _(t: Inputs) -> DataFrame:
    return rep.symbol_index(t("symbols"))


@query("c7_predictions", f", {_SC.lstrip(', ')}, cand AS (SELECT DISTINCT caller_file AS path, 0.7 AS sc FROM sc UNION ALL SELECT DISTINCT f.file_path, 0.5 FROM mapping m JOIN files f ON f.id = m.tested_file_id) SELECT path, max(sc)::DOUBLE AS score FROM cand WHERE path NOT IN (SELECT path FROM changed) GROUP BY 1", "calls", "symbols", "files", "changed_symbols", "mapping", "changed")
def _(t: Inputs) -> DataFrame:
    calls = j.structural_coupling(t("calls"), t("symbols"), t("files"), t("changed_symbols")).select(F.col("caller_file").alias("path"))
    tests = t("mapping").join(t("files").select(F.col("id").alias("tested_file_id"), F.col("file_path").alias("path")), "tested_file_id").select("path")
    return pred.predict({"CallGraph": calls, "TestMapping": tests}, t("changed"))


# Extensions on event time (not in the original, labelled as such)

@query("ext_hourly_windows", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(t: Inputs) -> DataFrame:
    return t.table("events").groupBy(F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("ext_score_trend_lag", ", o AS (SELECT file_path, timestamp, score, lag(score) OVER (PARTITION BY file_path ORDER BY timestamp) AS before FROM history) SELECT file_path, strftime(timestamp, '%Y-%m-%d') AS day, round(score - before, 6) AS delta FROM o WHERE before IS NOT NULL", "history")
def _(t: Inputs) -> DataFrame:
    w = Window.partitionBy("file_path").orderBy("timestamp")
    return t("history").withColumn("before", F.lag("score").over(w)).where("before is not null").select("file_path", F.date_format("timestamp", "yyyy-MM-dd").alias("day"), F.round(F.col("score") - F.col("before"), 6).alias("delta"))
