"""Registered queries of single operators that the composite queries only use inside."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import scalars as s
from .functions import text as x
from .functions import vectors as v
from .operators import graph as g
from .operators import joins as j
from .operators import predicates as p
from .operators import search as q
from .operators import sets as u
from .plans import history as h
from .plans import prediction as pred
from .plans import services as sv
from .queries import NOW, Inputs, _index, now, query
from .session import shared_folder
from .streaming import watch as w


@query("p4_overrides", "SELECT path, CASE WHEN path LIKE 'src/tests/%' THEN 'block' WHEN path LIKE '%.rs' THEN 'review' ELSE 'analyze' END AS mode, CASE WHEN path LIKE '%.rs' AND path LIKE 'src/tests/%' THEN 'lint,test' WHEN path LIKE '%.rs' THEN 'lint' WHEN path LIKE 'src/tests/%' THEN 'test' ELSE '' END AS checks FROM repo_files", "repo_files")
def _(t: Inputs) -> DataFrame:
    rules = t.spark.createDataFrame([(0, "**/*.rs", "review", ["lint"]), (1, "src/tests/**", "block", ["test"])], "idx int, pattern string, mode string, required_verifications array<string>")
    return p.resolve_overrides(t("repo_files"), rules).select("path", "mode", F.array_join("required_verifications", ",").alias("checks"))


@query("p6_id_prefix", "SELECT tx_id FROM transactions WHERE tx_id LIKE 'tx12%'", "transactions")
def _(t: Inputs) -> DataFrame:
    return t("transactions").where(p.id_prefix(F.col("tx_id"), "tx12")).select("tx_id")


@query("p8_time_range", f"SELECT tx_id FROM entries WHERE committed_at >= {NOW} - INTERVAL 60 DAY", "entries")
def _(t: Inputs) -> DataFrame:
    return t("entries").where(p.since(F.col("committed_at"), now(), 60)).select("tx_id")


@query("p9_optional_predicates", "SELECT id FROM routes WHERE path LIKE '%/f/1%'", "routes")
def _(t: Inputs) -> DataFrame:
    return p.endpoints(t("routes"), None, "/f/1").select("id")


@query("p10_node_predicates", "SELECT id, category FROM nodes WHERE category IN ('service', 'policy') AND regexp_matches(id, '(?i).*N1.*')", "nodes")
def _(t: Inputs) -> DataFrame:
    return t("nodes").where(F.col("category").isin("service", "policy") & F.col("id").rlike("(?i).*N1.*")).select("id", "category")


@query("p13_looks_regex", "SELECT page_id, regexp_matches(url, '[\\^$.*+?()|\\[\\]]') AS regex FROM pages")
def _(t: Inputs) -> DataFrame:
    return t.table("pages").select("page_id", x.looks_regex(F.col("url")).alias("regex"))


@query("l2_only_changed", "SELECT id, file_path FROM files WHERE file_path IN (SELECT path FROM changed)", "files", "changed")
def _(t: Inputs) -> DataFrame:
    return p.only_changed(t("files"), t("changed")).select("id", "file_path")


@query("l6_validators", "SELECT id, category FROM entries WHERE category IN ('BUGFIX', 'ALL')", "entries")
def _(t: Inputs) -> DataFrame:
    return p.validators(t("entries").withColumn("name", F.col("tx_id")), "BUGFIX").select("id", "category")


@query("l8_recent_entries", "SELECT tx_id FROM entries WHERE category = 'ARCHITECTURE' ORDER BY committed_at DESC, tx_id LIMIT 30", "entries")
def _(t: Inputs) -> DataFrame:
    return t("entries").where("category = 'ARCHITECTURE'").orderBy(F.desc("committed_at"), "tx_id").limit(30).select("tx_id")


@query("l20_bridge_chain", "SELECT CAST(conv_id AS VARCHAR) AS file, CAST(turn AS BIGINT) AS seq, ok AS accepted, CAST(coalesce(max(CASE WHEN ok THEN turn % 3 END) OVER (PARTITION BY conv_id ORDER BY turn, d ROWS UNBOUNDED PRECEDING), 0) AS INTEGER) AS privacy_so_far FROM (SELECT conv_id, turn, d, (d = 1 AND dense_rank() OVER (PARTITION BY conv_id ORDER BY turn) - 1 = turn) AS ok FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn) AS d FROM conversations) a) b")
def _(t: Inputs) -> DataFrame:
    c = t.table("conversations").select(F.col("conv_id").cast("string").alias("file"), F.col("turn").alias("seq"), F.concat_ws("-", "conv_id", "turn").alias("hash"), F.when(F.col("turn") > 0, F.concat_ws("-", "conv_id", F.col("turn") - 1)).alias("parent_hash"), (F.col("turn") % 3).cast("int").alias("privacy"))
    return p.chain_accept(c)


@query("j11_shared_commits", ", e AS (SELECT DISTINCT commit_idx, file FROM commit_files WHERE NOT is_merge AND file IS NOT NULL), k AS (SELECT * FROM e WHERE commit_idx IN (SELECT commit_idx FROM e GROUP BY 1 HAVING count(*) <= 50)) SELECT a.file AS file_a, b.file AS file_b, count(*) AS shared FROM k a JOIN k b ON a.commit_idx = b.commit_idx AND a.file < b.file GROUP BY 1, 2", "commit_files")
def _(t: Inputs) -> DataFrame:
    return j.shared_commits(p.eligible_commits(t("commit_files"))).groupBy("file_a", "file_b").agg(F.count(F.lit(1)).alias("shared"))


@query("j14_untested_symbols", "SELECT id FROM symbols WHERE id NOT IN (SELECT tested_symbol_id FROM mapping WHERE test_symbol_id IN (SELECT id FROM symbols WHERE entrypoint_kind = 'TEST'))", "symbols", "mapping")
def _(t: Inputs) -> DataFrame:
    tests = t("symbols").where("entrypoint_kind = 'TEST'").select(F.col("id").alias("test_symbol_id"))
    tested = t("mapping").join(tests, "test_symbol_id", "left_semi").select(F.col("tested_symbol_id").alias("id"))
    return t("symbols").join(tested, "id", "left_anti").select("id")


@query("j22_ci_outcomes_of_similar", ", q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 3), k AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], e) AS c FROM embeddings, q ORDER BY c DESC, vec_id LIMIT 20) SELECT k.vec_id, job_name, count(*) AS runs FROM k JOIN outcomes o ON o.diff_embedding_id % 500 = k.vec_id GROUP BY 1, 2", "outcomes")
def _(t: Inputs) -> DataFrame:
    e = t.table("embeddings")
    hits = v.top_k(e, e.where("vec_id = 3").first()["embedding"], 20, "vec_id", "embedding")
    o = t("outcomes").withColumn("vec_id", F.col("diff_embedding_id") % 500)
    return o.join(hits, "vec_id").groupBy("vec_id", "job_name").agg(F.count(F.lit(1)).alias("runs"))


@query("a1_decayed_frequency", "SELECT file, round(sum(power(2.0, -CAST(commit_idx AS DOUBLE) / 30)), 6) AS frequency FROM (SELECT DISTINCT commit_idx, file FROM commit_files) z WHERE file IS NOT NULL GROUP BY 1", "commit_files")
def _(t: Inputs) -> DataFrame:
    return h.frequencies(t("commit_files"), 30).select("file", F.round("frequency", 6).alias("frequency"))


@query("a3_complexities", "SELECT file_path AS file, max(greatest(coalesce(cognitive_complexity, 0), coalesce(cyclomatic_complexity, 0))) AS complexity FROM symbols GROUP BY 1", "symbols")
def _(t: Inputs) -> DataFrame:
    return h.complexities(t("symbols"))


@query("a4_file_centrality", "SELECT file_path, max(id) AS reachable, max(cyclomatic_complexity) AS rank FROM symbols GROUP BY 1", "symbols")
def _(t: Inputs) -> DataFrame:
    return t("symbols").groupBy("file_path").agg(F.max("id").alias("reachable"), F.max("cyclomatic_complexity").alias("rank"))


@query("a6_history_gate", "SELECT count(DISTINCT diff_embedding_id) AS diffs, count(*) FILTER (WHERE outcome = 'fail') AS failures FROM outcomes", "outcomes")
def _(t: Inputs) -> DataFrame:
    return t("outcomes").agg(F.count_distinct("diff_embedding_id").alias("diffs"), F.count_if(F.col("outcome") == "fail").alias("failures"))


@query("a13_graph_size", "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges", "nodes", "edges")
def _(t: Inputs) -> DataFrame:
    return t("nodes").agg(F.count(F.lit(1)).alias("nodes")).crossJoin(t("edges").agg(F.count(F.lit(1)).alias("edges")))


@query("a14_targets_per_service", "SELECT n.id, count(DISTINCT e.target) AS targets FROM nodes n LEFT JOIN edges e ON e.source = n.id AND e.relation = 'calls' WHERE n.category = 'service' GROUP BY 1", "nodes", "edges")
def _(t: Inputs) -> DataFrame:
    hit = j.pattern_join(t("nodes"), t("edges"), "service", "calls").groupBy(F.col("source").alias("id")).agg(F.count("target").alias("targets"))
    return t("nodes").where("category = 'service'").select("id").join(hit, "id", "left").select("id", F.coalesce("targets", F.lit(0)).alias("targets"))


@query("a16_category_counts", "SELECT category, count(*) AS n FROM nodes GROUP BY 1", "nodes")
def _(t: Inputs) -> DataFrame:
    return t("nodes").groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("a20_last_indexed", "SELECT max(o_orderkey) AS last, count(*) FILTER (WHERE date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-01') > 365) AS stale FROM orders")
def _(t: Inputs) -> DataFrame:
    age = F.datediff(F.lit("1998-08-01").cast("date"), F.col("o_orderdate").cast("date"))
    return t.table("orders").agg(F.max("o_orderkey").alias("last"), F.count_if(age > 365).alias("stale"))


@query("t3_vector_search", "SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)), 5) AS distance FROM embeddings WHERE vec_id <> 7 ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)) DESC, vec_id LIMIT 25")
def _(t: Inputs) -> DataFrame:
    e = t.table("embeddings")
    found = v.top_k(e.where("vec_id <> 7"), e.where("vec_id = 7").first()["embedding"], 25, "vec_id", "embedding")
    return found.select("vec_id", F.round(1 - F.col("similarity"), 5).alias("distance"))


@query("t7_top_files", "SELECT file_path, count(*) AS symbols FROM symbols WHERE is_public GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", "symbols")
def _(t: Inputs) -> DataFrame:
    return t("symbols").where("is_public").groupBy("file_path").agg(F.count(F.lit(1)).alias("symbols")).orderBy(F.desc("symbols"), "file_path").limit(10)


@query("u1_id_union", "SELECT source AS id FROM links UNION SELECT target FROM links WHERE relation = 'calls'", "links")
def _(t: Inputs) -> DataFrame:
    return t("links").select(F.col("source").alias("id")).union(t("links").where("relation = 'calls'").select("target")).distinct()


@query("g4_breadth_first", ", r(id) AS (SELECT 'n4' UNION SELECT l.target FROM r JOIN links l ON l.source = r.id WHERE l.relation = 'calls') SELECT id FROM r", "links")
def _(t: Inputs) -> DataFrame:
    return g.reachable(t("links").where("relation = 'calls'"), t.spark.createDataFrame([("n4",)], "id string"), with_seeds=True)


@query("x3_trigram_candidates", "SELECT doc_id AS doc FROM documents WHERE contains(lower(text), 'lic') AND contains(lower(text), 'ice') AND contains(lower(text), 'cen')")
def _(t: Inputs) -> DataFrame:
    return _index(t).candidates(["lic", "ice", "cen"])


@query("x5_code_tokens", "SELECT p_partkey AS id, array_to_string(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda w: w <> ''), ' ') AS tokens FROM part")
def _(t: Inputs) -> DataFrame:
    return t.table("part").select(F.col("p_partkey").alias("id"), F.array_join(x.code_tokens(F.col("p_name")), " ").alias("tokens"))


@query("x10_cosine", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(t: Inputs) -> DataFrame:
    e = t.table("embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(v.cosine(F.col("embedding"), F.col("other")), 5).alias("similarity"))


@query("x13_chosen_chunks")
def _(t: Inputs) -> DataFrame:
    rows = t.table("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), x.keyword_share(F.array(F.lit("the"), F.lit("license"), F.lit("apache")), F.col("text")).alias("similarity"))
    return q.choose_chunks(rows, 8).select("id", F.round("similarity", 6).alias("similarity"))


@query("f1_display_scores", "SELECT path, round(ln(1 + 1000 * score), 5) AS display FROM score_a", "score_a")
def _(t: Inputs) -> DataFrame:
    return t("score_a").select("path", F.round(s.display_score(F.col("score")), 5).alias("display"))


@query("f3_laplace", "SELECT o_custkey AS id, round((count(*) FILTER (WHERE o_orderstatus = 'F') + 1.0) / (count(*) + 2.0), 6) AS probability FROM orders GROUP BY 1")
def _(t: Inputs) -> DataFrame:
    c = t.table("orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count(F.lit(1)).alias("n"))
    return c.select("id", F.round(s.laplace(F.col("f"), F.col("n")), 6).alias("probability"))


@query("f6_inactivity", "SELECT o_orderkey AS id, round(least(ceil(greatest(epoch(TIMESTAMP '1998-08-01 00:00:00') - epoch(o_orderdate), 0) / 86400.0) / 90.0, 1.0), 6)::DOUBLE AS inactivity FROM orders")
def _(t: Inputs) -> DataFrame:
    return t.table("orders").select(F.col("o_orderkey").alias("id"), F.round(s.inactivity(s.age_days(now(), F.col("o_orderdate"))), 6).alias("inactivity"))


@query("f9_test_functions", "SELECT id, (file_path LIKE '%s1%' AND symbol_name LIKE 'sym1%') AS is_test FROM symbols", "symbols")
def _(t: Inputs) -> DataFrame:
    name = F.when(F.col("file_path").contains("s1") & F.col("symbol_name").startswith("sym1"), F.concat(F.lit("test_"), "symbol_name")).otherwise(F.col("symbol_name"))
    return t("symbols").select("id", s.is_test_function(name, F.col("file_path"), F.lit("Rust")).alias("is_test"))


@query("f11_content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def _(t: Inputs) -> DataFrame:
    return t.table("documents").select("doc_id", s.content_hash(F.col("text")).alias("hash"))


@query("f13_json_arrays", "SELECT event_id, CASE WHEN event_type = 'error' THEN 0 WHEN value > 100 THEN 3 ELSE 2 END AS n FROM events")
def _(t: Inputs) -> DataFrame:
    last = F.when(F.col("value") > 100, ',"c"]').otherwise("]")
    text = F.when(F.col("event_type") != "error", F.concat(F.lit('["'), F.col("event_type"), F.lit('","b"'), last)).otherwise("[not json")
    return t.table("events").select("event_id", F.size(s.json_strings(text)).alias("n"))


@query("c6_risk_and_reach", ", pr AS (SELECT n.id, greatest(n.risk_score, coalesce(max(m.risk_score) * 0.5, 0)) AS risk FROM nodes n LEFT JOIN edges e ON e.target = n.id LEFT JOIN nodes m ON m.id = e.source GROUP BY n.id, n.risk_score), re AS (SELECT DISTINCT e.target FROM edges e WHERE e.source IN (SELECT id FROM seeds)) SELECT id, risk FROM pr WHERE id IN (SELECT target FROM re)", "nodes", "edges", "seeds")
def _(t: Inputs) -> DataFrame:
    risky = g.propagate_risk(t("nodes"), t("edges"))
    near = g.min_hops(t("edges"), t("seeds"), 1).select(F.col("target").alias("id"))
    return risky.join(near, "id", "left_semi").select("id", F.col("risk_score").alias("risk"))


@query("c9_ci_scores", ", k AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 3)) AS c FROM embeddings ORDER BY c DESC, vec_id LIMIT 30) SELECT job_name, round(avg(c), 5) AS score FROM outcomes o JOIN k ON k.vec_id = o.diff_embedding_id % 500 WHERE outcome = 'fail' GROUP BY 1", "outcomes")
def _(t: Inputs) -> DataFrame:
    e = t.table("embeddings")
    hits = v.top_k(e, e.where("vec_id = 3").first()["embedding"], 30, "vec_id", "embedding").select(F.col("vec_id").alias("diff_embedding_id"), "similarity")
    o = t("outcomes").withColumn("diff_embedding_id", F.col("diff_embedding_id") % 500)
    return pred.ci_failure_scores(hits, o).select("job_name", F.round("score", 5).alias("score"))


@query("c13_search_regex", ", l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), e AS (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM l) SELECT doc_id AS doc, i AS line FROM e WHERE strlen(l) <= 1000 AND regexp_matches(l, '[Vv]ersion [0-9]+(\\.[0-9]+)*')", "seeds")
def _(t: Inputs) -> DataFrame:
    return _index(t).regex(r"[Vv]ersion [0-9]+(\.[0-9]+)*").select("doc", F.col("line").cast("long").alias("line"))


@query("c18_environment_delta", ", b AS (SELECT DISTINCT event_type AS v FROM events WHERE ts < TIMESTAMP '2024-01-02 00:00:00' AND value > 150), a AS (SELECT DISTINCT event_type AS v FROM events WHERE value > 400) SELECT v, 'left_only' AS side FROM b WHERE v NOT IN (SELECT v FROM a) UNION ALL SELECT v, 'right_only' FROM a WHERE v NOT IN (SELECT v FROM b)", "seeds")
def _(t: Inputs) -> DataFrame:
    e = t.table("events").withColumnRenamed("event_type", "v")
    return j.both_differences(e.where((F.col("ts") < F.expr("TIMESTAMP_NTZ '2024-01-02 00:00:00'")) & (F.col("value") > 150)), e.where("value > 400"), "v")


@query("c23_call_confidence", "SELECT caller_symbol_id, round(sum(CASE WHEN callee_symbol_id IS NULL THEN 0.3 ELSE 1.0 END), 4)::DOUBLE AS confidence FROM calls GROUP BY 1", "calls")
def _(t: Inputs) -> DataFrame:
    kinds = F.create_map(*[F.lit(z) for kv in s.CALL_CONFIDENCE.items() for z in kv])
    kind = F.when(F.col("callee_symbol_id").isNull(), "EXTERNAL").otherwise("DIRECT")
    return t("calls").groupBy("caller_symbol_id").agg(F.round(F.sum(F.element_at(kinds, kind)), 4).alias("confidence"))


@query("c26_tests_for_symbol", "SELECT s.symbol_name, count(DISTINCT m.test_symbol_id) AS tests FROM mapping m JOIN symbols s ON s.id = m.tested_symbol_id GROUP BY 1", "mapping", "symbols")
def _(t: Inputs) -> DataFrame:
    names = t("symbols").select(F.col("id").alias("tested_symbol_id"), "symbol_name")
    return t("mapping").join(names, "tested_symbol_id").groupBy("symbol_name").agg(F.count_distinct("test_symbol_id").alias("tests"))


@query("e13_directories", "SELECT dir, count(*) AS files FROM (SELECT path, unnest(list_transform(range(1, len(string_split(path, '/'))), lambda i: array_to_string(list_slice(string_split(path, '/'), 1, i), '/'))) AS dir FROM repo_files) z GROUP BY 1", "repo_files")
def _(t: Inputs) -> DataFrame:
    return sv.directories(t("repo_files")).groupBy("dir").agg(F.count(F.lit(1)).alias("files"))


def _streamed(t: Inputs, transform, mode: str) -> DataFrame:
    """Runs a streaming query over the events until all are read; the last result, written below the shared folder."""
    base = f"{shared_folder(t.spark)}/skarn-stream-{uuid.uuid4().hex}"
    batch = t.table("events")
    # A glob, as a stream reads folders or patterns.
    stream = transform(w.watch(t.spark, f"{t.sf_dir}/event[s].parquet", batch.schema))
    run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(lambda df, epoch: df.write.mode("overwrite").parquet(f"{base}/out")).trigger(availableNow=True).start()
    run.awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{base}/out")


@query("r3_streaming_drift", "SELECT concat('f', user_id) AS entity, count(*) AS drift_count FROM events WHERE user_id >= 10 GROUP BY 1")
def _(t: Inputs) -> DataFrame:
    pending = t.spark.range(10).select(F.concat(F.lit("f"), "id").alias("entity"))
    return _streamed(t, lambda e: w.drift(e.select("ts", F.concat(F.lit("f"), "user_id").alias("path")), pending), "complete").select("entity", "drift_count")


@query("r1_streaming_batch", "SELECT concat('src/f', user_id, '.rs') AS path, arg_max(CASE WHEN event_type = 'error' THEN 'Unknown' ELSE event_type END, CASE WHEN event_type <> 'error' THEN event_id + 1000000000000 ELSE event_id END) AS kind FROM events GROUP BY 1")
def _(t: Inputs) -> DataFrame:
    def last(e: DataFrame) -> DataFrame:
        kind = F.when(F.col("event_type") == "error", "Unknown").otherwise(F.col("event_type"))
        return p.latest_events(e.select(F.concat(F.lit("src/f"), "user_id", F.lit(".rs")).alias("path"), kind.alias("kind"), F.col("event_id").alias("seq")), ["rs"])

    return _streamed(t, last, "complete")


@query("u10_cascade", "SELECT caller_symbol_id, callee_symbol_id FROM calls WHERE caller_symbol_id NOT IN (SELECT id FROM symbols WHERE file_path IN (SELECT path FROM changed))", "calls", "symbols", "changed")
def _(t: Inputs) -> DataFrame:
    gone = p.only_changed(t("symbols"), t("changed")).select(F.col("id").alias("file_id"))
    return u.delete_files({"calls": (t("calls"), "caller_symbol_id")}, gone)["calls"].select("caller_symbol_id", "callee_symbol_id")
