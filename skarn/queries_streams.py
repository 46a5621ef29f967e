"""Registered queries of the streaming graph store and the event-time debounce, over the events.

An event is a change of the file of its user: ``error`` removes the file, any other leaves it with symbols that call another file's. Four micro-batches, a week or so each, become four epochs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .queries import Inputs, query
from .session import shared_folder
from .streaming import graph_store as gs
from .streaming import watch as w

_PART = "least((extract(DAY FROM ts) - 1) // 8, 3)"
# The last event of each file in each batch, its nodes and its edges.
_VERSIONS = f"""v AS (SELECT user_id AS u, CAST({_PART} AS BIGINT) AS epoch, max(event_id) AS e FROM events GROUP BY 1, 2),
x AS (SELECT v.*, concat('src/f', u, '.rs') AS path, event_type <> 'error' AS there, value / 1000 AS risk, lead(epoch) OVER (PARTITION BY u ORDER BY epoch) AS until FROM v JOIN events ON event_id = e),
n AS (SELECT u, epoch, until, path AS id, 'file' AS category, risk FROM x WHERE there UNION ALL SELECT u, epoch, until, concat(path, '::s', i), 'symbol', CAST((e + i) % 10 AS DOUBLE) / 10 FROM x, (SELECT unnest(range(3)) AS i) r WHERE there AND i < e % 4),
d AS (SELECT u, epoch, until, path AS source, concat(path, '::s', i) AS target, 'contains' AS relation FROM x, (SELECT unnest(range(3)) AS i) r WHERE there AND i < e % 4
      UNION ALL SELECT u, epoch, until, concat(path, '::s', i), concat('src/f', (u * 7 + i + e) % 150, '.rs::s0'), 'calls' FROM x, (SELECT unnest(range(3)) AS i) r WHERE there AND i < e % 4)"""
_FILE = "concat('src/f', user_id, '.rs')"


def _indexed(last: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of files from their last events."""
    file = last.select(F.col("path").alias("file"), "seq", "user", "value")
    symbol = file.select("*", F.explode(F.filter(F.array(*map(F.lit, range(3))), lambda i: i < F.col("seq") % 4)).alias("i")).withColumn("id", F.concat("file", F.lit("::s"), "i"))
    nodes = file.select("file", F.col("file").alias("id"), F.col("file").alias("label"), F.lit("file").alias("category"), (F.col("value") / 1000).alias("risk_score"))
    symbols = symbol.select("file", "id", F.col("id").alias("label"), F.lit("symbol").alias("category"), (((F.col("seq") + F.col("i")) % 10).cast("double") / 10).alias("risk_score"))
    contains = symbol.select(F.col("file").alias("source"), F.col("id").alias("target"), F.lit("contains").alias("relation"))
    calls = symbol.select(F.col("id").alias("source"), F.concat(F.lit("src/f"), (F.col("user") * 7 + F.col("i") + F.col("seq")) % 150, F.lit(".rs::s0")).alias("target"), F.lit("calls").alias("relation"))
    return nodes.unionByName(symbols), contains.unionByName(calls)


def _stored(t: Inputs) -> gs.GraphStore:
    """A store that a stream over the events has kept in step, in four epochs."""
    base = f"{shared_folder(t.spark)}/skarn-graph-{uuid.uuid4().hex}"
    kind = F.when(F.col("event_type") == "error", "Remove").otherwise("Modify")
    events = t.table("events").select("ts", F.expr(_FILE).alias("path"), kind.alias("kind"), F.col("event_id").alias("seq"), F.col("user_id").alias("user"), "value")
    store = gs.GraphStore.create(t.spark, f"{base}/graph", buckets=8)
    handle = gs.keep_in_step(store, _indexed, compact_every=3)
    for part in range(4):  # arrivals, one after another, each of any number of files
        events.where(F.least(F.floor((F.dayofmonth("ts") - 1) / 8), F.lit(3)) == part).write.mode("append").parquet(f"{base}/in")
        w.watch(t.spark, f"{base}/in", events.schema, files_per_batch=1 << 30).writeStream.option("checkpointLocation", f"{base}/state").foreachBatch(handle).trigger(availableNow=True).start().awaitTermination()
    return store


@query("r4_synced_graph", f"WITH {_VERSIONS} SELECT id AS source, category AS relation, CAST(NULL AS VARCHAR) AS target, round(risk, 6) AS risk_score FROM n WHERE until IS NULL UNION ALL SELECT source, relation, target, NULL FROM d WHERE until IS NULL")
def _(t: Inputs) -> DataFrame:
    nodes, edges = _stored(t).snapshot()
    rows = nodes.select(F.col("id").alias("source"), F.col("category").alias("relation"), F.lit(None).cast("string").alias("target"), F.round("risk_score", 6).alias("risk_score"))
    return rows.unionByName(edges.withColumn("risk_score", F.lit(None).cast("double")))


_R6 = f"""WITH {_VERSIONS},
was AS (SELECT id, category, risk, until AS epoch FROM n WHERE until IS NOT NULL), dwas AS (SELECT source, target, relation, until AS epoch FROM d WHERE until IS NOT NULL)
SELECT epoch, CASE WHEN w.id IS NULL THEN 'node_added' WHEN n.id IS NULL THEN 'node_removed' ELSE 'node_updated' END AS kind, id, round(n.risk, 6) AS risk_score, CAST(NULL AS VARCHAR) AS source, CAST(NULL AS VARCHAR) AS target, CAST(NULL AS VARCHAR) AS relation
FROM n FULL JOIN was w USING (id, epoch) WHERE w.id IS NULL OR n.id IS NULL OR w.risk <> n.risk OR w.category <> n.category
UNION ALL SELECT epoch, CASE WHEN w.source IS NULL THEN 'edge_added' ELSE 'edge_removed' END, NULL, NULL, source, target, relation FROM d FULL JOIN dwas w USING (source, target, relation, epoch) WHERE w.source IS NULL OR d.source IS NULL"""


@query("r6_graph_deltas", _R6)
def _(t: Inputs) -> DataFrame:
    store = _stored(t)
    epochs = store.epochs()
    parts = [store.deltas(a, b).withColumn("epoch", F.lit(b).cast("long")) for a, b in zip(epochs, epochs[1:], strict=False)]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.select("epoch", "kind", "id", F.round("risk_score", 6).alias("risk_score"), "source", "target", "relation")


_R1 = """WITH e AS (SELECT concat('src/f', user_id, '.rs') AS path, ts, event_id AS seq, CASE WHEN event_type = 'error' THEN 'Unknown' ELSE event_type END AS kind FROM events),
b AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY path ORDER BY ts, seq) + INTERVAL 3 HOUR THEN 0 ELSE 1 END AS fresh FROM e),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS s FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY path, s ORDER BY kind <> 'Unknown' DESC, ts DESC, seq DESC) AS i FROM s)
SELECT path, min(ts) AS start, max(ts) + INTERVAL 3 HOUR AS "end", max(CASE WHEN i = 1 THEN kind END) AS kind, count(*) AS events FROM r GROUP BY path, s"""


@query("r1_quiet_sessions", _R1)
def _(t: Inputs) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "Unknown").otherwise(F.col("event_type"))
    events = t.table("events").select("ts", F.expr(_FILE).alias("path"), kind.alias("kind"), F.col("event_id").alias("seq"))
    return w.quiet_sessions(events, "3 hours", extensions=["rs"])
