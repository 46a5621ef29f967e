"""A versioned graph that a stream of file changes keeps in step, and its deltas.

A store is a set of append-only logs below one folder. Each epoch (a micro-batch) adds what it put and deleted: nodes as ``(file, id, ...)``, as a file owns the nodes it was
indexed to, and edges as ``(source, target, relation)``, bucketed by owner and by source, so that an epoch reads the buckets of its changes only. A mark makes an
epoch visible; an epoch that is replayed before that overwrites its own logs, and one replayed after it does nothing, so each counts once. The graph at an epoch is
the latest entry of each key since the last base; :meth:`GraphStore.compact` writes a base. Any two visible epochs can be compared.

An epoch does what :func:`skarn.operators.graph.sync` does in batch: the nodes that changed files owned go with their outgoing edges (incoming ones stay), then new rows
are added and win over old ones of the same key.

Defined cases: a node that another file has put since stays deleted if its first owner deletes it later, as ids are global; within an epoch what is put wins over what is deleted; of
one id put by two files in an epoch, the later file name wins; null ids and sources are dropped; a change without new rows deletes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODE, EDGE = ["label", "category", "risk_score"], ["source", "target", "relation"]
_NODES = "file string, id string, label string, category string, risk_score double, put boolean, epoch long, bucket int"
_EDGES = "source string, target string, relation string, put boolean, epoch long, bucket int"
_MARKS = "kind string, epoch long, files_processed long, nodes_added long, nodes_removed long, edges_added long, edges_removed long"
#: Tasks that may write a bucket of a log.
WRITERS = 16
#: The initial graph's epoch; streams count from 0.
FIRST = -1


@dataclass
class GraphStore:
    """nodes(file, id, label, category, risk_score) and edges(source, target, relation) below ``path``."""

    spark: SparkSession
    path: str
    buckets: int = 64

    @classmethod
    def create(cls, spark: SparkSession, path: str, nodes: DataFrame | None = None, edges: DataFrame | None = None, buckets: int = 64) -> GraphStore:
        """A store that begins with the given graph, or empty."""
        store = cls(spark, path.rstrip("/"), buckets)
        nodes = spark.createDataFrame([], "file string, id string, label string, category string, risk_score double") if nodes is None else nodes
        edges = spark.createDataFrame([], "source string, target string, relation string") if edges is None else edges
        store._write(store._node_rows(nodes, True, FIRST), "base-nodes", FIRST)
        store._write(store._edge_rows(edges, True, FIRST), "base-edges", FIRST)
        store._mark("base", FIRST)
        store._mark("commit", FIRST)
        return store

    # Layout

    def _write(self, rows: DataFrame, table: str, epoch: int) -> None:
        # A bucket is written by several tasks where it is large; adaptive execution puts small parts together.
        part = F.pmod(F.xxhash64("id" if "id" in rows.columns else "target"), F.lit(WRITERS))
        rows.repartition("bucket", part).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{table}/log={epoch}")

    def _mark(self, kind: str, epoch: int, *counts: int) -> None:
        row = (kind, epoch, *(counts or (0,) * 5))
        self.spark.createDataFrame([row], _MARKS).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/marks/{kind}-{epoch}")

    def _marks(self) -> DataFrame:
        return self.spark.read.schema(_MARKS).option("recursiveFileLookup", "true").parquet(f"{self.path}/marks")

    def _known(self) -> tuple[list[int], list[int]]:
        """Visible epochs and bases, in order: a number each."""
        found = sorted((r["epoch"], r["kind"]) for r in self._marks().select("epoch", "kind").collect())
        return [e for e, kind in found if kind == "commit"], [e for e, kind in found if kind == "base"]

    def _read(self, table: str, epochs: list[int], schema: str) -> DataFrame:
        if not epochs:
            return self.spark.createDataFrame([], schema)
        read = self.spark.read.schema(f"{schema}, log int").option("basePath", f"{self.path}/{table}")
        return read.parquet(*[f"{self.path}/{table}/log={e}" for e in epochs]).drop("log")

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int").alias("bucket")

    def _node_rows(self, nodes: DataFrame, put: bool, epoch: int) -> DataFrame:
        return nodes.where("id IS NOT NULL").select("file", "id", *NODE, F.lit(put).alias("put"), F.lit(epoch).cast("long").alias("epoch"), self._bucket("file"))

    def _edge_rows(self, edges: DataFrame, put: bool, epoch: int) -> DataFrame:
        return edges.where("source IS NOT NULL").select(*EDGE, F.lit(put).alias("put"), F.lit(epoch).cast("long").alias("epoch"), self._bucket("source"))

    def commits(self) -> DataFrame:
        """What each visible epoch did."""
        return self._marks().where("kind = 'commit'").drop("kind")

    def epochs(self) -> list[int]:
        return self._known()[0]

    def _logs(self, kind: str, until: int, known: tuple[list[int], list[int]] | None = None, buckets: list[int] | None = None) -> DataFrame:
        """All rows that the graph at epoch ``until`` follows from."""
        epochs, bases = known or self._known()
        base, schema = max(b for b in bases if b <= until), _NODES if kind == "nodes" else _EDGES
        rows = self._read(f"base-{kind}", [base], schema).unionByName(self._read(kind, [e for e in epochs if base < e <= until], schema))
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    @staticmethod
    def _latest(rows: DataFrame, keys: list[str]) -> DataFrame:
        """The last row of each key, deletions included."""
        rest = [c for c in rows.columns if c not in keys]
        last = F.max_by(F.struct(*rest), F.struct("epoch", "put", *[c for c in ("file",) if c in rows.columns]))
        return rows.groupBy(*keys).agg(last.alias("_v")).select(*keys, *[F.col(f"_v.{c}") for c in rest])

    def _numbers(self, rows: DataFrame, key: str) -> list[int]:
        return [r["bucket"] for r in rows.select(self._bucket(key)).distinct().collect()]  # at most ``buckets``

    # Versions

    def snapshot(self, epoch: int | None = None) -> tuple[DataFrame, DataFrame]:
        """Nodes ``(file, id, ...)`` and edges at an epoch, by default the last visible one."""
        known = self._known()
        until = known[0][-1] if epoch is None else epoch
        nodes = self._latest(self._logs("nodes", until, known), ["id"]).where("put").select("file", "id", *NODE)
        edges = self._latest(self._logs("edges", until, known), EDGE).where("put").select(*EDGE)
        return nodes, edges

    def apply(self, changed: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, epoch: int) -> bool:
        """Makes ``changed(path)``, with the nodes and edges these files have now, an epoch; False if it was one before."""
        known = self._known()
        if epoch in known[0]:
            return False
        before = max(e for e in known[0] if e < epoch)
        files = changed.select(F.col("path").alias("file")).where("file IS NOT NULL").distinct()
        puts = self._node_rows(new_nodes, True, epoch).dropDuplicates(["file", "id"])
        held = self._logs("nodes", before, known, self._numbers(files, "file")).join(files, "file", "left_semi")
        old = self._latest(held, ["file", "id"]).where("put")
        deleted = old.join(puts.select("file", "id"), ["file", "id"], "left_anti").select("file", "id", *NODE)
        self._write(self._node_rows(deleted, False, epoch).unionByName(puts), "nodes", epoch)

        edge_puts = self._edge_rows(new_edges, True, epoch).dropDuplicates(EDGE)
        gone = old.select(F.col("id").alias("source")).distinct()
        leaving = self._latest(self._logs("edges", before, known, self._numbers(gone, "source")).join(gone, "source", "left_semi"), EDGE).where("put")
        cut = leaving.join(edge_puts.select(*EDGE), EDGE, "left_anti").select(*EDGE)
        self._write(self._edge_rows(cut, False, epoch).unionByName(edge_puts), "edges", epoch)

        written = [self._read(kind, [epoch], schema).select(F.lit(kind).alias("kind"), "put") for kind, schema in (("nodes", _NODES), ("edges", _EDGES))]
        counts = {(r["kind"], r["put"]): r["count"] for r in written[0].unionByName(written[1]).groupBy("kind", "put").count().collect()}
        self._mark("commit", epoch, files.count(), *[counts.get((kind, put), 0) for kind in ("nodes", "edges") for put in (True, False)])
        return True

    def deltas(self, since: int, until: int) -> DataFrame:
        """``kind`` (node_added, node_removed, node_updated, edge_added, edge_removed), ``id, label, category, risk_score`` of nodes, ``source, target, relation`` of edges:
        what changed between two epochs. Only keys that an epoch in between wrote are looked up."""
        known = self._known()
        steps = [e for e in known[0] if since < e <= until]
        state = lambda kind, keys, touched, at: self._latest(self._logs(kind, at, known).join(touched, keys, "left_semi"), keys).where("put")
        node = F.struct(*NODE)
        ids = self._read("nodes", steps, _NODES).select("id").distinct()
        nodes = state("nodes", ["id"], ids, since).select("id", node.alias("was")).join(state("nodes", ["id"], ids, until).select("id", node.alias("now")), "id", "full")
        kind = F.when(F.col("was").isNull(), "node_added").when(F.col("now").isNull(), "node_removed").when(~F.col("was").eqNullSafe(F.col("now")), "node_updated")
        none = F.lit(None).cast("string")
        changed = nodes.select(kind.alias("kind"), "id", *[F.col(f"now.{c}").alias(c) for c in NODE], *[none.alias(c) for c in EDGE]).where("kind IS NOT NULL")
        keys = self._read("edges", steps, _EDGES).select(*EDGE).distinct()
        side = lambda at, name: state("edges", EDGE, keys, at).select(*EDGE, F.lit(True).alias(name))
        edges = side(since, "was").join(side(until, "now"), EDGE, "full").where("was IS NULL OR now IS NULL")
        moved = edges.select(F.when(F.col("was").isNull(), "edge_added").otherwise("edge_removed").alias("kind"), none.alias("id"), none.alias("label"), none.alias("category"), F.lit(None).cast("double").alias("risk_score"), *EDGE)
        return changed.unionByName(moved)

    def compact(self, epoch: int | None = None) -> None:
        """Writes the graph at an epoch as a base, so that later reads begin there. Deletions stay only where another file's entry of the id is older."""
        known = self._known()
        at = known[0][-1] if epoch is None else epoch
        held = self._latest(self._logs("nodes", at, known), ["file", "id"])
        live = held.where("put").select("id").distinct()
        self._write(held.join(live, "id", "left_semi").select("file", "id", *NODE, "put", "epoch", self._bucket("file")), "base-nodes", at)
        self._write(self._latest(self._logs("edges", at, known), EDGE).where("put").select(*EDGE, "put", "epoch", self._bucket("source")), "base-edges", at)
        self._mark("base", at)


def keep_in_step(store: GraphStore, index: Callable[[DataFrame], tuple[DataFrame, DataFrame]], extensions: list[str] | None = None, compact_every: int = 0) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` handler that makes each micro-batch of events ``(path, kind, seq, ...)`` an epoch of the store. ``index`` gets the batch's last event of each path that
    wasn't a removal and gives the nodes and edges these files have now."""

    def handle(batch: DataFrame, epoch: int) -> None:
        if epoch in store.epochs():
            return
        rows = batch.where(F.regexp_extract("path", r"\.([^./]*)$", 1).isin(extensions)) if extensions else batch
        rest, order = [c for c in rows.columns if c != "path"], F.struct((F.col("kind") != "Unknown").alias("known"), F.col("seq"))
        last = rows.groupBy("path").agg(F.max_by(F.struct(*rest), order).alias("_v")).select("path", "_v.*")
        last = last.persist()
        try:
            nodes, edges = index(last.where("kind <> 'Remove'"))
            store.apply(last, nodes, edges, epoch)
        finally:
            last.unpersist()
        if compact_every and epoch % compact_every == compact_every - 1:
            store.compact(epoch)

    return handle


def publish(store: GraphStore, sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A handler for behind :func:`keep_in_step`: the epoch's delta goes to ``sink``, or a row of kind ``heartbeat`` where there is none. A replay publishes the same delta again under the same epoch."""

    def handle(_: DataFrame, epoch: int) -> None:
        before = max(e for e in store.epochs() if e < epoch)
        delta = store.deltas(before, epoch).persist()
        try:
            beat = delta.sparkSession.range(1).select(F.lit("heartbeat").alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in delta.dtypes[1:]])
            sink(beat if delta.isEmpty() else delta, epoch)
        finally:
            delta.unpersist()

    return handle
