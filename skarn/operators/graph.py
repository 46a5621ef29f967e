"""Graph operators over ``nodes(id, ...)`` and ``edges(source, target, relation)``.

Loops keep a frontier, cut lineage by checkpoints in the shared folder, and stop when the frontier is empty or the depth is reached.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder

#: Rows of links for each part of the tables of a level of communities, where Spark's shuffles give more parts than that.
PART_ROWS = 1 << 16


def _cut(df: DataFrame) -> DataFrame:
    """Cuts lineage by a checkpoint in the shared folder; kept until it is written, as Spark would compute it twice."""
    shared_folder(df.sparkSession)
    kept = df.persist()
    try:
        return kept.checkpoint()
    finally:
        kept.unpersist()


def reach_hops(edges: DataFrame, seeds: DataFrame, depth: int = 5) -> DataFrame:
    """All (target, relation, hops) with hops up to ``depth`` from any seed ``(id)``: set semantics for each triple, no visited check."""
    steps = edges.select("source", "target", "relation").distinct()
    level = steps.join(seeds.select(F.col("id").alias("source")).distinct(), "source", "left_semi").select("target", "relation").distinct().withColumn("hops", F.lit(1))
    out = level
    for hop in range(2, depth + 1):
        heads = level.select(F.col("target").alias("source")).distinct()
        level = steps.join(heads, "source", "left_semi").select("target", "relation").distinct().withColumn("hops", F.lit(hop))
        if hop % 4 == 0:
            level = _cut(level)
        out = out.unionByName(level)
    return out


def related(edges: DataFrame, seeds: DataFrame, depth: int, relations: list[str] | None = None) -> DataFrame:
    """Entities within ``depth`` hops; a relation filter holds for the last hop only."""
    found = reach_hops(edges, seeds, depth)
    return found.where(F.col("relation").isin(relations)) if relations else found


def min_hops(edges: DataFrame, seeds: DataFrame, depth: int = 5) -> DataFrame:
    """(target, hops): the fewest hops from any seed; seeds count only if they are entered again."""
    return reach_hops(edges, seeds, depth).groupBy("target").agg(F.min("hops").alias("hops"))


def reachable(edges: DataFrame, seeds: DataFrame, with_seeds: bool = False) -> DataFrame:
    """Nodes reached from the seeds, to the fixpoint. Without ``with_seeds`` a seed is reached only if it is entered again."""
    steps = _cut(edges.select("source", "target").distinct())
    start = seeds.select("id").distinct()
    seen = frontier = _cut(start if with_seeds else steps.join(start.withColumnRenamed("id", "source"), "source", "left_semi").select(F.col("target").alias("id")).distinct())
    while not frontier.isEmpty():
        ahead = steps.join(frontier.withColumnRenamed("id", "source"), "source", "left_semi").select(F.col("target").alias("id")).distinct()
        frontier = _cut(ahead.join(seen, "id", "left_anti"))
        seen = _cut(seen.unionByName(frontier))
    return seen


def entry_counts(edges: DataFrame, entries: DataFrame, depth: int = 20) -> DataFrame:
    """(id, entries): how many entry points reach each node within ``depth`` hops; an entry reaches itself."""
    steps = _cut(edges.select("source", "target").distinct())
    seen = frontier = _cut(entries.select(F.col("id").alias("entry"), "id").distinct())
    for _ in range(depth):
        ahead = frontier.join(steps, frontier.id == steps.source).select("entry", F.col("target").alias("id")).distinct()
        frontier = _cut(ahead.join(seen, ["entry", "id"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = _cut(seen.unionByName(frontier))
    return seen.groupBy("id").agg(F.count(F.lit(1)).alias("entries"))


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """(id, rank), ranks sum to 1; the mass of nodes without successors is spread over all."""
    steps = _cut(edges.select("source", "target").distinct())
    nodes = _cut(steps.select(F.col("source").alias("id")).union(steps.select("target")).distinct())
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    degree = steps.groupBy("source").agg(F.count(F.lit(1)).alias("out"))
    weighted = _cut(steps.join(degree, "source"))
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    for k in range(rounds):
        gained = weighted.join(ranks, weighted.source == ranks.id).groupBy("target").agg(F.sum(F.col("rank") / F.col("out")).alias("gain"))
        kept = ranks.join(degree, ranks.id == degree.source, "left_semi").agg(F.sum("rank")).first()[0] or 0.0
        base = (1.0 - damping) / n + damping * (1.0 - kept) / n
        ranks = nodes.join(gained, nodes.id == gained.target, "left").select("id", (F.lit(base) + damping * F.coalesce("gain", F.lit(0.0))).alias("rank"))
        ranks = _cut(ranks)
    return ranks


def communities(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(id, community): label propagation on the undirected graph; a node takes its neighbours' most frequent label, the smallest on ties."""
    both = edges.select("source", "target").union(edges.select("target", "source")).where("source <> target").distinct()
    both = _cut(both)
    labels = _cut(both.select(F.col("source").alias("id")).distinct().withColumn("community", F.col("id")))
    for _ in range(rounds):
        votes = both.join(labels, both.target == labels.id).groupBy(F.col("source").alias("id"), "community").agg(F.count(F.lit(1)).alias("n"))
        fresh = _cut(votes.groupBy("id").agg(F.min(F.struct(-F.col("n"), F.col("community").alias("community"))).alias("best")).select("id", "best.community"))
        changed = fresh.join(labels, ["id", "community"], "left_anti").limit(1).count()
        labels = fresh
        if not changed:
            break
    return labels


def _undirected(edges: DataFrame) -> DataFrame:
    """``id, other, w``: each undirected edge in both directions, once, of weight 1."""
    once = edges.where("source <> target").select(F.least("source", "target").alias("id"), F.greatest("source", "target").alias("other")).distinct().withColumn("w", F.lit(1.0))
    return once.unionByName(once.select(F.col("other").alias("id"), F.col("id").alias("other"), "w"))


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> float:
    """The modularity of ``labels(id, community)`` on the undirected simple graph of the edges; 0 without edges."""
    ends = _undirected(edges).join(labels.select("id", F.col("community").alias("c")), "id").join(labels.select(F.col("id").alias("other"), F.col("community").alias("d")), "other")
    parts = ends.groupBy("c").agg(F.sum("w").alias("degree"), F.sum(F.when(F.col("c") == F.col("d"), F.col("w")).otherwise(0.0)).alias("inner"))
    row = parts.agg(F.sum("degree").alias("total"), F.sum("inner").alias("inner"), F.sum(F.col("degree") * F.col("degree")).alias("squares")).first()
    return row["inner"] / row["total"] - resolution * row["squares"] / row["total"] ** 2 if row["total"] else 0.0


def modularity_communities(edges: DataFrame, resolution: float = 1.0, rounds: int = 12, levels: int = 10) -> DataFrame:
    """(id, community): communities by modularity, level by level; a community is named by its smallest node.

    On a level, nodes move to the neighbouring community of the largest gain (their own on ties, then the smallest). All nodes are looked at together, but in each round only a
    random half may move, or neighbours would swap places for ever; a level ends when two rounds in a row move none. Then communities become the nodes of a smaller graph, whose
    edges are summed, until a level moves nothing. A hub's edges are summed by partial aggregates, by the communities at their other ends."""
    links = _cut(_undirected(edges))
    total = links.agg(F.sum("w")).first()[0]
    labels = _cut(links.select("id").distinct().withColumn("community", F.col("id")))
    if not total:
        return labels
    for level in range(levels):
        # Tables that stay for many rounds lie in as many parts as their rows need: small graphs would spend all their time on starting tasks.
        parts = links.count() // PART_ROWS + 1
        degree = _cut(links.groupBy("id").agg(F.sum("w").alias("k")).coalesce(parts))
        place = degree.withColumn("community", F.col("id"))
        # What a round needs of a link's own end is on the link, so that only two shuffles of a round are of the links' size besides their join.
        ends = _cut(links.where("id <> other").join(degree, "id").select("id", "k", "other", "w").coalesce(parts))
        quiet, changed = 0, False
        for turn in range(rounds):
            known = place.join(place.groupBy("community").agg(F.sum("k").alias("sum")), "community")
            there = ends.join(known.select(F.col("id").alias("other"), "community", "sum"), "other").select("id", "k", "community", "sum", "w", F.lit(False).alias("own"))
            here = known.select("id", "k", "community", "sum", F.lit(0.0).alias("w"), F.lit(True).alias("own"))
            options = there.unionByName(here).groupBy("id", "community").agg(F.sum("w").alias("inner"), F.max("k").alias("k"), F.max("sum").alias("sum"), F.max("own").alias("own"))
            gain = F.col("inner") - resolution * F.col("k") * (F.col("sum") - F.when(F.col("own"), F.col("k")).otherwise(0.0)) / total
            ranked = F.struct((-F.round(gain, 9)).alias("loss"), (~F.col("own")).alias("away"), F.col("community").alias("to"))
            may = F.pmod(F.xxhash64(F.lit(level), F.lit(turn), "id"), F.lit(2)) == 0
            best = options.groupBy("id").agg(F.min(ranked).alias("best"), F.max("k").alias("k"), F.max(F.when(F.col("own"), F.col("community"))).alias("own"))
            place = _cut(best.select("id", "k", "own", F.when(may, F.col("best.to")).otherwise(F.col("own")).alias("community")).coalesce(parts))
            quiet = quiet + 1 if place.where("community <> own").isEmpty() else 0
            changed |= not quiet
            place = place.drop("own")
            if quiet == 2:
                break
        if not changed:
            break
        moved = place.select(F.col("id").alias("community"), F.col("community").alias("to"))
        labels = _cut(labels.join(moved, "community").select("id", F.col("to").alias("community")))
        source, target = place.select("id", F.col("community").alias("a")), place.select(F.col("id").alias("other"), F.col("community").alias("b"))
        links = _cut(links.join(source, "id").join(target, "other").groupBy(F.col("a").alias("id"), F.col("b").alias("other")).agg(F.sum("w").alias("w")).coalesce(parts))
    names = labels.groupBy("community").agg(F.min("id").alias("name"))
    return labels.join(names, "community").select("id", F.col("name").alias("community"))


def neighbourhood(edges: DataFrame, roots: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, depth) within ``depth`` steps in either direction, and the edges among them."""
    both = edges.select("source", "target").union(edges.select("target", "source")).distinct()
    seen = frontier = roots.select("id").distinct().withColumn("depth", F.lit(0))
    for hop in range(1, depth + 1):
        ahead = both.join(frontier.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("id")).distinct()
        frontier = _cut(ahead.join(seen, "id", "left_anti").withColumn("depth", F.lit(hop)))
        seen = seen.unionByName(frontier)
    ids = seen.select("id")
    induced = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return seen, induced


def propagate_risk(nodes: DataFrame, edges: DataFrame, factor: float = 0.5) -> DataFrame:
    """nodes with risk raised to ``factor`` times the riskiest predecessor's, if that is more."""
    push = edges.join(nodes.select(F.col("id").alias("source"), F.col("risk_score").alias("_r")), "source").groupBy(F.col("target").alias("id")).agg((F.max("_r") * factor).alias("_p"))
    return nodes.join(push, "id", "left").withColumn("risk_score", F.greatest("risk_score", F.coalesce("_p", F.lit(0.0)))).drop("_p")


def chains(edges: DataFrame, starts: DataFrame, depth: int = 5) -> DataFrame:
    """(path array, cyclic): simple call chains from each start, cut at ``depth`` nodes; a chain that would meet itself ends as cyclic.
    Chains of one node are dropped."""
    steps = edges.select("source", "target").distinct()
    open_ = starts.select(F.array("id").alias("path"), F.col("id").alias("tip")).distinct()
    done = None
    for length in range(2, depth + 1):
        grown = open_.join(steps, open_.tip == steps.source, "left")
        ended = grown.where("target is null").select("path", F.lit(False).alias("cyclic"))
        cyclic = grown.where(F.array_contains("path", F.col("target"))).select("path", F.lit(True).alias("cyclic"))
        done = ended.unionByName(cyclic) if done is None else done.unionByName(ended).unionByName(cyclic)
        open_ = grown.where(F.col("target").isNotNull() & ~F.array_contains("path", F.col("target"))).select(F.concat("path", F.array("target")).alias("path"), F.col("target").alias("tip"))
        if length % 3 == 0:
            open_ = _cut(open_)
    return done.unionByName(open_.select("path", F.lit(False).alias("cyclic"))).where(F.size("path") > 1).distinct()


def touching(edges: DataFrame, ids: DataFrame, limit: int = 50) -> DataFrame:
    """Edges with either end among ``ids(id)``, ordered, at most ``limit`` (the feature's cap)."""
    keys = ids.select("id").distinct()
    hit = edges.join(keys.withColumnRenamed("id", "source"), "source", "left_semi").unionByName(edges.join(keys.withColumnRenamed("id", "target"), "target", "left_semi").select(*edges.columns)).distinct()
    return hit.orderBy("source", "target", "relation").limit(limit)


def assemble(phases: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """A graph from phases of (nodes, edges): later phases win on a node's id or an edge's key."""
    nodes = edges = None
    for order, (n, e) in enumerate(phases):
        n, e = n.withColumn("_o", F.lit(order)), e.withColumn("_o", F.lit(order))
        nodes = n if nodes is None else nodes.unionByName(n, allowMissingColumns=True)
        edges = e if edges is None else edges.unionByName(e, allowMissingColumns=True)

    def last(df: DataFrame, keys: list[str]) -> DataFrame:
        rest = [c for c in df.columns if c not in keys and c != "_o"]
        return df.groupBy(*keys).agg(F.max_by(F.struct(*rest) if rest else F.lit(1), "_o").alias("_v")).select(*keys, *[F.col(f"_v.{c}") for c in rest])

    return last(nodes, ["id"]), last(edges, ["source", "target", "relation"])


def prune_orphans(nodes: DataFrame, edges: DataFrame, category: str, relation: str) -> DataFrame:
    """nodes without those of a category that no live edge of the relation enters."""
    live = edges.where(F.col("relation") == relation).join(nodes.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("id")).distinct()
    dead = nodes.where(F.col("category") == category).join(live, "id", "left_anti").select("id")
    return nodes.join(dead, "id", "left_anti")


def sync(nodes: DataFrame, edges: DataFrame, removed: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Incremental update: removed nodes go with their outgoing edges (incoming ones stay), then new rows win over old ones of the same key."""
    gone = removed.select("id").distinct()
    kept_nodes = nodes.join(gone, "id", "left_anti").join(new_nodes.select("id"), "id", "left_anti")
    kept_edges = edges.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(new_edges.select("source", "target", "relation"), ["source", "target", "relation"], "left_anti")
    return kept_nodes.unionByName(new_nodes), kept_edges.select(*edges.columns).unionByName(new_edges.select(*edges.columns))


def advisories(packages: DataFrame, services: DataFrame) -> DataFrame:
    """Edges of an advisory scan ``packages(path, package, advisory)`` and ``services(id, root)``: file -> package, advisory -> package,
    and service -> package where the manifest lies under the service's root."""
    edge = lambda s, t, r: (s.alias("source"), t.alias("target"), F.lit(r).alias("relation"))
    files = packages.select(*edge(F.col("path"), F.col("package"), "depends_on"))
    advised = packages.where("advisory is not null").select(*edge(F.col("advisory"), F.col("package"), "affects"))
    under = packages.join(services, (F.col("root") == "") | F.col("path").startswith(F.concat("root", F.lit("/")))).select(*edge(F.col("id"), F.col("package"), "depends_on"))
    return files.unionByName(advised).unionByName(under).distinct()
