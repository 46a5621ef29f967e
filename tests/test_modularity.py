"""Modularity communities: planted partitions are found, and no labelling by propagation is better."""

from __future__ import annotations

import random

from skarn.operators.graph import communities, modularity, modularity_communities


def graph(spark, edges):
    return spark.createDataFrame([(a, b, "calls") for a, b in edges], "source string, target string, relation string")


def plain(edges, labels):
    pairs = {frozenset(e) for e in edges if e[0] != e[1]}
    degree = {}
    for p in pairs:
        for n in p:
            degree[n] = degree.get(n, 0) + 1
    m, inner = len(pairs), sum(len({labels[n] for n in p}) == 1 for p in pairs)
    sums = {}
    for n, k in degree.items():
        sums[labels[n]] = sums.get(labels[n], 0) + k
    return inner / m - sum(s * s for s in sums.values()) / (4 * m * m)


def test_planted_groups_are_found_and_modularity_is_right(spark):
    rng = random.Random(2)
    member = {f"n{i:03d}": i % 5 for i in range(100)}
    nodes = list(member)
    edges = [(a, b) for a in nodes for b in nodes if a < b and rng.random() < (0.4 if member[a] == member[b] else 0.01)]
    edges += [(b, a) for a, b in edges[:20]] + [(nodes[0], nodes[0])]  # both directions and a loop count once and not at all
    table = graph(spark, edges)
    found = {r["id"]: r["community"] for r in modularity_communities(table).collect()}
    assert found == {n: min(x for x in nodes if member[x] == member[n]) for n in nodes}
    labels = spark.createDataFrame(list(found.items()), "id string, community string")
    assert abs(modularity(table, labels) - plain(edges, found)) < 1e-9
    assert modularity(table, labels) >= modularity(table, communities(table)) - 1e-9


def test_a_ring_of_cliques_and_empty_graphs(spark):
    edges = [(f"c{c}{i}", f"c{c}{j}") for c in range(6) for i in range(5) for j in range(i)] + [(f"c{c}0", f"c{(c + 1) % 6}4") for c in range(6)]
    found = {r["id"]: r["community"] for r in modularity_communities(graph(spark, edges)).collect()}
    assert found == {f"c{c}{i}": f"c{c}0" for c in range(6) for i in range(5)}
    assert modularity_communities(graph(spark, [])).collect() == [] and modularity(graph(spark, []), spark.createDataFrame([], "id string, community string")) == 0.0


def test_a_small_graph_starts_few_tasks(spark):
    edges = graph(spark, [(f"c{c}{i}", f"c{c}{j}") for c in range(6) for i in range(5) for j in range(i)] + [(f"c{c}0", f"c{(c + 1) % 6}4") for c in range(6)])
    context, parts = spark.sparkContext, spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    context.setJobGroup("few tasks", "communities of 30 nodes")
    try:
        modularity_communities(edges, rounds=4, levels=2)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        context.setLocalProperty("spark.jobGroup.id", None)
    jobs = [context.statusTracker().getJobInfo(i) for i in context.statusTracker().getJobIdsForGroup("few tasks")]
    stages = {i: context.statusTracker().getStageInfo(i) for j in jobs for i in j.stageIds}
    assert sum(s.numCompletedTasks for s in stages.values() if s) < 1200
