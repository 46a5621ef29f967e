"""Differences, merges and change detection between two states of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def diff(before: DataFrame, after: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """keys and ``change``: ADDED, DELETED or MODIFIED (the value differs), by one full join."""
    b, a = before.select(*keys, value.alias("_b"), F.lit(True).alias("_was")), after.select(*keys, value.alias("_a"), F.lit(True).alias("_is"))
    joined = b.join(a, keys, "full")
    change = F.when(F.col("_was").isNull(), "ADDED").when(F.col("_is").isNull(), "DELETED").when(~F.col("_b").eqNullSafe(F.col("_a")), "MODIFIED")
    return joined.select(*keys, change.alias("change")).where("change is not null")


def graph_diff(nodes_before: DataFrame, nodes_after: DataFrame, edges_before: DataFrame, edges_after: DataFrame) -> tuple[DataFrame, DataFrame]:
    rest = [c for c in nodes_before.columns if c != "id"]
    nodes = diff(nodes_before, nodes_after, ["id"], F.struct(*rest))
    edges = diff(edges_before, edges_after, ["source", "target", "relation"], F.lit(0))
    return nodes, edges


def detect_changes(stored: DataFrame, current: DataFrame, key: str = "file_path", text: str = "content") -> DataFrame:
    """(key, state): new, changed, same or orphan, by content hash."""
    s, c = stored.select(key, F.col("content_hash").alias("_s")), current.select(key, F.sha2(F.encode(text, "UTF-8"), 256).alias("_c"))
    state = F.when(F.col("_s").isNull(), "new").when(F.col("_c").isNull(), "orphan").when(F.col("_s") == F.col("_c"), "same").otherwise("changed")
    return s.join(c, key, "full").select(key, state.alias("state"))


def first_wins(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """A union in which the earliest part's row of a key stays."""
    rest = [c for c in parts[0].columns if c not in keys]
    every = None
    for order, part in enumerate(parts):
        part = part.select(*parts[0].columns).withColumn("_o", F.lit(order))
        every = part if every is None else every.unionByName(part)
    return every.groupBy(*keys).agg(F.min_by(F.struct(*rest) if rest else F.lit(0), "_o").alias("_v")).select(*keys, *[F.col(f"_v.{c}") for c in rest])


def blend_scores(rule: DataFrame, semantic: DataFrame, weight: float = 0.3) -> DataFrame:
    """(path, score): (1 - w) rule + w semantic over either side's paths; without weight or semantic rows the rule alone."""
    if weight == 0 or semantic.isEmpty():
        return rule.select("path", "score")
    joined = rule.select("path", F.col("score").alias("_r")).join(semantic.select("path", F.col("score").alias("_s")), "path", "full")
    return joined.select("path", (F.coalesce("_r", F.lit(0.0)) * (1 - weight) + F.coalesce("_s", F.lit(0.0)) * weight).alias("score"))


def drift_counts(events: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """(entity, drift_count, first_seen, last_seen) of ``events(entity, ts)``, added to an earlier state."""
    fresh = events.groupBy("entity").agg(F.count(F.lit(1)).alias("drift_count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    if state is None:
        return fresh
    return state.unionByName(fresh).groupBy("entity").agg(F.sum("drift_count").alias("drift_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def delete_files(tables: dict[str, tuple[DataFrame, str]], files: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the deleted files ``files(file_id)``; a table names its column."""
    return {name: rows.join(files.select(F.col("file_id").alias(column)), column, "left_anti") for name, (rows, column) in tables.items()}
