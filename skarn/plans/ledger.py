"""Ledger analytics: status, audit, velocity, churn, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.sets import first_wins


def status(transactions: DataFrame, now: Column, stale_hours: int = 24) -> DataFrame:
    """One row: pending, unaudited, drift (sum of counts), stale (pending for longer than the threshold)."""
    pending = F.col("status") == "PENDING"
    return transactions.agg(F.count_if(pending).alias("pending"), F.count_if(F.col("status") == "UNAUDITED").alias("unaudited"), F.coalesce(F.sum(F.when(F.col("status") == "UNAUDITED", F.col("drift_count"))), F.lit(0)).alias("drift"), F.count_if(pending & (F.col("started_at") < now - F.make_dt_interval(F.lit(0), F.lit(stale_hours)))).alias("stale"))


def velocity(entries: DataFrame, now: Column) -> DataFrame:
    """One row: entries of the last 7 and 30 days and of all time, in one pass."""
    since = lambda d: F.count_if(F.col("committed_at") >= now - F.make_dt_interval(F.lit(d)))
    return entries.agg(since(7).alias("week"), since(30).alias("month"), F.count(F.lit(1)).alias("total"))


def churn(entries: DataFrame, limit: int = 10) -> DataFrame:
    """(entity, entries): the most often changed entities, ties by name."""
    return entries.groupBy("entity").agg(F.count(F.lit(1)).alias("entries")).orderBy(F.desc("entries"), "entity").limit(limit)


def of_entity(entries: DataFrame, entity: str, by_file: DataFrame | None = None, offset: int = 0, limit: int = 20) -> DataFrame:
    """Entries of an entity, then those of its file, once a transaction, newest first, paged."""
    own = entries.where(F.col("entity") == entity)
    rows = first_wins([own] + ([by_file.select(*entries.columns)] if by_file is not None else []), ["tx_id"]).select(*entries.columns)
    return rows.orderBy(F.desc("committed_at"), "tx_id").offset(offset).limit(limit)


def decisions(entries: DataFrame, metadata: DataFrame) -> DataFrame:
    """Architecture entries with their decision status, ``proposed`` by default."""
    return entries.where(F.col("category") == "ARCHITECTURE").join(metadata.select("tx_id", F.col("status").alias("_s")), "tx_id", "left").withColumn("adr_status", F.coalesce("_s", F.lit("proposed"))).drop("_s")


def federated(entries: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Local entries of the last days, for export to siblings."""
    return entries.where((F.col("origin") == "LOCAL") & (F.col("committed_at") >= now - F.make_dt_interval(F.lit(days))))


def by_origin(entries: DataFrame) -> DataFrame:
    return entries.groupBy("origin").agg(F.count(F.lit(1)).alias("entries"))
