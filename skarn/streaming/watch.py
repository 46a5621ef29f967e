"""Structured Streaming: watch batches, event-time debounce, drift state, coupling alerts; the graph's sync and deltas are in ``graph_store``.

File events are a stream ``(ts, path, kind, seq)``. Batches are micro-batches with a processing-time trigger, or sessions of event time; state is kept by a
streaming aggregate, or by tables that ``foreachBatch`` merges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from ..functions.text import matches_any
from ..operators.predicates import latest_events
from ..plans.history import coupling_alerts


def watch(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1, form: str = "parquet") -> DataFrame:
    """The event stream of a landing folder."""
    return spark.readStream.format(form).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)


def debounced(events: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, ignored: list[str] | None = None, extensions: list[str] | None = None, every: str | None = "1 second") -> DataStreamWriter:
    """Hands each micro-batch to ``handle`` as (path, kind): filtered, the last meaningful event of a path."""
    kept = events.where(~matches_any(F.col("path"), ignored)) if ignored else events
    writer = kept.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, epoch: handle(latest_events(batch, extensions), epoch))
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)


def quiet_sessions(events: DataFrame, gap: str = "1 second", lateness: str = "10 minutes", extensions: list[str] | None = None) -> DataFrame:
    """(path, start, end, kind, events): changes of a path coalesced until it has been quiet for ``gap`` of event time, with its last meaningful kind. Sessions
    depend on the events' times only, not on their arrival or on a trigger, up to ``lateness``; an event that comes later than that is dropped. Works on batches and streams alike."""
    rows = events.where(F.regexp_extract("path", r"\.([^./]*)$", 1).isin(extensions)) if extensions else events
    rows = rows.withWatermark("ts", lateness) if events.isStreaming else rows
    last = F.max_by("kind", F.struct((F.col("kind") != "Unknown").alias("known"), F.col("ts"), F.col("seq")))
    found = rows.groupBy(F.session_window("ts", gap), "path").agg(last.alias("kind"), F.count(F.lit(1)).alias("events"))
    return found.select("path", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "kind", "events")


def persist_batches(path: str) -> Callable[[DataFrame, int], None]:
    """A handler that appends each batch under its number; written again on replay, so a batch is stored once."""
    return lambda batch, epoch: batch.withColumn("batch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/batch={epoch}")


def drift(events: DataFrame, pending: DataFrame | None = None, lateness: str | None = None) -> DataFrame:
    """(entity, drift_count, first_seen, last_seen): running counters of changed entities, without those of a pending transaction (a stream-static anti-join).
    ``lateness`` adds a watermark and a daily window, which bounds the state."""
    rows = events.withColumn("entity", F.col("path"))
    if pending is not None:
        rows = rows.join(pending.select("entity").withColumn("_p", F.lit(True)), "entity", "left").where("_p is null")
    keys = [F.col("entity")]
    if lateness:
        rows, keys = rows.withWatermark("ts", lateness), [F.window("ts", "1 day"), F.col("entity")]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("drift_count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def alerts(couplings: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None], every: int = 10) -> Callable[[DataFrame, int], None]:
    """A handler that, on every tenth batch, hands the couplings that touch changed files to ``sink``."""

    def handle(batch: DataFrame, epoch: int) -> None:
        if epoch % every == 0:
            sink(coupling_alerts(couplings(), batch.select("path")), epoch)

    return handle


def windowed_counts(events: DataFrame, key: str, window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Extension: event-time counts with a watermark."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", window), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")
