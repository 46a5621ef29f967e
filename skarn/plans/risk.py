"""Risk weights, levels, dead code and observability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import blend, inactivity, name_penalty, path_weight, weight_level
from ..operators.graph import reachable

ENTRY_KINDS = ["ENTRYPOINT", "HANDLER", "PUBLIC_API", "TEST", "FFI", "MACRO"]
#: Trait names that are called implicitly: fixed values.
STANDARD_TRAITS = ["Eq", "PartialEq", "Ord", "PartialOrd", "Default", "Clone", "Copy", "Debug", "Display", "Hash", "Send", "Sync", "Serialize", "Deserialize", "From", "Into", "AsRef", "AsMut", "Iterator", "IntoIterator", "Error", "ToString", "Sized", "Drop"]


def file_weights(changes: DataFrame) -> DataFrame:
    """changes(path, protected, models, generated_models, routes, public_symbols, entrypoints, handlers) with the weights that each file adds."""
    w = path_weight(F.col("path"))
    whole = lambda c: F.floor(c).cast("long")  # noqa: E731  weights are cut to whole numbers one by one
    return changes.withColumn("path_weight", w).withColumn(
        "weight",
        F.when(F.col("protected"), whole(w * 70)).otherwise(0) + F.col("models") * whole(w * 35) + F.col("generated_models") * whole(w * 20) + F.col("routes") * whole(w * 30)
        + F.col("public_symbols") * whole(w * 30) + F.col("entrypoints") * whole(w * 20) + F.col("handlers") * whole(w * 15),
    )


def risk_score(changes: DataFrame, couplings: DataFrame, structural: DataFrame, undeclared_vars: DataFrame) -> DataFrame:
    """One row (weight, level): files, volume, at most two structural couplings, strong temporal couplings, undeclared variables."""
    files = file_weights(changes).agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("files"), F.coalesce(F.sum("path_weight"), F.lit(0.0)).alias("volume"))
    parts = files.crossJoin(structural.limit(2).agg((F.count(F.lit(1)) * 15).alias("structural"))).crossJoin(couplings.agg((F.count_if(F.col("score") >= 0.7) * 10).alias("temporal"))).crossJoin(undeclared_vars.agg((F.count(F.lit(1)) * 15).alias("variables")))
    volume = F.when(F.col("volume") >= 10, 20).when(F.col("volume") >= 5, 10).otherwise(0)
    total = F.col("files") + volume + F.col("structural") + F.col("temporal") + F.col("variables")
    return parts.select(total.cast("long").alias("weight")).withColumn("level", weight_level(F.col("weight")))


def observability_risk(signals: DataFrame) -> DataFrame:
    """One row (elevation): any Critical is High, more than three Warnings are Elevated."""
    return signals.agg(F.when(F.count_if(F.col("severity") == "Critical") > 0, "High").when(F.count_if(F.col("severity") == "Warning") > 3, "Elevated").otherwise("None").alias("elevation"))


def log_signals(lines: DataFrame, pattern: str, file: str = "file", seq: str = "seq", line: str = "line") -> DataFrame:
    """(signal, count, severity, excerpt): matching lines by their first 80 characters; the excerpt is the first one's surroundings of two lines."""
    around = Window.partitionBy(file).orderBy(seq)
    context = F.array_join(F.collect_list(line).over(around.rowsBetween(-2, 2)), "\n")
    hit = lines.withColumn("_excerpt", context).where(F.col(line).rlike(pattern))
    grouped = hit.groupBy(F.substring(line, 1, 80).alias("signal")).agg(F.count(F.lit(1)).alias("count"), F.min_by("_excerpt", F.struct(file, seq)).alias("excerpt"))
    return grouped.withColumn("severity", F.when(F.col("count") > 10, "Critical").when(F.col("count") > 3, "Warning").otherwise("Normal"))


def tail(lines: DataFrame, most: int, file: str = "file", seq: str = "seq") -> DataFrame:
    """The last lines of each file."""
    return lines.withColumn("_n", F.row_number().over(Window.partitionBy(file).orderBy(F.desc(seq)))).where(F.col("_n") <= most).drop("_n")


def dead_code(symbols: DataFrame, edges: DataFrame, last_commit_days: DataFrame, tested: DataFrame, threshold: float = 0.75, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), inactive_days: int = 90, include_traits: bool = False) -> DataFrame:
    """(id, symbol_name, file_path, confidence): symbols that no entry point reaches, in files at rest, without tests. Entry points and
    implicitly called traits are left out. last_commit_days: file_path, days; tested: id."""
    starts = symbols.where(F.col("entrypoint_kind").isin("ENTRYPOINT", "HANDLER", "PUBLIC_API")).select("id")
    live = reachable(edges.select(F.col("caller_symbol_id").alias("source"), F.col("callee_symbol_id").alias("target")).where("target is not null"), starts).withColumn("_live", F.lit(True))
    rows = symbols.where(F.col("entrypoint_kind").isNull() | ~F.col("entrypoint_kind").isin(ENTRY_KINDS))
    if not include_traits:
        rows = rows.where(~((F.col("symbol_kind") == "Type") & F.col("symbol_name").isin(STANDARD_TRAITS)))
    rows = rows.join(live, "id", "left").join(last_commit_days, "file_path", "left").join(tested.select("id").distinct().withColumn("_tested", F.lit(True)), "id", "left")
    parts: list[tuple[Column, float]] = [(F.when(F.col("_live"), 0.0).otherwise(1.0), weights[0]), (inactivity(F.col("days"), inactive_days), weights[1]), (F.when(F.col("_tested"), 0.0).otherwise(1.0), weights[2])]
    confidence = F.greatest(blend(parts) - name_penalty(F.col("symbol_name")), F.lit(0.0))
    return rows.select("id", "symbol_name", "file_path", confidence.alias("confidence")).where(F.col("confidence") >= threshold)


def coverage_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(kind, before, after): pattern counts that fell, by kind (LOG, ERROR_HANDLE, TRACE)."""
    b, a = before.groupBy("kind").agg(F.count(F.lit(1)).alias("before")), after.groupBy("kind").agg(F.count(F.lit(1)).alias("after"))
    return b.join(a, "kind", "left").withColumn("after", F.coalesce("after", F.lit(0))).where("after < before")


def data_flow_coupling(paths: DataFrame, symbols: DataFrame, changed: DataFrame, models: DataFrame, least_share: float = 0.2) -> DataFrame:
    """(label, changed_nodes, total_nodes, share, level): call chains ``paths(path)`` of symbol names that touch a data model and enough changed symbols."""
    nodes = paths.withColumn("label", F.array_join("path", " -> ")).select("label", F.explode("path").alias("symbol_name"))
    files = symbols.groupBy("symbol_name").agg(F.min("file_path").alias("file_path"))
    marked = nodes.join(files, "symbol_name", "left").join(changed.select(F.col("path").alias("file_path"), F.lit(1).alias("_c")).distinct(), "file_path", "left")
    marked = marked.join(models.select(F.lower("model_name").alias("_m")).distinct(), F.lower("symbol_name") == F.col("_m"), "left")
    grouped = marked.groupBy("label").agg(F.count("_c").alias("changed_nodes"), F.count(F.lit(1)).alias("total_nodes"), F.count("_m").alias("_models"))
    share = F.col("changed_nodes") / F.col("total_nodes")
    return grouped.where((F.col("_models") > 0) & (share >= least_share) & (F.col("total_nodes") >= 2)).select("label", "changed_nodes", "total_nodes", share.alias("share"), F.when((F.col("total_nodes") > 5) | (F.col("changed_nodes") >= 3), "High").otherwise("Medium").alias("level"))
