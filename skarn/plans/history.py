"""Analytics over commit history: hotspots, temporal coupling, trends. Input ``commit_files(commit_idx, is_merge, file)``, newest commit 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import centrality_boost, decay, display_score
from ..operators.joins import shared_commits, with_fallback
from ..operators.predicates import eligible_commits, path_filter


class TooLittleHistory(ValueError):
    """Fewer commits than the analysis needs."""


def scan_history(log: DataFrame, most_commits: int = 1000, first_days: int | None = None, since_commit: str | None = None) -> DataFrame:
    """log(commit, commit_ts, is_merge, file) as numbered commit files, newest first: at most ``most_commits``, cut where a commit is too old or
    begins with ``since_commit``; merges carry no files."""
    commits = log.groupBy("commit").agg(F.max("commit_ts").alias("commit_ts"), F.max("is_merge").alias("is_merge")).orderBy(F.desc("commit_ts"), F.desc("commit")).limit(most_commits)
    order = Window.orderBy(F.desc("commit_ts"), F.desc("commit"))  # at most most_commits rows
    numbered = commits.withColumn("commit_idx", F.row_number().over(order) - 1)
    stop = F.lit(False)
    if first_days is not None:
        newest = F.max("commit_ts").over(Window.partitionBy())
        stop = stop | (F.col("commit_ts") < newest - F.make_dt_interval(F.lit(first_days)))
    if since_commit:
        stop = stop | F.col("commit").startswith(since_commit)
    before = F.max(stop.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    kept = numbered.withColumn("_stop", before).where("_stop = 0").select("commit", "commit_ts", "is_merge", F.col("commit_idx").cast("long").alias("commit_idx"))
    files = log.select("commit", "file").distinct()
    return kept.join(files, "commit", "left").withColumn("file", F.when(~F.col("is_merge"), F.col("file")))


def frequencies(commit_files: DataFrame, half_life: float = 0.0, where: Column | None = None) -> DataFrame:
    """(file, frequency): the decayed number of commits of each file; the index counts all commits, merges too."""
    rows = commit_files.where("file is not null").select("commit_idx", "file").distinct()
    rows = rows.where(where) if where is not None else rows
    return rows.groupBy("file").agg(F.sum(decay(F.col("commit_idx"), half_life)).alias("frequency"))


def complexities(symbols: DataFrame) -> DataFrame:
    """(file, complexity): the true maximum of cognitive and cyclomatic complexity over a file's symbols."""
    worst = F.greatest(F.coalesce("cognitive_complexity", F.lit(0)), F.coalesce("cyclomatic_complexity", F.lit(0)))
    return symbols.groupBy(F.col("file_path").alias("file")).agg(F.max(worst).alias("complexity"))


def hotspots(commit_files: DataFrame, symbols: DataFrame, fallback: DataFrame | None = None, half_life: float = 0.0, limit: int | None = 50, exact: str | None = None, directory: str | None = None, language: str | None = None, centrality: DataFrame | None = None) -> DataFrame:
    """(file, frequency, complexity, score, display): frequency and complexity, each relative to the largest, multiplied; ties by path."""
    f = frequencies(commit_files, half_life, path_filter(F.col("file"), exact, directory, language))
    own = complexities(symbols)
    rows = with_fallback(f, own, fallback if fallback is not None else own.limit(0), "file", "complexity")
    tops = rows.agg(F.greatest(F.max("frequency"), F.lit(1e-300)).alias("_f"), F.greatest(F.max("complexity"), F.lit(1)).alias("_c"))
    scored = rows.crossJoin(F.broadcast(tops)).withColumn("score", F.col("frequency") / F.col("_f") * F.col("complexity") / F.col("_c")).drop("_f", "_c")
    scored = scored.withColumn("display", display_score(F.col("score")))
    if centrality is not None:
        scored = scored.join(centrality.select("file", "reachable", "rank"), "file", "left")
        boost = F.when(F.col("reachable").isNull() & F.col("rank").isNull(), 0.0).otherwise(centrality_boost(F.coalesce("reachable", F.lit(0)), F.coalesce("rank", F.lit(0.0))))
        scored = scored.withColumn("display", F.col("display") + boost).drop("reachable", "rank")
    ordered = scored.orderBy(F.desc(F.round("score", 12)), "file")
    return ordered if limit is None else ordered.limit(limit)


def temporal_coupling(commit_files: DataFrame, threshold: float = 0.75, half_life: float = 100.0, min_shared: int = 3, min_revisions: int = 5, most_files: int = 50, least_commits: int = 10) -> DataFrame:
    """(file_a, file_b, score): how much of a file's decayed revisions it shares with another, strictly above the threshold, in both directions.
    The decay index counts eligible commits only."""
    rows = eligible_commits(commit_files, most_files)
    commits = rows.select("commit_idx").distinct()
    if commits.limit(least_commits).count() < least_commits:
        raise TooLittleHistory(f"fewer than {least_commits} commits to learn from")
    position = Window.orderBy("commit_idx")  # one row a commit of a bounded history
    placed = rows.join(commits.withColumn("at", F.row_number().over(position) - 1), "commit_idx").withColumn("w", decay(F.col("at"), half_life))
    totals = placed.groupBy("file").agg(F.sum("w").alias("total"), F.count(F.lit(1)).alias("revisions")).where(F.col("revisions") >= min_revisions)
    weights = placed.select("commit_idx", "w").distinct()
    kept = placed.join(totals.select("file"), "file", "left_semi").select("commit_idx", "file")
    pairs = shared_commits(kept).join(weights, "commit_idx").groupBy("file_a", "file_b").agg(F.sum("w").alias("shared"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_shared)
    both = pairs.select("file_a", "file_b", "shared").unionByName(pairs.select(F.col("file_b").alias("file_a"), F.col("file_a").alias("file_b"), "shared"))
    scored = both.join(totals.select(F.col("file").alias("file_a"), "total"), "file_a").select("file_a", "file_b", (F.col("shared") / F.col("total")).alias("score"))
    return scored.where(F.col("score") > threshold).orderBy(F.desc(F.round("score", 12)), "file_a", "file_b")


def trend(history: DataFrame, path: str, now: Column, days: int = 30) -> DataFrame:
    """(timestamp, score) of one file over the last days, oldest first."""
    return history.where((F.col("file_path") == path) & (F.col("timestamp") >= now - F.make_dt_interval(F.lit(days)))).select("timestamp", "score").orderBy("timestamp")


def over_budget(history: DataFrame, budget: float = 5.0) -> DataFrame:
    """Files above the budget at the latest timestamp."""
    latest = history.agg(F.max("timestamp").alias("timestamp"))
    return history.join(F.broadcast(latest), "timestamp").where(F.col("score") > budget).select("file_path", "score").orderBy(F.desc("score"), "file_path")


def coupling_alerts(couplings: DataFrame, changed: DataFrame) -> DataFrame:
    """Couplings that touch changed files ``changed(path)``; above 0.95 they are High, else Medium."""
    hit = couplings.join(changed.select(F.col("path").alias("file_a")).distinct(), "file_a", "left_semi")
    return hit.withColumn("level", F.when(F.col("score") > 0.95, "High").otherwise("Medium"))
