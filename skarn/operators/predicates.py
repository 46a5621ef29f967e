"""Filters, lookups and small listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import glob_regex, matches_any
from .many_patterns import find_patterns


def path_filter(path: Column, exact: str | None = None, directory: str | None = None, language: str | None = None) -> Column:
    """Exact path, plain prefix (no directory boundary) and extension, each optional."""
    out = F.lit(True)
    if exact is not None:
        out = out & (path == exact)
    if directory is not None:
        out = out & path.startswith(directory)
    if language is not None:
        out = out & path.endswith(f".{language}")
    return out


def eligible_commits(commit_files: DataFrame, most_files: int = 50) -> DataFrame:
    """Distinct (commit_idx, file) of commits that are no merges and touch between one and ``most_files`` files."""
    rows = commit_files.where("not is_merge and file is not null").select("commit_idx", "file").distinct()
    sizes = rows.groupBy("commit_idx").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most_files)
    return rows.join(sizes.select("commit_idx"), "commit_idx", "left_semi")


def resolve_overrides(changes: DataFrame, rules: DataFrame, default_mode: str = "analyze") -> DataFrame:
    """(path, mode, required_verifications): the last matching rule gives the mode, verifications add up in rule order without repeats.
    rules: idx, pattern, mode, required_verifications; a rule set is configuration, so it is read to the driver."""
    listed = rules.orderBy("idx").collect()
    mode, verifications = F.lit(default_mode), F.array().cast("array<string>")
    for r in listed:
        hit = F.col("path").rlike(glob_regex(r["pattern"]))
        if r["mode"] is not None:
            mode = F.when(hit, F.lit(r["mode"])).otherwise(mode)
        if r["required_verifications"]:
            verifications = F.when(hit, F.array_distinct(F.concat(verifications, F.array(*map(F.lit, r["required_verifications"]))))).otherwise(verifications)
    return changes.select("path", mode.alias("mode"), verifications.alias("required_verifications"))


def protected(changes: DataFrame, patterns: list[str]) -> DataFrame:
    return changes.where(matches_any(F.col("path"), patterns))


def like_user_pattern(column: Column, pattern: str) -> Column:
    """A user's pattern with * as any run."""
    return column.like(pattern.replace("*", "%"))


def id_prefix(column: Column, prefix: str) -> Column:
    return column.startswith(prefix)


def resolve_id(transactions: DataFrame, wanted: str) -> str:
    """Exact id, else a unique prefix, else a pending entity that equals, contains or ends with the text; ambiguity is an error."""
    for found in (
        transactions.where(F.col("tx_id") == wanted),
        transactions.where(F.col("tx_id").startswith(wanted)),
        transactions.where((F.col("status") == "PENDING") & (F.contains(F.lower("entity"), F.lit(wanted.lower())) | (F.substring_index("entity", "/", -1) == wanted))),
    ):
        rows = found.select("tx_id").distinct().orderBy("tx_id").limit(2).collect()
        if len(rows) == 1:
            return rows[0]["tx_id"]
        if rows:
            raise ValueError(f"{wanted!r} is ambiguous")
    raise LookupError(f"no transaction matches {wanted!r}")


def since(ts: Column, now: Column, days: int) -> Column:
    return ts >= now - F.make_dt_interval(F.lit(days))


def endpoints(routes: DataFrame, method: str | None = None, path_part: str | None = None) -> DataFrame:
    if method:
        routes = routes.where(F.col("method") == method.upper())
    if path_part:
        routes = routes.where(F.contains("path", F.lit(path_part)))
    return routes.orderBy("path", "method")


def json_field(text: Column, path: str) -> Column:
    return F.get_json_object(text, f"$.{path}")


def latest_events(events: DataFrame, extensions: list[str] | None = None) -> DataFrame:
    """(path, kind): the last event of each path by ``seq``; Unknown never replaces a known kind."""
    if extensions:
        events = events.where(F.regexp_extract("path", r"\.([^./]*)$", 1).isin(extensions))
    return events.groupBy("path").agg(F.max_by("kind", F.struct((F.col("kind") != "Unknown").alias("known"), F.col("seq"))).alias("kind"))


def changed_flag(rows: DataFrame, changed: DataFrame, path: str = "file_path") -> DataFrame:
    """rows with ``is_changed``: their path is among ``changed(path)``."""
    marks = changed.select(F.col("path").alias(path), F.lit(True).alias("is_changed")).distinct()
    return rows.join(marks, path, "left").withColumn("is_changed", F.coalesce("is_changed", F.lit(False)))


def only_changed(rows: DataFrame, changed: DataFrame, path: str = "file_path") -> DataFrame:
    return rows.join(changed.select(F.col("path").alias(path)), path, "left_semi")


def validators(rows: DataFrame, category: str) -> DataFrame:
    return rows.where(F.col("category").isin(category, "ALL")).orderBy("name")


def forbidden_terms(rules: DataFrame, actions: DataFrame) -> DataFrame:
    """Violations (tx_id, term): rules that start with ``NO `` whose term is in the planned action or the entity, in any case."""
    banned = rules.where(F.upper("rule").startswith("NO ")).select(F.trim(F.expr("substring(rule, 4)")).alias("term"), "glob").withColumn("_term", F.lower("term"))
    text = actions.select("tx_id", "entity", F.lower(F.concat_ws(" ", "action", "entity")).alias("_text"))
    found = find_patterns(text, banned, "tx_id", "_text", "_term")
    return found.where(F.col("glob").isNull() | F.rlike("entity", F.col("glob"))).select("tx_id", "term").distinct()


def exported_interfaces(snapshots: DataFrame, symbols: DataFrame) -> DataFrame:
    """Public symbols of the latest snapshot, sorted."""
    latest = snapshots.agg(F.max("id").alias("snapshot_id"))
    return symbols.join(F.broadcast(latest), "snapshot_id").where("is_public").select("file_path", "symbol_name", "symbol_kind").orderBy("file_path", "symbol_name", "symbol_kind")


def import_new(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """existing with the incoming rows whose key it lacks."""
    return existing.unionByName(incoming.join(existing.select(*keys), keys, "left_anti").select(*existing.columns))


def merge_scores(own: DataFrame, other: DataFrame) -> DataFrame:
    """(path, score): the other side's score wins, paths of either side stay."""
    return own.select("path", F.col("score").alias("_a")).join(other.select("path", F.col("score").alias("_b")), "path", "full").select("path", F.coalesce("_b", "_a").alias("score"))


def first_rows(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def chain_accept(records: DataFrame, file: str = "file") -> DataFrame:
    """Bridge records in file order: a record is accepted if its parent_hash is the hash of the last accepted one (the first: null);
    privacy is the highest so far. An ordered fold of each file."""
    import pandas as pd

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        last, level, kept, levels = None, 0, [], []
        for parent, own, privacy in zip(pdf["parent_hash"], pdf["hash"], pdf["privacy"], strict=True):
            ok = (parent if pd.notna(parent) else None) == last
            if ok:
                last, level = own, max(level, int(privacy))
            kept.append(ok)
            levels.append(level)
        return pdf.assign(accepted=kept, privacy_so_far=levels)[[file, "seq", "accepted", "privacy_so_far"]]

    return records.groupBy(file).applyInPandas(fold, f"{file} string, seq long, accepted boolean, privacy_so_far int")


def attach(changes: DataFrame, rows: DataFrame, name: str, fields: list[str]) -> DataFrame:
    """changes(file_id, ...) with an array of the rows of each file."""
    grouped = rows.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    return changes.join(grouped, "file_id", "left").withColumn(name, F.coalesce(name, F.array().cast(grouped.schema[name].dataType)))


def deploy_tiers(changes: DataFrame) -> DataFrame:
    """(path, manifest_type, risk_tier) from (path, manifest_type, coupled): 1 for a Dockerfile or unknown, else 2, one more if coupled; two types in one change lift all to 3."""
    base = F.when(F.col("manifest_type").isin("Dockerfile", "Unknown"), 1).otherwise(2) + F.when(F.col("coupled"), 1).otherwise(0)
    many = changes.agg((F.count_distinct("manifest_type") >= 2).alias("_many"))
    return changes.crossJoin(F.broadcast(many)).select("path", "manifest_type", F.when(F.col("_many"), F.greatest(base, F.lit(3))).otherwise(base).alias("risk_tier"))
