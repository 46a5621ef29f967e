"""Joins of the analytics: couplings, lookups, longest prefixes, similarity pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine, finite, norm
from ..session import shared_folder
from .many_patterns import find_patterns


def structural_coupling(edges: DataFrame, symbols: DataFrame, files: DataFrame, changed: DataFrame) -> DataFrame:
    """(caller_file, caller_symbol, callee_symbol): calls of changed symbols ``changed(symbol_name)``, distinct."""
    s = symbols.select("id", "file_id", "symbol_name")
    caller = s.select(F.col("id").alias("caller_symbol_id"), F.col("file_id").alias("_f"), F.col("symbol_name").alias("caller_symbol"))
    callee = s.join(changed.select("symbol_name").distinct(), "symbol_name", "left_semi").select(F.col("id").alias("callee_symbol_id"), F.col("symbol_name").alias("callee_symbol"))
    joined = edges.select("caller_symbol_id", "callee_symbol_id").join(callee, "callee_symbol_id").join(caller, "caller_symbol_id")
    return joined.join(files.select(F.col("id").alias("_f"), F.col("file_path").alias("caller_file")), "_f").select("caller_file", "caller_symbol", "callee_symbol").distinct()


def callers(edges: DataFrame, symbols: DataFrame, files: DataFrame, names: DataFrame) -> DataFrame:
    """Resolved callers of ``names(symbol_name)`` and unresolved ones by name, distinct."""
    resolved = structural_coupling(edges, symbols, files, names)
    open_ = edges.where("callee_symbol_id is null").join(names.select(F.col("symbol_name").alias("unresolved_callee")).distinct(), "unresolved_callee", "left_semi")
    who = symbols.select(F.col("id").alias("caller_symbol_id"), F.col("file_id").alias("_f"), F.col("symbol_name").alias("caller_symbol"))
    unresolved = open_.join(who, "caller_symbol_id").join(files.select(F.col("id").alias("_f"), F.col("file_path").alias("caller_file")), "_f")
    return resolved.unionByName(unresolved.select("caller_file", "caller_symbol", F.col("unresolved_callee").alias("callee_symbol"))).distinct()


def tests_by_file(mapping: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(tested_file, tests): the set of test symbols that map to each file."""
    tests = symbols.select(F.col("id").alias("test_symbol_id"), F.col("symbol_name").alias("test"))
    tested = files.select(F.col("id").alias("tested_file_id"), F.col("file_path").alias("tested_file"))
    return mapping.join(tests, "test_symbol_id").join(tested, "tested_file_id").groupBy("tested_file").agg(F.array_sort(F.collect_set("test")).alias("tests"))


def call_projection(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(source, target) by qualified name; an unresolved callee keeps its text, calls without either are dropped."""
    names = symbols.select("id", "qualified_name")
    out = edges.join(names.select(F.col("id").alias("caller_symbol_id"), F.col("qualified_name").alias("source")), "caller_symbol_id")
    # Calls without a callee stay where they are: as keys of an outer join they would all go to one task.
    known = out.where("callee_symbol_id is not null").join(names.select(F.col("id").alias("callee_symbol_id"), F.col("qualified_name").alias("_t")), "callee_symbol_id", "left")
    out = known.unionByName(out.where("callee_symbol_id is null").withColumn("_t", F.lit(None).cast("string")))
    return out.select("source", F.coalesce("_t", "unresolved_callee").alias("target"), "confidence").where("target is not null")


def with_fallback(base: DataFrame, primary: DataFrame, fallback: DataFrame, key: str, value: str) -> DataFrame:
    """base with value from primary (even if 0), else a positive fallback, else 0."""
    p, f = primary.select(key, F.col(value).alias("_p")), fallback.where(F.col(value) > 0).select(key, F.col(value).alias("_f"))
    return base.join(p, key, "left").join(f, key, "left").withColumn(value, F.coalesce("_p", "_f", F.lit(0))).drop("_p", "_f")


def transactions_of(ledger: DataFrame, provenance: DataFrame, path: str) -> DataFrame:
    hit = provenance.where((F.col("entity") == path) | F.col("entity").endswith(path)).select("tx_id").distinct()
    return ledger.join(hit, "tx_id", "left_semi").distinct()


def service_summary(files: DataFrame, routes: DataFrame, inflated: bool = False) -> DataFrame:
    """(service_name, files, routes); ``inflated`` counts a file once a route, as a plain count over the join would."""
    joined = files.where("service_name is not null").select(F.col("id").alias("file_id"), "service_name").join(routes.select("file_id", F.col("id").alias("route_id")), "file_id", "left")
    count = F.count("file_id") if inflated else F.count_distinct("file_id")
    return joined.groupBy("service_name").agg(count.alias("files"), F.count("route_id").alias("routes"))


def shared_commits(rows: DataFrame) -> DataFrame:
    """(file_a, file_b, commit_idx) with file_a < file_b: pairs of files that share a commit, by an equi-join on the commit.
    Commits are bounded by the eligibility filter, so the join is linear in commits."""
    a, b = rows.select("commit_idx", F.col("file").alias("file_a")), rows.select("commit_idx", F.col("file").alias("file_b"))
    return a.join(b, "commit_idx").where("file_a < file_b")


def undeclared(references: DataFrame, declarations: DataFrame, name: str = "var_name") -> DataFrame:
    return references.where(F.col(name) != "*").join(declarations.select(name), name, "left_anti")


def both_differences(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """(name, side): distinct values of one side that the other lacks."""
    left, right = a.select(name).distinct(), b.select(name).distinct()
    return left.join(right, name, "left_anti").withColumn("side", F.lit("left_only")).unionByName(right.join(left, name, "left_anti").withColumn("side", F.lit("right_only")))


def longest_prefix(paths: DataFrame, prefixes: DataFrame, path: str = "path", prefix: str = "prefix") -> DataFrame:
    """paths with the deepest directory of ``prefixes`` above them (null: none); ``.`` and the empty prefix hold all.
    Each path is exploded into its ancestors and equi-joined, so neither side is broadcast and no pairs are enumerated."""
    distinct = paths.select(path).distinct()
    parts = F.split(F.col(path), "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    tried = distinct.select(path, F.explode(above).alias("_dir"))
    known = prefixes.select(F.when(F.col(prefix) == ".", "").otherwise(F.rtrim(F.col(prefix), F.lit("/"))).alias("_dir"), F.col(prefix)).distinct()
    best = tried.join(known, "_dir").groupBy(path).agg(F.max_by(prefix, F.struct(F.char_length("_dir"), F.col(prefix))).alias(prefix))
    return paths.join(best, path, "left")


def cross_service(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """(source_service, target_service, calls): call edges (source_file, target_file) between different services ``owners(path, service)``."""
    a, b = owners.select(F.col("path").alias("source_file"), F.col("service").alias("source_service")), owners.select(F.col("path").alias("target_file"), F.col("service").alias("target_service"))
    return edges.join(a, "source_file").join(b, "target_file").where("source_service <> target_service").groupBy("source_service", "target_service").agg(F.count(F.lit(1)).alias("calls"))


def route_consumers(routes: DataFrame, dependencies: DataFrame, changed: DataFrame) -> DataFrame:
    """(path_pattern, consumers): how many services depend on each changed route."""
    hit = routes.join(changed.select("path_pattern"), "path_pattern", "left_semi").select("path_pattern").distinct()
    return hit.join(dependencies.select(F.col("pattern").alias("path_pattern"), "service"), "path_pattern", "left").groupBy("path_pattern").agg(F.count_distinct("service").alias("consumers"))


def _usable(vectors: DataFrame, id_col: str, vector: str, *more: Column) -> DataFrame:
    """``id, v`` and more of vectors that have a cosine; floats stay floats, which halves what is moved."""
    v, kept = F.col(vector), vectors.schema[vector].dataType.simpleString() == "array<float>"
    rows = vectors.select(F.col(id_col).alias("id"), (v if kept else F.transform(v, lambda x: x.cast("double"))).alias("v"), *more)
    return rows.where(finite(F.col("v")) & (norm(F.col("v")) > 0))


def _unit_rows(column, rows):
    """The matrix of some rows of a list column, all of one length, as doubles of unit length."""
    import numpy as np
    import pyarrow as pa

    x = column.take(pa.array(rows)).combine_chunks()
    x = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def similar_pairs(vectors: DataFrame, threshold: float, id_col: str = "id", vector: str = "embedding", block: Column | None = None, rows_per_tile: int = 16384) -> DataFrame:
    """(a, b, similarity) of pairs above the threshold, a < b. ``block``: pairs meet only within a block (for instance a bucket of a
    locality-sensitive hash); without it all rows meet, which is exact and quadratic, as the operation is defined.

    Rows are dealt into tiles of bounded size and each pair of tiles is one matrix product in one task, so no task holds more than two tiles.
    Vectors that are null, zero, non-finite or of another length than their partner have no similarity."""
    import pyarrow as pa

    kind = vectors.schema[id_col].dataType.simpleString()
    rows = _usable(vectors, id_col, vector, (block if block is not None else F.lit(0)).cast("string").alias("block")).where("id is not null")
    tiles = max(1, -(-vectors.count() // rows_per_tile))
    tile = F.pmod(F.xxhash64("id"), F.lit(tiles))
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long")), lambda k: F.struct(F.least(F.col("tile"), k).alias("i"), F.greatest(F.col("tile"), k).alias("j")))
    dealt = rows.withColumn("tile", tile).withColumn("pair", F.explode(others)).select("id", "v", "block", "tile", "pair.i", "pair.j")

    def compare(table: pa.Table) -> pa.Table:
        import numpy as np
        import pyarrow.compute as pc

        found: list[tuple] = []
        sizes = pc.list_value_length(table.column("v")).to_numpy()
        at, i, j = table.column("tile").to_numpy(), table.column("i")[0].as_py(), table.column("j")[0].as_py()
        ids = table.column("id").to_numpy()
        for size in np.unique(sizes):
            own = np.flatnonzero(sizes == size)
            x = _unit_rows(table.column("v"), own)
            left, right = np.flatnonzero(at[own] == i), np.flatnonzero(at[own] == j)
            other = np.ascontiguousarray(x[right].T)
            for k in range(0, len(left), 256):
                part = left[k : k + 256]
                close = x[part] @ other
                r, c = np.nonzero(close > threshold)
                a, b = ids[own[part[r]]], ids[own[right[c]]]
                once = a < b if i == j else a != b
                swap = (a > b)[once]
                a, b = a[once], b[once]
                found.append((np.where(swap, b, a), np.where(swap, a, b), np.clip(close[r, c], -1, 1)[once]))
        kinds = [table.schema.field("id").type] * 2 + [pa.float64()]
        return pa.table({n: pa.array(np.concatenate([f[k] for f in found]) if found else [], kinds[k]) for k, n in enumerate(("a", "b", "similarity"))})

    return dealt.groupBy("block", "i", "j").applyInArrow(compare, f"a {kind}, b {kind}, similarity double")


def best_endpoints(files: DataFrame, endpoints: DataFrame, threshold: float = 0.5, limit: int = 10, rows_per_tile: int = 16384) -> DataFrame:
    """(endpoint, path, similarity): each endpoint's best file at the threshold or above, the best ``limit`` of them. files(path, embedding) are the changed files.

    All pairs are compared, as tiles of endpoints and of files, a matrix product in one task. A tile gives what may be an endpoint's best there, up to rounding;
    what may be among the best ``limit`` of all is scored again from its vectors, so ties are those of equal vectors. Files with the same vector count as the first one."""
    import pyarrow as pa

    slack = 1e-9
    e, f = _usable(endpoints, "endpoint", "embedding"), _usable(files, "path", "embedding").groupBy("v").agg(F.min("id").alias("id"))
    wide = next((t for t in ("double", "float") if f"array<{t}>" in (e.schema["v"].dataType.simpleString(), f.schema["v"].dataType.simpleString())), "double")
    tiles = [max(1, -(-d.count() // rows_per_tile)) for d in (endpoints, files)]
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v, one, two = F.col("v").cast(f"array<{wide}>").alias("v"), e.schema["id"].dataType, f.schema["id"].dataType
    left = e.select(F.col("id").alias("endpoint"), F.lit(None).cast(two).alias("path"), v, F.lit(True).alias("asks"), F.pmod(F.xxhash64("id", "v"), F.lit(tiles[0])).cast("int").alias("i"), upto(tiles[1]).alias("j"))
    right = f.select(F.lit(None).cast(one).alias("endpoint"), F.col("id").alias("path"), v, F.lit(False).alias("asks"), upto(tiles[0]).alias("i"), F.pmod(F.xxhash64("id", "v"), F.lit(tiles[1])).cast("int").alias("j"))

    def compare(table: pa.Table) -> pa.Table:
        import numpy as np
        import pyarrow.compute as pc

        sizes, asks = pc.list_value_length(table.column("v")).to_numpy(), table.column("asks").to_numpy()
        found: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for size in np.unique(sizes):
            here, there = np.flatnonzero((sizes == size) & asks), np.flatnonzero((sizes == size) & ~asks)
            if not len(here) or not len(there):
                continue
            x, y = _unit_rows(table.column("v"), here), np.ascontiguousarray(_unit_rows(table.column("v"), there).T)
            for k in range(0, len(here), 256):
                close = x[k : k + 256] @ y
                r, c = np.nonzero(close >= np.maximum(close.max(axis=1), threshold)[:, None] - slack)
                found.append((here[k + r], there[c], close[r, c]))
        which, what, close = (np.concatenate([part[n] for part in found]) for n in range(3))
        return pa.table({"endpoint": table.column("endpoint").take(pa.array(which)), "path": table.column("path").take(pa.array(what)), "close": pa.array(close)})

    some = left.unionByName(right).groupBy("i", "j").applyInArrow(compare, f"endpoint {one.simpleString()}, path {two.simpleString()}, close double")
    shared_folder(files.sparkSession)
    some = some.checkpoint()
    first = some.groupBy("endpoint").agg(F.max("close").alias("_best"))
    last = first.orderBy(F.desc("_best")).limit(limit).agg(F.min("_best").alias("_last"))
    near = first.crossJoin(F.broadcast(last)).where(F.col("_best") >= F.col("_last") - 2 * slack).select(F.col("endpoint").alias("_e"), "_best")
    pairs = some.join(near, F.col("endpoint").eqNullSafe(F.col("_e"))).where(F.col("close") >= F.col("_best") - 2 * slack).select("endpoint", "path").distinct()
    pairs = pairs.join(e.select(F.col("id").alias("_e"), F.col("v").alias("_ev")), F.col("endpoint").eqNullSafe(F.col("_e"))).join(f.select(F.col("id").alias("_p"), F.col("v").alias("_fv")), F.col("path").eqNullSafe(F.col("_p")))
    scored = pairs.select("endpoint", "path", cosine(F.col("_ev"), F.col("_fv")).alias("similarity")).where(F.col("similarity") >= threshold)
    best = scored.groupBy("endpoint").agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.col("path").alias("path"))).alias("b"))
    return best.select("endpoint", "b.path", (-F.col("b.s")).alias("similarity")).orderBy(F.desc("similarity"), "path", "endpoint").limit(limit)


def file_dependencies(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src_file, tgt_file): files whose symbols call symbols of another file."""
    s = symbols.select("id", "file_path")
    a, b = s.select(F.col("id").alias("caller_symbol_id"), F.col("file_path").alias("src_file")), s.select(F.col("id").alias("callee_symbol_id"), F.col("file_path").alias("tgt_file"))
    return edges.join(a, "caller_symbol_id").join(b, "callee_symbol_id").where("src_file <> tgt_file").select("src_file", "tgt_file").distinct()


def pattern_join(nodes: DataFrame, edges: DataFrame, source_category: str, relation: str, target_category: str | None = None) -> DataFrame:
    """(source, target): edges of a relation between nodes of given categories."""
    out = edges.where(F.col("relation") == relation).join(nodes.where(F.col("category") == source_category).select(F.col("id").alias("source")), "source", "left_semi")
    if target_category:
        out = out.join(nodes.where(F.col("category") == target_category).select(F.col("id").alias("target")), "target", "left_semi")
    return out.select("source", "target").distinct()


def containment(texts: DataFrame, needles: DataFrame, text: str, needle: str, key: str = "doc_id") -> DataFrame:
    """Pairs in which the text holds the needle; any number of either. Null and empty needles are in no text."""
    return find_patterns(texts, needles, key, text, needle)


def import_suffixes(imports: DataFrame, changed: DataFrame) -> DataFrame:
    """(file_path, changed_path): imports that equal, or are a suffix of, a changed path with or without its extension.
    Suffixes of changed paths are enumerated at directory boundaries, which makes it an equi-join."""
    target = F.replace(F.replace(F.col("import"), F.lit("::"), F.lit("/")), F.lit("\\"), F.lit("/"))
    bare = F.regexp_replace("path", r"\.[^./]*$", "")
    suffixes = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, "/"))), lambda i: F.array_join(F.slice(F.split(c, "/"), i, 1 << 20), "/"))
    tails = changed.select(F.col("path").alias("changed_path"), F.explode(F.array_distinct(F.concat(suffixes(F.col("path")), suffixes(bare)))).alias("_t"))
    return imports.select("file_path", F.explode("imported_from").alias("import")).withColumn("_t", target).join(tails, "_t").where("file_path <> changed_path").select("file_path", "changed_path").distinct()


def resolve_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """calls(callee) with ``callee_id`` and ``status``: one symbol of the name RESOLVED, more AMBIGUOUS, none UNRESOLVED."""
    names = symbols.groupBy(F.col("symbol_name").alias("callee")).agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("_id"))
    return calls.join(names, "callee", "left").withColumn("callee_id", F.when(F.col("_n") == 1, F.col("_id"))).withColumn("status", F.when(F.col("_n").isNull(), "UNRESOLVED").when(F.col("_n") == 1, "RESOLVED").otherwise("AMBIGUOUS")).drop("_n", "_id")


def mark_capped(edges: DataFrame, most: int = 50_000) -> DataFrame:
    """edges(file, is_public, caller, callee, status): beyond ``most`` of a file, public callers first, the status is CAPPED."""
    order = Window.partitionBy("file").orderBy(F.desc("is_public"), "caller", "callee")
    return edges.withColumn("status", F.when(F.row_number().over(order) > most, "CAPPED").otherwise(F.col("status")))


def federated_check(dependencies: DataFrame, interfaces: DataFrame, ledger: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """(sibling, symbol, state, entries): a sibling's interface that is gone is removed, else the count of its recent ledger entries."""
    found = dependencies.join(interfaces.select("sibling", "symbol", F.lit(True).alias("_there")).distinct(), ["sibling", "symbol"], "left")
    recent = ledger.where(F.col("committed_at") >= now - F.make_dt_interval(F.lit(days))).groupBy("sibling", "symbol").agg(F.count(F.lit(1)).alias("entries"))
    return found.join(recent, ["sibling", "symbol"], "left").select("sibling", "symbol", F.when(F.col("_there"), "present").otherwise("removed").alias("state"), F.when(F.col("_there"), F.coalesce("entries", F.lit(0))).otherwise(0).alias("entries"))
