"""Sharding by a k-d tree over document metadata.

A node that stands for m shards is split for m // 2 and the rest of them at the weighted quantile (a median where m is even) along its widest
metadata dimension: log bytes, lines, bytes per character, or the text's hash, each scaled to a part of [0, 1), the hash to the smallest, so that it splits what the others can't; weights are bytes, and recursion ends at leaves of the
target bytes, i.e. one shard. Ties along a dimension are broken by the text's hash, so equal texts always share a point and a shard. The
quantiles of all nodes of a level are found together by distributed histograms that are refined until the bin at the cut is light.

Groups of equal texts that weigh more than ``heavy`` of a shard (at most shards / heavy of them, so they may be listed) are kept out of the
histograms and placed on the tree one by one: a heavy group goes whole to the side of its point, or to the lighter side if that leaves the other short, and the
cut moves in the rest so that both sides have their bytes. A group above ``whole`` of a shard can't stay whole under the law of equal bytes: its rows are dealt into fragments of ``fragment`` of a shard at most, and
each fragment stays whole. Rows are dealt by the hash of a row number of their own, whatever their ids are; of a group with few rows a fragment, by their place among the group's rows.

Defined cases: null text has no bytes and the hash of an empty text; a row's size is its bytes plus ``overhead``; doc_id may be null or repeated; extra columns are carried through, those
named like an output are replaced; an empty table gives an empty result; with fewer texts than shards some shards are empty.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, hash128, without

HASH_BITS, POINT_BITS, BINS = 38, 24, 2048
DIMENSIONS = ("log_bytes", "lines", "density", "hash")


@dataclass
class Node:
    """A split (dimension, cut, children), or a shard."""

    shards: list[int]
    heavy: list[dict]
    dimension: int = 0
    cut: int = 0
    left: Node | None = None
    right: Node | None = None


def _points(text: Column) -> list[Column]:
    """Each dimension in [0, 1)."""
    octets, chars = F.octet_length(text).cast("double"), F.char_length(text).cast("double")
    lines = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))
    tie = (F.col("_h1").bitwiseAND(F.lit((1 << 24) - 1))).cast("double") / (1 << 24)
    return [F.log2(octets + 1.0) / 36.0, F.log2(lines.cast("double") + 1.0) / 36.0, F.when(chars > 0, (octets / chars - 1.0) / 3.5).otherwise(0.0), tie * 0.1]


def _key(k: int) -> str:
    return f"_key{k}"


def _route(node: Node, column: Column | None = None) -> Column:
    """The leaf's position in depth-first order of ``node``'s current leaves, as a column."""
    if node.left is None:
        return F.lit(node.shards[0])
    return F.when(F.col(_key(node.dimension)) < F.lit(node.cut), _route(node.left)).otherwise(_route(node.right))


def shard(documents: DataFrame, shards: int = 40, doc_id: str = "doc_id", text: str = "text", overhead: int = 16, heavy: float = 1 / 64, whole: float = 1.0, fragment: float = 0.05, tolerance: float = 1 / 2000, carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns of documents (all by default) with ``size, shard, slot``: bytes plus overhead, the shard of equal bytes, and the
    row's place in it, gapless from 0. shards: 1024 at most, as the tree is one expression; for more, shard a shard again."""
    spark, scratch = documents.sparkSession, Scratch(documents.sparkSession, "shard")
    if not 1 <= shards <= 1024:
        raise ValueError("shards must be between 1 and 1024")
    columns = [_key(k) for k in range(len(DIMENSIONS))]
    source = without(documents, ["size", "shard", "slot"])
    kept = [c for c in (carry or source.columns) if c in source.columns]
    filled = F.coalesce(F.col("text").cast("string"), F.lit(""))
    h1, h2 = hash128(filled)
    # The caller's columns travel in one, so that they clash with none of ours.
    rows = source.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(text).alias("text"))
    sized = rows.withColumns({"_h1": h1, "_h2": h2, "size": (F.octet_length(filled) + overhead).cast("long"), "_deal": F.xxhash64(F.lit("deal"), F.monotonically_increasing_id())})
    tie = F.shiftrightunsigned(F.col("_h2"), 64 - HASH_BITS)
    keyed = sized.withColumns({_key(k): F.shiftleft(F.floor(F.least(p, F.lit(0.9999999)) * (1 << POINT_BITS)).cast("long"), HASH_BITS) + tie for k, p in enumerate(_points(filled))})
    rows = scratch.table(keyed.select("row", "_h1", "_h2", "_deal", "size", *columns), "points")  # the row numbers hold from here on
    total = rows.agg(F.sum("size")).first()[0] or 0
    target = max(1.0, total / shards)
    by_text = rows.groupBy("_h1", "_h2").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), *[F.first(c).alias(c) for c in columns])
    groups = [r.asDict() for r in by_text.where(F.col("bytes") >= heavy * target).collect()]  # shards / heavy rows at most
    items, counted = [], []
    for g in sorted(groups, key=lambda g: (-g["bytes"], g["_h1"])):
        fragments = 1 if g["bytes"] <= whole * target else min(math.ceil(g["bytes"] / (fragment * target)), g["rows"])
        # Dealing by hash is even enough from a hundred rows a fragment.
        parts = [g["bytes"] / fragments] * fragments
        if 1 < fragments and g["rows"] < 100 * fragments:
            counted.append((g["_h1"], g["_h2"]))
            parts = [g["bytes"] / g["rows"] * (g["rows"] // fragments + (1 <= i <= g["rows"] % fragments)) for i in range(fragments)]
        items += [g | {"bytes": part, "fragment": i, "fragments": fragments} for i, part in enumerate(parts)]
    root = Node(list(range(shards)), items)
    rest = rows
    if groups:
        listed = F.broadcast(spark.createDataFrame([(g["_h1"], g["_h2"]) for g in groups], "_h1 long, _h2 long"))
        rest = scratch.table(rows.join(listed, ["_h1", "_h2"], "left_anti").select("size", *columns), "rest")
    level = [root]
    while any(len(n.shards) > 1 for n in level):
        _split(root, [n for n in level if len(n.shards) > 1], rest, target * tolerance)
        level = [c for n in level if n.left is not None for c in (n.left, n.right)]
    placed, nodes = [], [root]
    while nodes:
        node = nodes.pop()
        if node.left is None:
            placed += [(g["_h1"], g["_h2"], g["fragment"], node.shards[0]) for g in node.heavy]
        else:
            nodes += [node.left, node.right]
    chosen = _route(root)
    if placed:
        homes: dict[tuple[int, int], dict[int, int]] = {}
        for a, b, fragment, home in placed:
            homes.setdefault((a, b), {})[fragment] = home
        listed = spark.createDataFrame([(a, b, [x[i] for i in sorted(x)]) for (a, b), x in homes.items()], "_h1 long, _h2 long, _homes array<int>")
        if counted:  # 100 rows a fragment at most, so few
            few = F.broadcast(spark.createDataFrame(counted, "_h1 long, _h2 long"))
            place = F.row_number().over(Window.partitionBy("_h1", "_h2").orderBy("_deal")).cast("long")
            ranked = scratch.table(rows.join(few, ["_h1", "_h2"], "left_semi").withColumn("_deal", place), "counted")
            rows = rows.join(few, ["_h1", "_h2"], "left_anti").unionByName(ranked)
        rows = rows.join(F.broadcast(listed), ["_h1", "_h2"], "left")
        chosen = F.when(F.col("_homes").isNotNull(), F.element_at("_homes", (F.pmod(F.col("_deal"), F.size("_homes")) + 1).cast("int"))).otherwise(chosen)
    stored = scratch.table(rows.select("row", F.xxhash64(F.monotonically_increasing_id()).alias("_deal"), "size", chosen.cast("int").alias("shard")), "rows")
    return _slots(stored).select("row.*", "size", "shard", "slot")


def _slots(rows: DataFrame, bucket_rows: int = 100_000) -> DataFrame:
    """Numbers rows within shards: a prefix sum over small hash buckets, then row numbers inside each bucket."""
    buckets = rows.count() // bucket_rows + 8
    bucketed = rows.withColumn("_bucket", F.pmod(F.xxhash64(F.lit("slot"), F.col("_deal")), F.lit(buckets)))
    starts = bucketed.groupBy("shard", "_bucket").count().withColumn("_start", F.sum("count").over(Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)))
    numbered = bucketed.withColumn("_row", F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy("_deal")))
    joined = numbered.join(starts.select("shard", "_bucket", "_start"), ["shard", "_bucket"])
    return joined.withColumn("slot", (F.coalesce("_start", F.lit(0)) + F.col("_row") - 1).cast("long"))


def _split(root: Node, nodes: list[Node], rest: DataFrame, fine: float) -> None:
    """Splits all nodes of a level together."""
    number = {n.shards[0]: i for i, n in enumerate(nodes)}
    at = rest.withColumn("_node", _route(root)).where(F.col("_node").isin(list(number)))
    columns = [_key(k) for k in range(len(DIMENSIONS))]
    ranges = {r["_node"]: r for r in at.groupBy("_node").agg(F.sum("size").alias("bytes"), *[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]).collect()}
    state = {}
    for node in nodes:
        r = ranges.get(node.shards[0])
        lo = [min([g[c] for g in node.heavy] + ([r[f"{c}_lo"]] if r else []), default=0) for c in columns]
        hi = [max([g[c] for g in node.heavy] + ([r[f"{c}_hi"]] if r else []), default=0) for c in columns]
        node.dimension = max(range(len(columns)), key=lambda k: ((hi[k] >> HASH_BITS) - (lo[k] >> HASH_BITS), -k))
        half, k = len(node.shards) // 2, _key(node.dimension)
        loose = r["bytes"] if r else 0
        goal = (loose + sum(g["bytes"] for g in node.heavy)) * half / len(node.shards)
        state[node.shards[0]] = {"lo": r[f"{k}_lo"] if r else 0, "hi": (r[f"{k}_hi"] if r else 0) + 1, "below": 0, "loose": loose, "goal": goal, "node": node, "heavy": node.heavy}
    # Heavy groups take the side of their point relative to the cut; the cut is looked for with them counted at their point.
    _search(at, state, fine, lambda s, cut: sum(g["bytes"] for g in s["heavy"] if g[_key(s["node"].dimension)] < cut))
    for s in state.values():
        node, k = s["node"], _key(s["node"].dimension)
        left = [g for g in node.heavy if g[k] < s["lo"]]
        right = [g for g in node.heavy if g[k] >= s["lo"]]
        # What the fixed groups leave must be within what the loose rows can fill.
        room = lambda side: s["goal"] - sum(g["bytes"] for g in side)
        left.sort(key=lambda g: g["bytes"])
        right.sort(key=lambda g: g["bytes"])
        while left and room(left) < 0:
            right.append(left.pop(0))
        while right and room(left) > s["loose"]:
            left.append(right.pop(0))
        _balance(left, right, s["goal"], s["loose"])
        s |= {"left": left, "right": right, "exact": abs(s["goal"] - s["weight"]) <= fine and len(left) == sum(g[k] < s["lo"] for g in node.heavy)}
        if not s["exact"]:
            r = ranges.get(node.shards[0])
            s |= {"lo": r[f"{k}_lo"] if r else 0, "hi": (r[f"{k}_hi"] if r else 0) + 1, "below": 0, "fixed": sum(g["bytes"] for g in left)}
    again = {n: s for n, s in state.items() if not s["exact"]}
    if again:
        _search(at, again, fine, lambda s, cut: s["fixed"])
    for s in state.values():
        node = s["node"]
        half = len(node.shards) // 2
        node.cut = s["lo"]
        node.left, node.right = Node(node.shards[:half], s["left"]), Node(node.shards[half:], s["right"])


def _balance(left: list[dict], right: list[dict], goal: float, loose: int) -> None:
    """Exchanges heavy groups until the loose rows can make up the difference, or no exchange brings the sides closer."""
    weight = sum(g["bytes"] for g in left)
    off = lambda w: max(0.0, w - goal, goal - loose - w)
    for _ in range(64):
        if not off(weight):
            return
        right.sort(key=lambda g: g["bytes"])
        sizes, surplus = [g["bytes"] for g in right], weight - min(max(weight, goal - loose), goal)
        moves = [(off(weight - g["bytes"]), i, -1) for i, g in enumerate(left)] + [(off(weight + b), -1, j) for j, b in enumerate(sizes)]
        for i, g in enumerate(left):
            j = bisect_left(sizes, g["bytes"] - surplus)
            moves += [(off(weight - g["bytes"] + sizes[x]), i, x) for x in (j - 1, j) if 0 <= x < len(sizes)]
        best, i, j = min(moves, default=(off(weight), -1, -1))
        if best >= off(weight):
            return
        gone, come = [left.pop(i)] if i >= 0 else [], [right.pop(j)] if j >= 0 else []
        left += come
        right += gone
        weight = sum(g["bytes"] for g in left)


def _search(at: DataFrame, state: dict[int, dict], fine: float, fixed) -> None:
    """Narrows every node's [lo, hi) to the cut at which loose bytes below plus ``fixed`` come nearest to its goal; ends with lo == the cut."""
    for s in state.values():
        s |= {"done": s["hi"] - s["lo"] <= 1, "weight": s["below"] + fixed(s, s["lo"])}
    while active := {n: s for n, s in state.items() if not s["done"]}:
        key, bin_, width = F.lit(None).cast("long"), F.lit(None).cast("long"), {}
        for n, s in active.items():
            width[n] = max(1, -(-(s["hi"] - s["lo"]) // BINS))
            own = _key(s["node"].dimension)
            here = (F.col("_node") == n) & (F.col(own) >= F.lit(s["lo"])) & (F.col(own) < F.lit(s["hi"]))
            key, bin_ = F.when(here, F.col(own)).otherwise(key), F.when(here, F.expr(f"({own} - {s['lo']}L) div {width[n]}L")).otherwise(bin_)
        counted = at.select("_node", key.alias("_k"), bin_.alias("_bin"), "size").where(F.col("_bin").isNotNull()).groupBy("_node", "_bin").agg(F.sum("size").alias("bytes"), F.min("_k").alias("least"), F.max("_k").alias("most")).collect()
        bins: dict[int, dict[int, tuple[int, int, int]]] = {n: {} for n in active}
        for r in counted:
            bins[r["_node"]][r["_bin"]] = (r["bytes"], r["least"], r["most"])
        for n, s in active.items():
            lo, below, w = s["lo"], s["below"], width[n]
            step, chosen, held = 0, None, (0, 0, 0)
            for b in range(-(-(s["hi"] - lo) // w)):
                held = bins[n].get(b, (0, 0, 0))
                if below + step + held[0] + fixed(s, lo + (b + 1) * w) >= s["goal"]:
                    chosen = b
                    break
                step += held[0]
            if chosen is None:
                s |= {"lo": s["hi"], "below": below + step, "done": True}
            else:
                start = lo + chosen * w
                s |= {"lo": start, "hi": min(s["hi"], start + w), "below": below + step}
                if held[0] and held[1] == held[2] and fixed(s, start) == fixed(s, s["hi"]):
                    s |= {"lo": held[1], "hi": held[1] + 1}  # a bin of one point can't be narrowed
                s["done"] = s["hi"] - s["lo"] <= 1 or held[0] <= fine and fixed(s, s["lo"]) == fixed(s, s["hi"])
                if s["done"]:
                    # The nearer edge of the last bin.
                    after = s["below"] + held[0]
                    if abs(after + fixed(s, s["hi"]) - s["goal"]) < abs(s["below"] + fixed(s, s["lo"]) - s["goal"]):
                        s |= {"lo": s["hi"], "below": after}
            s["weight"] = s["below"] + fixed(s, s["lo"])
