"""Registered queries of commit graphs: a customer is a repository, an order a commit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .operators.commit_walk import walk_history
from .queries import Inputs, query

# An order's parents are the customer's order before it and, for every third order key, the one three before it.
_COMMITS = "o AS (SELECT o_custkey AS repo, o_orderkey AS k, o_orderdate AS ts, lag(o_orderkey) OVER w AS p0, CASE WHEN o_orderkey % 3 = 0 THEN lag(o_orderkey, 3) OVER w END AS p1, lead(o_orderkey) OVER w IS NULL AS head FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"
_EDGES = "e AS (SELECT k, p0 AS p, 0 AS i FROM o WHERE p0 IS NOT NULL UNION ALL SELECT k, p1, 1 FROM o WHERE p1 IS NOT NULL)"
_PATHS = "walk AS (SELECT k, CAST([] AS INT[]) AS word FROM o WHERE head UNION ALL SELECT e.p, list_append(word, i) FROM walk JOIN e ON e.k = walk.k)"
_ORDER = "b AS (SELECT k, word FROM walk QUALIFY row_number() OVER (PARTITION BY k ORDER BY len(word), word) = 1), n AS (SELECT o.*, row_number() OVER (PARTITION BY repo ORDER BY len(word), word) AS place FROM o JOIN b USING (k)), s AS (SELECT repo, min(place) AS stop FROM n WHERE concat('o', k) LIKE 'o77%' GROUP BY 1)"


@query("s1_all_parents_walk", f"WITH RECURSIVE {_COMMITS}, {_EDGES}, {_PATHS}, {_ORDER}, r AS (SELECT n.*, row_number() OVER (PARTITION BY repo ORDER BY place) - 1 AS commit_idx FROM n LEFT JOIN s USING (repo) WHERE (stop IS NULL OR place < stop) AND ts >= TIMESTAMP '1993-06-01 00:00:00') SELECT repo, concat('o', k) AS commit, p1 IS NOT NULL AS is_merge, commit_idx FROM r WHERE commit_idx < 8")
def _(t: Inputs) -> DataFrame:
    order = Window.partitionBy("repo").orderBy("commit_ts", "k")
    name = lambda c: F.concat(F.lit("o"), c)
    rows = t.table("orders").select(F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("commit_ts"))
    second = F.when((F.col("k") % 3 == 0), F.lag("k", 3).over(order))
    rows = rows.select("repo", "commit_ts", name(F.col("k")).alias("commit"), F.array_compact(F.array(name(F.lag("k").over(order)), name(second))).alias("parents"), F.lead("k").over(order).isNull().alias("head"))
    return walk_history(rows, rows.where("head"), 8, "1993-06-01 00:00:00", "o77").select("repo", "commit", "is_merge", "commit_idx")
