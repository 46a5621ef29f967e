"""Registered graph queries over graphs that grow with the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .operators import graph as g
from .queries import Inputs, query

# Customers of a nation call each other, a few steps along the nation's order; where both nations have a dozen customers, the first calls the next nation's first.
_STEPS = ((1, 1), (3, 1), (5, 3), (7, 2))
_BY_NATION = "SELECT c_nationkey AS nation, min(c_custkey) AS community FROM customer GROUP BY 1 HAVING count(*) > 1"


@query("g7_modularity_communities", f"SELECT c_custkey AS id, community FROM customer JOIN ({_BY_NATION}) b ON b.nation = c_nationkey")
def _(t: Inputs) -> DataFrame:
    nation = Window.partitionBy("c_nationkey")
    rows = t.table("customer").select("c_nationkey", "c_custkey", (F.row_number().over(nation.orderBy("c_custkey")) - 1).alias("r"), F.count(F.lit(1)).over(nation).alias("n"))
    other = rows.select("c_nationkey", F.col("c_custkey").alias("target"), F.col("r").alias("to"))
    steps = F.explode(F.array(*[(F.col("r") * a + b) % F.col("n") for a, b in _STEPS]))
    inner = rows.select("c_nationkey", F.col("c_custkey").alias("source"), steps.alias("to")).join(other, ["c_nationkey", "to"]).select("source", "target")
    first = rows.where("r = 0 AND n >= 12").select("c_nationkey", F.col("c_custkey").alias("source"))
    bridges = first.join(first.select((F.col("c_nationkey") - 1).alias("c_nationkey"), F.col("source").alias("target")), "c_nationkey").select("source", "target")
    return g.modularity_communities(inner.unionByName(bridges))
