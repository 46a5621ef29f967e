"""Vector functions over array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def finite(a: Column) -> Column:
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def cosine(a: Column, b: Column, on_zero: float | None = None) -> Column:
    """Clamped to [-1, 1]; null on unequal lengths or non-finite values; ``on_zero`` (null by default) for a zero vector."""
    na, nb = norm(a), norm(b)
    value = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (na * nb)))
    ok = (F.size(a) == F.size(b)) & finite(a) & finite(b)
    return F.when(ok, F.when((na > 0) & (nb > 0), value).otherwise(F.lit(on_zero)))


def sanitise(a: Column) -> Column:
    """Non-finite components become 0, then unit length; null if the norm is at most 1e-9."""
    clean = F.transform(a, lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x.cast("double")))
    n = norm(clean)
    return F.when(n > 1e-9, F.transform(clean, lambda x: x / n))


def mean_pool(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """The component-wise mean of each key's vectors; means are aggregated partially, component by component."""
    parts = rows.select(*keys, F.posexplode(vector).alias("_i", "_x")).groupBy(*keys, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    return parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias(vector))


def top_k(rows: DataFrame, query: list[float], k: int, id_col: str, vector: str, on_zero: float | None = None) -> DataFrame:
    """The k nearest rows by cosine, ties by id: one pass, a bounded heap a task."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = rows.select(id_col, cosine(F.col(vector), q, on_zero).alias("similarity")).where(F.col("similarity").isNotNull())
    return scored.orderBy(F.desc("similarity"), id_col).limit(k)
