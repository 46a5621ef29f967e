"""Helpers shared by the training-data operators: scratch tables, row keys, ASCII case folding, components."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The ASCII white space [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session; where it is unset, one of our own on a single host, an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not f"{spark.sparkContext.master}[".startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="skarn-checkpoint-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


_SHIPPED: set[str] = set()
#: Bytes of an Arrow batch: Spark's own limit and the one that these operators set in its place, so that a batch of long texts takes little of a worker's memory.
BATCH_BYTES, DEFAULT_BATCH_BYTES, OUR_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 1 << 26, 1 << 23


def ship(spark: SparkSession) -> None:
    """Gives this package to the Python workers, once an application, unless PYTHONPATH already does, and bounds Arrow batches where the session hasn't done so."""
    if spark.conf.get(BATCH_BYTES, None) in (None, f"{DEFAULT_BATCH_BYTES}b"):
        spark.conf.set(BATCH_BYTES, f"{OUR_BATCH_BYTES}b")
    root, context = Path(__file__).resolve().parents[2], spark.sparkContext
    if context.applicationId in _SHIPPED or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    target = Path(tempfile.mkdtemp(prefix="skarn-package-")) / "skarn.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted((root / "skarn").rglob("*.py")):
            archive.write(path, path.relative_to(root))
    context.addPyFile(str(target))  # Spark copies it to every executor
    _SHIPPED.add(context.applicationId)


class Scratch:
    """Tables written below the shared folder. They cut lineage and survive lost executors, as checkpoint files do,
    and like those they live until the folder is cleaned or :meth:`drop` is called."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        ship(spark)
        self.spark, self.base = spark, f"{shared_dir(spark)}/skarn-{name}-{uuid.uuid4().hex}"
        self.paths: list[str] = []

    def path(self, name: str = "t") -> str:
        self.paths.append(f"{self.base}/{len(self.paths):04d}-{name}")
        return self.paths[-1]

    def table(self, df: DataFrame, name: str = "t", partition_by: Iterable[str] = ()) -> DataFrame:
        path = self.path(name)
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Lets Spark delete shuffle files of finished jobs now: it does so when the driver's collector finds them unreachable, which may be long after."""
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, path: str | None = None) -> None:
        """Deletes one table, or all; whatever was derived from it lazily can't be read any more."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path or self.base)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, nothing else; pure ASCII strings take the byte-wise path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def hash128(*cols: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of the same columns."""
    return F.xxhash64(*cols), F.xxhash64(F.lit(7919), *cols)


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Columns that an operator is about to write are replaced, so equally named input columns go first."""
    clash = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in clash])


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has, for columns that an operator needs for a while."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of undirected ``edges(a long, b long)`` as ``(node, root)``, for linked nodes only.

    Each round every node picks the neighbour (or itself) that comes first in a random order of that round and the graph is
    contracted along the picks; a constant share of the nodes goes in each round, whatever the shape of the graph.
    A hub is only ever grouped by a partial aggregate or joined by a join that adaptive execution can split.
    """
    spark = edges.sparkSession
    current = scratch.table(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    picks: list[DataFrame] = []
    while not current.isEmpty():
        order = lambda c, k=len(picks): F.xxhash64(F.lit(k), F.col(c))
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        with_self = both.unionByName(both.select("a", F.col("a").alias("b")))
        pick = scratch.table(with_self.groupBy(F.col("a").alias("node")).agg(F.min_by("b", F.struct(order("b"), F.col("b"))).alias("up")), "picks")
        picks.append(pick)
        moved = current.join(pick.select(F.col("node").alias("a"), F.col("up").alias("ua")), "a").join(pick.select(F.col("node").alias("b"), F.col("up").alias("ub")), "b")
        current = scratch.table(moved.where("ua <> ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(), "edges")
    if not picks:
        return spark.createDataFrame([], "node long, root long")
    labels = picks[0].select("node", F.col("up").alias("root"))
    for pick in picks[1:]:
        step = pick.select(F.col("node").alias("root"), F.col("up"))
        labels = labels.join(step, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    return scratch.table(labels, "labels")


def broadcast_if_few(table: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """A written table of a few longs a row, marked to be broadcast if it has so many rows at most; else joins shuffle."""
    return F.broadcast(table) if table.count() <= rows else table


def arrow_map(df: DataFrame, per_batch: Callable, schema: str) -> DataFrame:
    """mapInArrow with a function of one record batch at a time."""

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            if batch.num_rows:
                yield from per_batch(batch)

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)
