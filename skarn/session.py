"""Session factory: UTC, adaptive execution, partitions sized by the caller; and the folder that all hosts share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def session(name: str = "skarn", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume; nothing here is needed on a cluster that sets its own."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"} | conf
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, set as its checkpoint folder; where it is unset, a folder of our own on a single host, an error on a cluster."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not f"{context.master}[".startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="skarn-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(path)
    return path.rstrip("/")
