"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """The folder of all intermediate tables, in the shared one that spark.checkpoint.dir names.

    Only a local master, where driver and tasks are one process, may go without the setting.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = "file:///tmp/checkpoints"
    return f"{shared.rstrip('/')}/tracewell"


def path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table."""
    return f"{root(spark)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession, older_than_hours: float = 48.0) -> int:
    """Delete intermediate tables that no job has written to for so long; how many went.

    Results are lazy and read them, so nothing does this by itself.
    """
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root(spark))
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return 0
    oldest = (time.time() - older_than_hours * 3600) * 1000
    old = [x.getPath() for x in system.listStatus(folder) if x.getModificationTime() < oldest]
    return sum(bool(system.delete(x, True)) for x in old)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage and survives lost executors."""
    at = path(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
