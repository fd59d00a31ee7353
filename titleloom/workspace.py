"""Shared folder for tables a job writes on the way."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    Only where that is unset and all tasks run in this process, as in local
    tests, a temporary folder is made and set for the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="titleloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder name under the shared root that no other run uses."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder (runs the write): computed once, read as often as needed."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


@contextmanager
def open_writers(spark: SparkSession, most: int = 8) -> Iterator[None]:
    """Inside, a task that writes by partition columns keeps a file open per value instead of sorting its rows by them first.

    The sort of whole rows is what spills. A task that meets more than `most`
    values sorts the rows that are left, as before.
    """
    before = spark.conf.get(WRITERS, None)
    spark.conf.set(WRITERS, most)
    try:
        yield
    finally:
        spark.conf.unset(WRITERS) if before is None else spark.conf.set(WRITERS, before)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a write or an action go when it ends, not when the driver next collects its garbage.

    For jobs of many steps, each of which writes its rows: nothing reads the shuffles of a finished step again.
    """
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
