"""Upserting arriving listings into a table."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titleloom.operators.rank import keyed_upsert, last_row
from titleloom.workspace import open_writers


def _write_delta(rows: DataFrame, folder: str, keys: Sequence[str], buckets: int | None) -> None:
    writer = rows.write.mode("overwrite").option("compression", "zstd")
    if buckets is None:
        writer.parquet(folder)
        return
    # the rows come dealt by key, so a bucket is a file where there are as many shuffle partitions
    name = f"delta_{uuid.uuid4().hex}"
    with open_writers(rows.sparkSession, buckets):
        writer.format("parquet").bucketBy(buckets, *keys).option("path", folder).saveAsTable(name)
    rows.sparkSession.sql(f"DROP TABLE {name}")  # its files stay


def upsert_stream(
    rows: DataFrame, path: str, checkpoint: str, keys: Sequence[str], arrival: Sequence[str], buckets: int | None = None
):
    """Writer of a stream of listings: one delta folder per stream and micro-batch.

    Each batch is reduced to one row per key and written under the id of its
    stream (kept in the checkpoint) and its batch id with overwrite, so a batch
    that runs again replaces itself, and a stream with a new checkpoint adds to
    the table and replaces nothing. No batch reads or rewrites the table; readers
    resolve versions (current) and compact() folds the deltas now and then. With
    buckets the deltas are bucketed by key: give the same number to current and
    compact, and reading the table moves no row.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        _write_delta(keyed_upsert(batch, keys, arrival), f"{path}/delta={stream}-{batch_id}", keys, buckets)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def current(spark: SparkSession, path: str, keys: Sequence[str], arrival: Sequence[str], buckets: int | None = None) -> DataFrame:
    """Table state: last write wins over all deltas, first arrival kept."""
    stored = spark.read.parquet(path).drop("delta")
    if buckets is not None:
        name = f"upserted_{uuid.uuid4().hex}"
        by, columns = ", ".join(f"`{k}`" for k in keys), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema.fields)
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet OPTIONS (recursiveFileLookup 'true') CLUSTERED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        stored = spark.table(name)
    return merge(stored, keys, arrival)


def merge(stored: DataFrame, keys: Sequence[str], arrival: Sequence[str]) -> DataFrame:
    values = [c for c in stored.columns if c not in (*keys, "first_arrival")]
    rows = stored.groupBy(*keys).agg(last_row(stored, values, arrival).alias("last"), F.min("first_arrival").alias("first_arrival"))
    return rows.select(*keys, *[F.col("last")[c].alias(c) for c in values], "first_arrival")


def compact(spark: SparkSession, path: str, keys: Sequence[str], arrival: Sequence[str], buckets: int | None = None) -> None:
    """Fold the deltas of the table into one and drop them (runs the write).

    Merging a row twice changes nothing, so the table reads the same before,
    between and after the write and the drops, and a run that died halfway is
    put right by the next. Run it while no reader is open on the table.
    """
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = [s.getPath() for s in files.listStatus(folder) if s.getPath().getName().startswith("delta=")]
    if not old:
        return
    stored = spark.read.option("basePath", path).parquet(*[p.toString() for p in old]).drop("delta")
    _write_delta(merge(stored, keys, arrival), f"{path}/delta=folded-{uuid.uuid4().hex}", keys, buckets)
    for delta in old:
        files.delete(delta, True)
