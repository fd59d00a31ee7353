"""A versioned keyed table: a manifest per commit, tombstones, compaction beside open readers.

A table is a folder with data folders, none of which ever changes, and
manifests, one JSON file per version, that list the data folders in the order in
which they apply. A version comes to be when its manifest is renamed into place,
which fails where that number is taken; the writer then starts again from the
newer version. Readers open one version by number and read its folders only, so
neither writers nor compaction disturb them. Old folders go with vacuum.

Rows are upserted by key; a row that is marked as deleted removes its key, which
may come again later as a new one. Rows of a batch apply in arrival order, batches
in the order of their commits. A data folder holds one row per key of its batch:
the last row (null where the key was deleted last), the first arrival since the
last deletion in the batch, and whether there was one. These fold together without
the rows behind them, so no batch reads the table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(Exception):
    """The version was taken by another writer."""


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that can be read, ascending."""
    _, folder, files = _files(spark, f"{path}/manifests")
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """version, folders (in order) and streams (last batch of each) of a version, the newest by default."""
    if version is None:
        known = versions(spark, path)
        if not known:
            return {"version": 0, "folders": [], "streams": {}}
        version = known[-1]
    text = spark.read.text(f"{path}/manifests/v{version:010d}.json", wholetext=True).first()[0]
    return json.loads(text)


def publish(spark: SparkSession, path: str, state: dict) -> None:
    """Create the manifest of state's version, whole and only if there is none; else Conflict."""
    jvm, folder, files = _files(spark, f"{path}/manifests")
    files.mkdirs(folder)
    whole = jvm.org.apache.hadoop.fs.Path(folder, f".{uuid.uuid4().hex}.tmp")
    out = files.create(whole, False)
    out.write(json.dumps(state).encode())
    out.close()
    place = jvm.org.apache.hadoop.fs.Path(folder, f"v{state['version']:010d}.json")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(context.makeQualified(whole), context.makeQualified(place), options)  # atomic, never over a file
    except Exception as error:
        files.delete(whole, False)
        if files.exists(place):
            raise Conflict(state["version"]) from error
        raise


def _change(spark: SparkSession, path: str, change) -> int:
    """Publish change(newest manifest), again from the newest where another writer was first."""
    while True:
        now = manifest(spark, path)
        after = change(now)
        if after is None:
            return now["version"]
        try:
            publish(spark, path, {**after, "version": now["version"] + 1})
            return now["version"] + 1
        except Conflict:
            continue


def summarised(batch: DataFrame, keys: Sequence[str], arrival: Sequence[str], deleted: str) -> DataFrame:
    """One row per key of a batch: keys, wiped, first, row. Null keys are a key; a null mark means no deletion."""
    values = [c for c in batch.columns if c not in (*keys, deleted)]
    gone = F.coalesce(F.col(deleted), F.lit(False))
    rows = batch.select(*keys, F.struct(*arrival).alias("at"), gone.alias("gone"), F.struct(*values).alias("row"))
    ends = rows.groupBy(*keys).agg(
        F.max(F.when(F.col("gone"), F.col("at"))).alias("wiped_at"),
        F.max_by(F.when(~F.col("gone"), F.col("row")), "at").alias("row"),
    )
    since = ends.where("wiped_at IS NOT NULL").select(*[F.col(c).alias(f"_{c}") for c in keys], F.col("wiped_at").alias("since"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys])
    fresh = ~F.col("gone") & (F.col("since").isNull() | (F.col("at") > F.col("since")))
    first = rows.join(since, same, "left").groupBy(*keys).agg(F.min(F.when(fresh, F.col("at"))).alias("first"))
    first = first.select(*[F.col(c).alias(f"_{c}") for c in keys], "first")
    joined = ends.join(first, same)
    return joined.select(*keys, F.col("wiped_at").isNotNull().alias("wiped"), "first", "row")


def commit(batch: DataFrame, path: str, keys: Sequence[str], arrival: Sequence[str], deleted: str = "deleted", stream: str | None = None, number: int = 0) -> int:
    """Add a batch to the table (runs the write); returns the version that holds it.

    With stream, batch `number` of a stream that was committed before is not
    applied again, so a batch that runs twice counts once.
    """
    spark = batch.sparkSession

    def done(state: dict) -> bool:
        return stream is not None and state["streams"].get(stream, -1) >= number

    now = manifest(spark, path)
    if done(now):
        return now["version"]
    folder = f"data/{uuid.uuid4().hex}"
    summarised(batch, keys, arrival, deleted).write.parquet(f"{path}/{folder}")

    def change(state: dict) -> dict | None:
        if done(state):
            return None
        streams = {**state["streams"], **({} if stream is None else {stream: number})}
        return {"folders": [*state["folders"], folder], "streams": streams}

    return _change(spark, path, change)


def upsert_stream(rows: DataFrame, path: str, checkpoint: str, keys: Sequence[str], arrival: Sequence[str], deleted: str = "deleted"):
    """Writer of a stream of upserts and deletions: one version per micro-batch."""

    def write(batch: DataFrame, number: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        commit(batch, path, keys, arrival, deleted, stream, number)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def _folded(spark: SparkSession, path: str, folders: list[str], keys: Sequence[str]) -> DataFrame:
    """keys, first and row of the keys that are there after all folders, in order."""
    order = F.element_at(F.create_map(*[x for i, f in enumerate(folders) for x in (F.lit(f), F.lit(i))]), F.regexp_extract("_metadata.file_path", "(data/[0-9a-f]{32})/", 1))
    rows = spark.read.parquet(*[f"{path}/{f}" for f in folders]).withColumn("order", order)
    held = rows.groupBy(*keys).agg(
        F.max(F.when(F.col("wiped"), F.col("order"))).alias("wiped"),
        F.collect_list(F.when(F.col("first").isNotNull(), F.struct("order", "first"))).alias("firsts"),  # one per folder at most
        F.max_by(F.struct("row"), "order").alias("last"),
    )
    since = F.filter("firsts", lambda f: f.order >= F.coalesce("wiped", F.lit(-1)))
    held = held.select(*keys, F.array_min(since).getField("first").alias("first"), F.col("last.row").alias("row"))
    return held.where("row IS NOT NULL")


def read(spark: SparkSession, path: str, keys: Sequence[str], version: int | None = None) -> DataFrame:
    """The table at a version, the newest by default: keys, values and first_arrival."""
    folders = manifest(spark, path, version)["folders"]
    if not folders:
        raise ValueError(f"no version to read at {path}")
    rows = _folded(spark, path, folders, keys)
    return rows.select(*keys, "row.*", F.col("first").alias("first_arrival"))


def compact(spark: SparkSession, path: str, keys: Sequence[str]) -> int:
    """Fold the folders of the newest version into one, as a new version that reads the same (runs the write).

    Batches committed meanwhile stay behind the folded ones. Readers of older
    versions are not touched.
    """
    old = manifest(spark, path)["folders"]
    if len(old) < 2:
        return manifest(spark, path)["version"]
    folder = f"data/{uuid.uuid4().hex}"
    folded = _folded(spark, path, old, keys).withColumn("wiped", F.lit(False))  # nothing lies before it
    folded.select(*keys, "wiped", "first", "row").write.parquet(f"{path}/{folder}")

    def change(state: dict) -> dict | None:
        if state["folders"][: len(old)] != old:
            return None  # another compaction was first
        return {"folders": [folder, *state["folders"][len(old) :]], "streams": state["streams"]}

    return _change(spark, path, change)


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Drop the manifests before the newest `keep` and the data folders that only they list; returns these.

    Run it when no batch is being written: a folder that no manifest lists yet is taken for a left-over.
    """
    known = versions(spark, path)
    stay = {f for v in known[-keep:] for f in manifest(spark, path, v)["folders"]}
    jvm, folder, files = _files(spark, f"{path}/manifests")
    for v in known[:-keep]:
        files.delete(jvm.org.apache.hadoop.fs.Path(folder, f"v{v:010d}.json"), False)
    data = jvm.org.apache.hadoop.fs.Path(path, "data")
    gone = [s.getPath() for s in files.listStatus(data) if f"data/{s.getPath().getName()}" not in stay] if files.exists(data) else []
    for p in gone:
        files.delete(p, True)
    return sorted(f"data/{p.getName()}" for p in gone)
