"""Streams over bounded input, answered to the last row."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from titleloom.workspace import new_folder

STORE_SETTING = "spark.sql.streaming.stateStore.providerClass"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_end(
    spark: SparkSession, sources: Sequence[DataFrame], ends: Sequence[Sequence[tuple]], build: Callable[..., DataFrame], name: str
) -> DataFrame:
    """The rows that build(*sources) writes when its input has ended (runs the stream).

    A stream answers what its watermark has passed, which stays behind the last
    row. So each source is joined by a second one that is empty at first. When
    the input is used up, the rows of `ends`, later than all others, are put
    there and the stream goes on from its checkpoint: the watermark passes
    everything that still waits. End rows must give no result of their own.
    """
    marks = [new_folder(spark, f"{name}-end") for _ in sources]
    for mark, source in zip(marks, sources, strict=True):
        spark.createDataFrame([], source.schema).write.parquet(mark)
    both = [s.unionByName(spark.readStream.schema(s.schema).parquet(m)) for s, m in zip(sources, marks, strict=True)]
    stream = build(*both)
    out, state = new_folder(spark, name), new_folder(spark, f"{name}-state")
    before = spark.conf.get(STORE_SETTING, None)
    spark.conf.set(STORE_SETTING, STATE_STORE)
    try:
        for last in (False, True):
            if last:
                for mark, source, rows in zip(marks, sources, ends, strict=True):
                    spark.createDataFrame(list(rows), source.schema).coalesce(1).write.mode("append").parquet(mark)
            run = stream.writeStream.format("parquet").option("checkpointLocation", state).outputMode("append")
            run.trigger(availableNow=True).start(out).awaitTermination()
    finally:
        spark.conf.unset(STORE_SETTING) if before is None else spark.conf.set(STORE_SETTING, before)
    return spark.read.schema(stream.schema).parquet(out)


def run_in_steps(spark: SparkSession, parts: Sequence[DataFrame], start: Callable[[DataFrame], DataStreamWriter], name: str) -> None:
    """Let the parts arrive one after the other, each as one micro-batch (runs the stream).

    start gives the writer of the stream of all parts, with its checkpoint; it is
    started anew for each part and goes on where it stopped.
    """
    landing = new_folder(spark, name)
    before = spark.conf.get(STORE_SETTING, None)
    spark.conf.set(STORE_SETTING, STATE_STORE)
    try:
        for part in parts:
            part.write.mode("append").parquet(landing)
            arriving = spark.readStream.schema(part.schema).parquet(landing)
            start(arriving).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(STORE_SETTING) if before is None else spark.conf.set(STORE_SETTING, before)
