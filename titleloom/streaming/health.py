"""Source health over sliding windows: which source was the one to ask, and when."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEYS = ("window_start", "source")


def per_window(probes: DataFrame, source: str, ok: Column, time: Column, ts: str, window: str, slide: str) -> DataFrame:
    """window_start, source, probes, failures and mean_time (of good probes, to a millionth) per window and source.

    A batch, or a stream with a watermark in update mode. A window that no probe
    falls into has no row.
    """
    good = F.when(ok, time)
    found = probes.groupBy(F.window(ts, window, slide).alias("w"), F.col(source).alias("source")).agg(
        F.count(F.lit(1)).alias("probes"),
        F.count_if(~F.coalesce(ok, F.lit(False))).alias("failures"),
        F.round(F.avg(good), 6).alias("mean_time"),
    )
    return found.select(F.col("w.start").alias("window_start"), "source", "probes", "failures", "mean_time")


def chosen(windows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add healthy, rank and chosen within each window: the fastest healthy source, the first of order when none is healthy."""
    place = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("source"))
    place = F.when(place > 0, place).otherwise(len(order) + 1)
    healthy = F.col("mean_time").isNotNull()
    w = Window.partitionBy("window_start").orderBy(healthy.desc(), F.col("mean_time").asc_nulls_last(), place, F.col("source"))
    return windows.select("*", healthy.alias("healthy"), F.row_number().over(w).alias("rank")).withColumn("chosen", F.col("rank") == 1)


def update_stream(
    probes: DataFrame, path: str, checkpoint: str, source: str, ok: Column, time: Column, ts: str, window: str, slide: str, delay: str
):
    """Writer of per_window as it changes: a folder per micro-batch with the windows that it touched.

    A batch that runs again replaces its folder. State is one row per source and
    window that the watermark has not passed. One checkpoint per path.
    """
    changed = per_window(probes.withWatermark(ts, delay), source, ok, time, ts, window, slide)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return changed.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The last update of every window and source."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*KEYS, "batch")]
    last = F.max_by(F.struct(*values), "batch").alias("last")
    return rows.groupBy(*KEYS).agg(last).select(*KEYS, "last.*")
