"""Availability of a listing as of the moment it is asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titleloom import rules

# requests: request_id, key, at. changes: key, changed_at, seq (order within one instant), status.


def _last(status: Column, ready: str) -> list[Column]:
    return [status.alias("status"), F.coalesce(status == ready, F.lit(False)).alias("available")]


def as_of(requests: DataFrame, changes: DataFrame, horizon_seconds: int, ready: str = rules.JOB_SUCCESS) -> DataFrame:
    """request_id, key, at, status and available of each request: the last change at or before it, within the horizon (batch).

    A request meets the last change of its own horizon-wide bucket and all of
    the bucket before only through that bucket's last one, so a hot key spreads
    over its buckets.
    """
    width = horizon_seconds * 1_000_000
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    asked = requests.select("key", F.col("at"), micros("at").alias("us"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("status"), "request_id")
    told = changes.select("key", F.lit(None).cast(requests.schema["at"].dataType).alias("at"), micros("changed_at").alias("us"), "seq", "status", F.lit(None).cast(requests.schema["request_id"].dataType).alias("request_id"))
    log = told.withColumn("told", F.lit(True)).unionByName(asked.withColumn("told", F.lit(False))).withColumn("bucket", F.floor(F.col("us") / width))
    change = F.struct("us", "seq", "status")
    ends = log.where("told").groupBy("key", "bucket").agg(F.max(change).alias("before")).withColumn("bucket", F.col("bucket") + 1)
    seen = F.expr("max(CASE WHEN told THEN struct(us, seq, status) END) OVER (PARTITION BY key, bucket ORDER BY us RANGE UNBOUNDED PRECEDING)")
    rows = log.join(ends, ["key", "bucket"], "left").withColumn("seen", F.coalesce(seen, F.col("before")))
    status = F.when(F.col("seen.us") > F.col("us") - width, F.col("seen.status"))
    return rows.where("NOT told").select("request_id", "key", "at", *_last(status, ready))


def as_of_stream(requests: DataFrame, changes: DataFrame, horizon_seconds: int, delay: str = "10 minutes", ready: str = rules.JOB_SUCCESS) -> DataFrame:
    """Streaming twin of as_of, whatever the order of arrival within the delay.

    An outer join of both streams within the horizon, then the last change of
    each request. Both are watermarked: changes are held until no request can
    reach them, requests until no change can come before them.
    """
    asked = requests.select("request_id", "key", "at").withWatermark("at", delay)
    told = changes.select(F.col("key").alias("_key"), "changed_at", "seq", "status").withWatermark("changed_at", delay)
    within = (F.col("key") == F.col("_key")) & (F.col("changed_at") <= F.col("at"))
    within &= F.col("changed_at") > F.col("at") - F.expr(f"INTERVAL {horizon_seconds} SECONDS")
    pairs = asked.join(told, within, "leftOuter")
    last = F.max(F.when(F.col("changed_at").isNotNull(), F.struct("changed_at", "seq", "status"))).alias("last")
    found = pairs.groupBy("at", "request_id", "key").agg(last)
    return found.select("request_id", "key", "at", *_last(F.col("last.status"), ready))
