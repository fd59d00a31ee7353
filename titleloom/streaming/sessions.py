"""Sessions that end after an idle gap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titleloom.operators.rank import previous_row, running_total


def idle_sessions(
    events: DataFrame, key: str, ts: str, tie: Sequence[str], gap_seconds: int, bucket: str = "day"
) -> DataFrame:
    """One row per session: key, session, started_at, last_used, requests (batch).

    A session ends when the key was idle longer than the gap. Both passes work
    per (key, time bucket), so a hot key never sits in one task.
    """
    order = [ts, *tie]
    slot = F.date_trunc(bucket, F.col(ts))
    rows = events.select(key, *order)
    seen = previous_row(rows, [key], order, [ts], slot)
    idle = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("previous")[ts].cast("timestamp"))
    starts = F.when(F.coalesce(idle > gap_seconds * 1_000_000, F.lit(True)), 1).otherwise(0)
    flagged = seen.withColumn("_starts", starts).drop("previous")
    numbered = running_total(flagged, [key], order, F.col("_starts"), "session")
    return numbered.groupBy(key, "session").agg(
        F.min(ts).alias("started_at"), F.max(ts).alias("last_used"), F.count(F.lit(1)).alias("requests")
    )


def session_stream(events: DataFrame, key: str, ts: str, gap: str, delay: str) -> DataFrame:
    """Streaming twin: session windows, closed once the watermark passes them."""
    return (
        events.withWatermark(ts, delay)
        .groupBy(F.col(key), F.session_window(ts, gap).alias("w"))
        .agg(F.min(ts).alias("started_at"), F.max(ts).alias("last_used"), F.count(F.lit(1)).alias("requests"))
        .select(key, "started_at", "last_used", "requests")
    )
