"""Requests that come several times, answered once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def span_start(ts: str, span_seconds: int) -> Column:
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(span_seconds * 1_000_000)))


def once(requests: DataFrame, key: str, ts: str, span_seconds: int, delay_seconds: int) -> DataFrame:
    """The first request to arrive of each (key, span of time), with span_start (stream).

    Requests without a key count as one key. Spans start at multiples of their
    length. A key is forgotten delay_seconds after its request; as the
    delay is not shorter than the span, whatever comes after that is late
    for its span and dropped by the watermark, so which (key, span) come out,
    once each, does not depend on the order of arrival within the delay.
    """
    if delay_seconds < span_seconds:
        raise ValueError("the delay must not be shorter than the span")
    rows = requests.withColumn("span_start", span_start(ts, span_seconds)).withWatermark(ts, f"{delay_seconds} seconds")
    return rows.dropDuplicatesWithinWatermark([key, "span_start"])
