"""Counts of any span of time from stored summaries of its days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LG_K = 14  # 2 ** 14 registers: a relative standard error of 0.8 %


def summarise(rows: DataFrame, day: Column, by: Sequence[str], key: str, lg_k: int = LG_K) -> DataFrame:
    """(day, *by, rows, keys): the number of rows and a HyperLogLog sketch of the distinct keys; null keys count as rows only."""
    sketch = F.hll_sketch_agg(F.col(key).cast("string"), F.lit(lg_k))
    return rows.withColumn("day", day.cast("date")).groupBy("day", *by).agg(F.count(F.lit(1)).alias("rows"), sketch.alias("keys"))


def append(summaries: DataFrame, path: str) -> None:
    """Add the summaries of a batch (runs the write), a folder a day.

    Sketches of one day from several batches unite like those of several days,
    so late rows are a further file and no stored day is read or written again.
    """
    summaries.repartition("day").write.mode("append").partitionBy("day").parquet(path)


def of_span(spark: SparkSession, path: str, span: Column, by: Sequence[str] = (), since: str | None = None, until: str | None = None) -> DataFrame:
    """(span, *by, rows, distinct): rows exactly, distinct keys by the united sketches.

    span is a column of day, such as its year. Days before `since` and from
    `until` on are not read.
    """
    days = spark.read.parquet(path)
    if since is not None:
        days = days.where(F.col("day") >= F.lit(since).cast("date"))
    if until is not None:
        days = days.where(F.col("day") < F.lit(until).cast("date"))
    united = F.hll_sketch_estimate(F.hll_union_agg("keys"))
    return days.groupBy(span.alias("span"), *by).agg(F.sum("rows").alias("rows"), united.alias("distinct"))
