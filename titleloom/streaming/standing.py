"""Standing queries: listings are matched as they arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from titleloom.operators.link import link_indexed, query_index
from titleloom.sources.keyed import write_keyed


def store_queries(queries: DataFrame, buckets: int, query_id: str = "query_id", title: str = "title", path: str | None = None) -> str:
    """Write the block index of the wanted titles, bucketed by block (runs the write); returns the table's name."""
    return write_keyed(query_index(queries, query_id, title), "standing", ["block"], buckets, path)


def match(spark: SparkSession, listings: DataFrame, stored: str, title: str = "title", min_confidence: float = 0.0, keep: Sequence[str] = ()) -> DataFrame:
    """Pairs (query_id, title, match_type, confidence, *keep) of arriving listings with the stored queries.

    listings is a stream or a batch. The stored side is read bucket by bucket
    and never moved; only what arrives is dealt to its blocks (or broadcast, where
    Spark finds it small). There is no state: a listing is judged by itself.
    """
    return link_indexed(spark.table(stored), listings, title, min_confidence, keep)
