"""Requests for works to the ranked, display-ready answer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titleloom.functions import attributes as A
from titleloom.operators import lookup, rank


def delivered(label: str = "Catalogue") -> list[Column]:
    """Answer columns of an item joined with its listing."""
    tier = A.simple_tier(F.col("raw_title"))
    seeds = F.coalesce("seeders", F.lit(0)).cast("string")
    episodic = (F.coalesce("season", F.lit(0)) != 0) & (F.coalesce("episode", F.lit(0)) != 0)
    group = F.when(
        episodic,
        F.concat(F.lit(label.lower() + "-"), F.col("work_id"), F.lit("-s"), F.col("season").cast("string")),
    ).otherwise(F.concat(F.lit(label.lower() + "-"), F.substring("content_hash", 1, 8)))
    return [
        F.concat("raw_title", F.lit(" | Seeds: "), seeds, F.lit(" | "), A.bytes_text(F.col("size_bytes"))).alias("title"),
        F.concat(F.lit(label + " ["), tier, F.lit("]")).alias("name"),
        F.col("raw_title").alias("description"),
        F.array(F.concat(F.lit("dht:"), F.col("content_hash"))).alias("sources"),
        F.col("content_hash"),
        F.struct(group.alias("group")).alias("hints"),
        tier.alias("tier"),
    ]


def answer(
    wanted: DataFrame, items: DataFrame, listings: DataFrame, status: DataFrame, keys: Sequence[str], tie: Sequence[str],
    lookup_limit: int | None = None,
) -> DataFrame:
    """Look up, mark availability, rank the best tiers first, top 15 per request.

    Tier and availability stay columns, so marking a row never changes its tier.
    With lookup_limit only that many rows of a request, by seeders, are ranked.
    """
    found = lookup.items_of_work(wanted, items, listings, keys, limit=lookup_limit, tie=tie)
    marked = lookup.with_availability(found.drop("rank"), status)
    tiered = marked.withColumn("tier", A.simple_tier(F.col("raw_title")))
    ranked = rank.delivery_rank(tiered, keys, key=tie[0])
    return ranked.select(*keys, *tie, "rank", "available", "seeders", *[c for c in delivered()[:6]], "tier")
