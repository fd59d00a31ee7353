"""Keyed lookups, enrichment and integrity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titleloom import rules
from titleloom.functions import attributes as A
from titleloom.operators.rank import top_k


def items_of_work(
    wanted: DataFrame, items: DataFrame, listings: DataFrame, keys: Sequence[str],
    listing_key: str = "content_hash", limit: int | None = None, tie: Sequence[str] = (), wanted_last: bool = False,
) -> DataFrame:
    """Items that match wanted on keys, with their listing.

    keys decide the form: work, (work, season, episode) or any alternate id.
    Rows without a listing are dropped. With a limit only the first rows per
    wanted key stay, best seeders first (null in front), with their rank;
    without one all rows come, in no order.

    Items meet the wanted keys first, so that few are joined where few are wanted.
    Where most are, wanted_last saves moving them by key before the join: they are
    ranked per key, and the keys that lie dealt by then meet the wanted ones.
    """
    asked = wanted.select(*keys).distinct()
    found = items if wanted_last else items.join(asked, list(keys), "left_semi")
    joined = found.join(listings, listing_key)
    if limit is not None:
        order = [F.col("seeders").desc_nulls_first(), *[F.col(c).asc() for c in tie]]
        joined = top_k(joined, keys, order, limit)
    return joined.join(asked, list(keys), "left_semi") if wanted_last else joined


def fetch(listings: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Listings whose key is wanted, each once."""
    return listings.join(wanted.select(key), key, "left_semi")


def with_availability(
    listings: DataFrame, status: DataFrame, key: str = "content_hash", ready: str = rules.JOB_SUCCESS,
    order: Sequence[str] = ("status",),
) -> DataFrame:
    """Add available: the first status row of the hash (any case), by order, says ready."""
    first = F.min(F.struct(*order, F.col("status").alias("_status"))).alias("_first")
    flags = status.groupBy(F.lower(key).alias("_hash")).agg(first)
    flags = flags.select("_hash", (F.col("_first._status") == ready).alias("_ready"))
    return (
        listings.join(flags, F.lower(F.col(key)) == F.col("_hash"), "left")
        .withColumn("available", F.coalesce("_ready", F.lit(False)))
        .drop("_hash", "_ready")
    )


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return children.join(parents.select(key), key, "left_anti")


def cascade_delete(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Children that remain after their deleted parents are gone."""
    return children.join(deleted.select(key), key, "left_anti")


def set_null(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Children keep their row but lose a deleted parent's key."""
    gone = deleted.select(F.col(key).alias("_gone")).distinct()
    return (
        children.join(gone, F.col(key) == F.col("_gone"), "left")
        .withColumn(key, F.when(F.col("_gone").isNull(), F.col(key)))
        .drop("_gone")
    )


def insert_if_absent(existing: DataFrame, batch: DataFrame, key: str, arrival: Sequence[str]) -> DataFrame:
    """Rows of the batch to append: new keys only, the first arrival of each."""
    new = batch.join(existing.select(key), key, "left_anti")
    values = [c for c in batch.columns if c != key]
    first = F.min_by(F.struct(*values), F.struct(*arrival)).alias("row")
    return new.groupBy(key).agg(first).select(key, "row.*").select(*batch.columns)


def remove(listings: DataFrame, removals: DataFrame, keys: Sequence[str]) -> DataFrame:
    return listings.join(removals.select(*keys), list(keys), "left_anti")


def with_estimated_seeders(
    listings: DataFrame, source_base: DataFrame, provider: str = "provider", tier: str = "tier",
    seeders: str = "seeders",
) -> DataFrame:
    """Fill missing or zero seeders with source base x tier multiplier.

    source_base: provider, base; of several rows of a provider the smallest base
    counts. Sources it does not know get the default base.
    """
    base = source_base.groupBy(F.col("provider").alias("_provider")).agg(F.min("base").alias("_base"))
    joined = listings.join(base, F.col(provider) == F.col("_provider"), "left")
    estimate = estimated_seeders(F.col("_base"), F.col(tier))
    return joined.withColumn(
        seeders, F.coalesce(F.nullif(F.col(seeders), F.lit(0)), estimate).cast("bigint")
    ).drop("_provider", "_base")


def estimated_seeders(base: Column, tier: Column) -> Column:
    base = F.coalesce(F.nullif(base, F.lit(0)), F.lit(rules.ESTIMATED_SEEDERS_DEFAULT))
    return F.round(base * A.table_value(tier, rules.TIER_SEEDER_MULTIPLIER, 1.0)).cast("bigint")


def attach_detail(
    listings: DataFrame, items: DataFrame, details: DataFrame, source: str = "source", position: str = "position"
) -> DataFrame:
    """Give each listing the link behind the first source item of its raw title.

    items: source, raw_title, position, detail_url. details: detail_url, link;
    of several links of a url the smallest counts. Listings without a link are
    dropped.
    """
    first = items.groupBy(source, "raw_title").agg(F.min_by("detail_url", position).alias("detail_url"))
    linked = details.where(F.coalesce(F.col("link"), F.lit("")) != "").groupBy("detail_url").agg(F.min("link").alias("link"))
    return listings.join(first, [source, "raw_title"]).join(linked, "detail_url")
