"""Curated catalogue: gate, upsert, search, order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titleloom import rules
from titleloom.functions import attributes as A
from titleloom.operators import quality, rank
from titleloom.operators.link import id_then_title
from titleloom.workspace import stored


def curate(listings: DataFrame, link_prefix: str, arrival: list[str]) -> DataFrame:
    """Good listings only, ids normalised, last write per (work, link)."""
    shaped = listings.withColumn("tier", A.curated_tier(F.col("raw_title")))
    gated = quality.gate(
        shaped, ["composite_id", "raw_title", "link", "tier", "seeders"],
        link="link", work_id="composite_id", tier="tier", seeds="seeders", link_prefix=link_prefix,
    )
    kept = quality.good(gated).withColumn("work_id", A.base_id(F.col("composite_id"))).drop("composite_id")
    return rank.keyed_upsert(kept, ["work_id", "link"], arrival)


def search_places(requests: DataFrame, catalogue: DataFrame, key: str = "row_key", collation: str = "UNICODE") -> DataFrame:
    """All hits with their place in catalogue order within the request; titles are compared in the collation (runs writes).

    The catalogue is written before it is searched in four ways, and the hits
    before they are ranged, so each is computed once. The requests are written
    too: their size is known then, and where they are few the catalogue is not
    moved to meet them.
    """
    hits = stored(id_then_title(stored(requests, "requests"), stored(catalogue, "catalogue"), "work_id", "raw_title"), "hits")
    hits = hits.withColumn("_tier", -A.table_value(F.col("tier"), rules.CURATED_TIER_SCORE, 0)).withColumn("_seeds", -F.col("seeders"))
    tie = [F.collate(F.col("raw_title"), collation), F.col(key)]
    return rank.positions_within(hits, ["request_id"], ["_tier", "_seeds"], tie, "place").drop("_tier", "_seeds")


def search(requests: DataFrame, catalogue: DataFrame) -> DataFrame:
    """All hits, sorted by request and catalogue order (one range-partitioned sort)."""
    hits = id_then_title(requests, catalogue, "work_id", "raw_title")
    order = rank.catalogue_order(F.col("tier"), F.col("seeders"), F.col("raw_title"), F.col("link"))
    return hits.orderBy("request_id", *order)
