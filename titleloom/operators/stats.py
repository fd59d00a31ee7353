"""Catalogue, session, source and search statistics.

All of them are aggregations with map-side combine, so hot keys are cheap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titleloom import rules
from titleloom.operators.quality import allowed_suffix, blocked


def count_per_tier(df: DataFrame, tier: str = "tier", tiers: Sequence[str] = rules.SEARCH_TIERS) -> DataFrame:
    """(tier, listings) with 0 for empty tiers; other tiers are not counted."""
    counts = df.where(F.col(tier).isin(*tiers)).groupBy(F.col(tier).alias("tier")).agg(F.count(F.lit(1)).alias("n"))
    spark = df.sparkSession
    every = spark.range(1).select(F.explode(F.array(*[F.lit(t) for t in tiers])).alias("tier"))
    return every.join(counts, "tier", "left").select("tier", F.coalesce("n", F.lit(0)).alias("listings"))


def distinct_tiers(df: DataFrame, tier: str = "tier") -> DataFrame:
    return df.select(F.col(tier).alias("tier")).distinct()


def link_completeness(df: DataFrame, link: Column, repeated: Column) -> DataFrame:
    """Rows, rows that carry the repeated parameter, mean link length."""
    return df.agg(
        F.count(F.lit(1)).alias("links"),
        F.count_if(repeated).alias("complete_links"),
        (F.sum(F.coalesce(F.length(link), F.lit(0))) / F.count(F.lit(1))).alias("mean_length"),
    )


def success_rate(kept: Column, total: Column) -> Column:
    """Percent kept, 0 when there was nothing."""
    return F.when(total == 0, 0.0).otherwise(kept * 100.0 / total)


def catalogue_stats(df: DataFrame, work_id: str, approximate: bool = False) -> DataFrame:
    works = F.approx_count_distinct(work_id) if approximate else F.count_distinct(work_id)
    return df.agg(F.count(F.lit(1)).alias("listings"), works.alias("works"))


def sessions(events: DataFrame, key: str, ts: str) -> DataFrame:
    return events.groupBy(key).agg(
        F.min(ts).alias("created_at"), F.max(ts).alias("last_used"), F.count(F.lit(1)).alias("requests")
    )


def session_stats(per_key: DataFrame, as_of: Column, max_idle_seconds: int = rules.SESSION_IDLE_SECONDS) -> DataFrame:
    """Total sessions, active ones (idle below the limit), mean requests of those.

    as_of is a column of per_key or a literal; both sides compare in microseconds.
    """
    idle = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("last_used").cast("timestamp"))
    active = idle < max_idle_seconds * 1_000_000
    return per_key.agg(
        F.count(F.lit(1)).alias("sessions"),
        F.count_if(active).alias("active"),
        F.coalesce(F.avg(F.when(active, F.col("requests"))), F.lit(0.0)).alias("mean_requests"),
    )


def source_health(probes: DataFrame, source: str, ok: Column, time: Column, order: Sequence[str]) -> DataFrame:
    """Per source: probes, failures, healthy, mean time, and which one is chosen.

    A source is healthy while it has any good probe; its time is the mean over
    the good ones. The fastest healthy source is chosen, the first of order
    when none is healthy.
    """
    per_source = probes.groupBy(F.col(source).alias("source")).agg(
        F.count(F.lit(1)).alias("probes"),
        F.count_if(~ok).alias("failures"),
        F.avg(F.when(ok, time)).alias("mean_time"),
    )
    place = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("source"))
    ranked = per_source.withColumn("healthy", F.col("mean_time").isNotNull()).withColumn(
        "_place", F.when(place > 0, place).otherwise(len(order) + 1)
    )
    # one row per source here, however many probes there were
    w = Window.orderBy(F.col("healthy").desc(), F.col("mean_time").asc_nulls_last(), F.col("_place"), F.col("source"))
    return ranked.withColumn("rank", F.row_number().over(w)).withColumn("chosen", F.col("rank") == 1).drop("_place")


def main_item(
    items: DataFrame, group: Sequence[str], path: str, size: str, weighted: bool = False
) -> DataFrame:
    """The largest media item of each group, smallest path on ties.

    The plain form drops blocked items; the weighted form keeps them with a
    tenth of their weight, favours names that carry a tier and knows fewer
    suffixes.
    """
    media = items.where(allowed_suffix(F.col(path), rules.WEIGHTED_SUFFIXES if weighted else rules.MEDIA_SUFFIXES))
    weight = F.col(size).cast("double")
    if weighted:
        low = F.lower(F.col(path))
        weight = weight * F.when(low.rlike("1080p|720p|2160p|4k"), 1.5).otherwise(1.0)
        weight = weight * F.when(low.rlike("sample|trailer|teaser"), 0.1).otherwise(1.0)
    else:
        media = media.where(~blocked(F.col(path), rules.BLOCKED_FILE_KEYWORDS))
    best = F.min(F.struct((-weight).alias("neg"), F.col(path).alias("path"), F.col(size).alias("size")))
    return (
        media.groupBy(*group).agg(best.alias("best"))
        .select(*group, F.col("best.path").alias(path), F.col("best.size").alias(size), (-F.col("best.neg")).alias("weight"))
    )


def nested_by_work(df: DataFrame, work_id: str, order: Sequence[str], values: Sequence[str], parts: int) -> DataFrame:
    """(work_id, part, entries): the listings of a work as sorted arrays.

    A work has one array for each of `parts` hash ranges of its order columns
    that has listings; how many listings there are never changes the shape.
    Choose parts so that a part of the hottest work fits in a task.
    """
    spread = F.conv(F.substring(F.md5(F.concat_ws("|", *order)), 1, 8), 16, 10).cast("bigint")
    placed = df.withColumn("part", F.floor(spread * parts / float(1 << 32)).cast("bigint"))
    entry = F.struct(*order, *[v for v in values if v not in order])
    return placed.groupBy(work_id, "part").agg(F.sort_array(F.collect_list(entry)).alias("entries"))


def flattened(nested: DataFrame, work_id: str) -> DataFrame:
    return nested.select(work_id, F.inline("entries"))


def search_report(
    pairs: DataFrame, tiers: Sequence[str], best: DataFrame, total: DataFrame, repeated: Column
) -> DataFrame:
    """One row per query: counts per tier, kept listings and their link metrics.

    pairs: query_id and the listing counts of each matched title, one column per
    tier. best: query_id, tier, link. total: a one-row DataFrame, read as a
    scalar subquery.
    """
    matched = pairs.groupBy("query_id").agg(*[F.sum(t).alias(t) for t in tiers])
    matched = matched.withColumn("matched", sum((F.col(t) for t in tiers[1:]), F.col(tiers[0])))
    kept = best.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("kept"),
        F.array_join(F.array_sort(F.collect_set("tier")), ",").alias("tiers"),
        F.count_if(repeated).alias("complete_links"),
        (F.sum(F.coalesce(F.length("link"), F.lit(0))) / F.count(F.lit(1))).alias("mean_link_length"),
    )
    return (
        matched.join(kept, "query_id")
        .withColumn("total", total.scalar())
        .withColumn("match_rate", success_rate(F.col("matched"), F.col("total")))
    )
