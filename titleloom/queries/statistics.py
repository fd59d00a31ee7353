"""Catalogue, session, source and search statistics."""

from pyspark.sql import functions as F

from titleloom import rules
from titleloom.functions import attributes as A
from titleloom.functions import text as X
from titleloom.operators import quality, spans, stats
from titleloom.plans import search
from titleloom.queries import sqltext as S
from titleloom.queries.base import query, table
from titleloom.queries.columns import LINK_PATTERN
from titleloom.queries.ranks import SEARCH_SQL
from titleloom.workspace import new_folder

TIERS = ("2160p", "1080p", "720p", "480p", "HD")


@query(
    "a1_count_per_tier",
    f"""SELECT d.tier, count(l.tier) AS listings FROM (VALUES ('2160p'),('1080p'),('720p'),('480p'),('HD')) d(tier)
LEFT JOIN (SELECT {S.simple_tier('raw_title')} AS tier FROM v_listing) l ON l.tier=d.tier GROUP BY d.tier""",
)
def a1(spark, sf):
    rows = table(spark, sf, "v_listing").select(A.simple_tier(F.col("raw_title")).alias("tier"))
    return stats.count_per_tier(rows, tiers=TIERS)


@query("a2_distinct_tiers", f"SELECT DISTINCT {S.tier('raw_title')} AS tier FROM v_listing")
def a2(spark, sf):
    return stats.distinct_tiers(table(spark, sf, "v_listing").select(A.tier(F.col("raw_title")).alias("tier")))


@query(
    "a3_link_completeness",
    """SELECT count(*) AS links, count(*) FILTER (contains(url,'?ref=') OR contains(url,'&ref=')) AS complete_links, round(avg(length(url)),6) AS mean_length FROM pages""",
)
def a3(spark, sf):
    url = F.col("url")
    repeated = F.contains(url, F.lit("?ref=")) | F.contains(url, F.lit("&ref="))
    return stats.link_completeness(table(spark, sf, "pages"), url, repeated).withColumn("mean_length", F.round("mean_length", 6))


@query(
    "a4_success_rate",
    f"""SELECT provider, count(*) AS total, count(*) FILTER (tier IN ('4K','1080p','720p','SD') AND coalesce(seeders,0)>0) AS kept,
 round(count(*) FILTER (tier IN ('4K','1080p','720p','SD') AND coalesce(seeders,0)>0)*100.0/count(*),6) AS rate
FROM (SELECT provider, seeders, {S.curated_tier('raw_title')} AS tier FROM v_listing) x GROUP BY provider""",
)
def a4(spark, sf):
    listings = table(spark, sf, "v_listing").withColumn("tier", A.curated_tier(F.col("raw_title")))
    gated = quality.gate(
        listings, ["composite_id", "raw_title", "link", "tier", "seeders"],
        link="link", work_id="composite_id", tier="tier", seeds="seeders", link_prefix="cat:?",
    )
    per_source = gated.groupBy("provider").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.size("failures") == 0).alias("kept")
    )
    return per_source.withColumn("rate", F.round(stats.success_rate(F.col("kept"), F.col("total")), 6))


@query("a5_catalogue_stats", "SELECT count(*) AS listings, count(DISTINCT work_id) AS works FROM v_listing")
def a5(spark, sf):
    return stats.catalogue_stats(table(spark, sf, "v_listing"), "work_id")


def within(spark, exact, rows, day, span, key, cut):
    """Spans counted from the summaries of two batches, with whether the distinct count is within 3 % of the exact one."""
    path = new_folder(spark, "summaries")
    for part in (rows.where(cut), rows.where(~cut)):
        spans.append(spans.summarise(part, day, [], key), path)
    found = spans.of_span(spark, path, span)
    close = F.abs(F.col("distinct") - F.col("exact")) <= F.col("exact") * 0.03
    return found.join(exact, "span").select("span", "rows", close.alias("close"))


@query("a5_works_by_span", "SELECT year(arrived_at)::INT AS span, count(*) AS rows, true AS close FROM v_listing GROUP BY 1")
def a5_span(spark, sf):
    """Listings and works by year, from the stored months of two batches."""
    rows = table(spark, sf, "v_listing").select("work_id", "arrived_at", "listing_id")
    exact = rows.groupBy(F.year("arrived_at").alias("span")).agg(F.count_distinct("work_id").alias("exact"))
    return within(spark, exact, rows, F.trunc("arrived_at", "month"), F.year("day"), "work_id", F.col("listing_id") % 2 == 0)


@query("a6_users_by_span", "SELECT CAST(date_trunc('week', ts) AS DATE)::VARCHAR AS span, count(*) AS rows, true AS close FROM events GROUP BY 1")
def a6_span(spark, sf):
    """Requests and users by week, from the stored days of two batches."""
    rows = table(spark, sf, "events").select("user_id", "ts", "event_id")
    week = lambda c: F.trunc(c, "week").cast("string")
    exact = rows.groupBy(week(F.col("ts").cast("date")).alias("span")).agg(F.count_distinct("user_id").alias("exact"))
    return within(spark, exact, rows, F.col("ts"), week("day"), "user_id", F.col("event_id") % 2 == 0)


@query(
    "a6_sessions",
    "SELECT user_id, CAST(min(ts) AS VARCHAR) AS created_at, CAST(max(ts) AS VARCHAR) AS last_used, count(*) AS requests FROM events GROUP BY user_id",
)
def a6_sessions(spark, sf):
    per_key = stats.sessions(table(spark, sf, "events"), "user_id", "ts")
    return per_key.select(
        "user_id", F.col("created_at").cast("string").alias("created_at"), F.col("last_used").cast("string").alias("last_used"), "requests"
    )


@query(
    "a6_session_stats",
    """WITH s AS (SELECT user_id, max(ts) AS last_used, count(*) AS requests FROM events GROUP BY user_id), m AS (SELECT max(ts) AS now FROM events)
SELECT count(*) AS sessions, count(*) FILTER (now-last_used < INTERVAL 6 HOURS) AS active, round(coalesce(avg(requests) FILTER (now-last_used < INTERVAL 6 HOURS), 0),6) AS mean_requests FROM s, m""",
)
def a6(spark, sf):
    events = table(spark, sf, "events")
    now = events.agg(F.max("ts").alias("now")).scalar()
    out = stats.session_stats(stats.sessions(events, "user_id", "ts"), now, 6 * 3600)
    return out.withColumn("mean_requests", F.round("mean_requests", 6))


@query(
    "a7_source_health",
    """WITH p AS (SELECT event_type AS source, count(*) AS probes, count(*) FILTER (event_type='error' OR value<1) AS failures, avg(value) FILTER (event_type<>'error' AND value>=1) AS mean_time FROM events GROUP BY event_type)
SELECT source, probes, failures, round(mean_time,6) AS mean_time, mean_time IS NOT NULL AS healthy, rank, rank=1 AS chosen
FROM (SELECT *, CAST(row_number() OVER (ORDER BY mean_time IS NULL, mean_time, source) AS INT) AS rank FROM p) x""",
)
def a7(spark, sf):
    ok = (F.col("event_type") != "error") & (F.col("value") >= 1)
    out = stats.source_health(table(spark, sf, "events"), "event_type", ok, F.col("value"), ["click", "purchase", "signup", "view"])
    return out.withColumn("mean_time", F.round("mean_time", 6))


@query(
    "a8_longest_link",
    f"""SELECT page_id, max_by(link, struct_pack(n := length(link), p := -i)) AS link FROM (SELECT page_id, unnest(f) AS link, generate_subscripts(f,1) AS i FROM (SELECT page_id, regexp_extract_all(html, '{LINK_PATTERN}', 1) AS f FROM pages) a) b GROUP BY page_id""",
)
def a8(spark, sf):
    found = X.links(F.col("html"), LINK_PATTERN, 1)
    longest = X.longest_link(found).alias("link")
    return table(spark, sf, "pages").select("page_id", longest).where(F.col("link").isNotNull())


_MEDIA = f"regexp_matches(lower(path), '\\.({'|'.join(rules.MEDIA_SUFFIXES)})$')"
_BLOCKED = S.any_of("lower(path)", *rules.BLOCKED_FILE_KEYWORDS)


@query(
    "a9_main_item",
    f"""SELECT work_id, first(path ORDER BY bytes DESC, path) AS path, max(bytes) AS bytes FROM v_item WHERE {_MEDIA} AND NOT {_BLOCKED} GROUP BY work_id""",
)
def a9(spark, sf):
    return stats.main_item(table(spark, sf, "v_item"), ["work_id"], "path", "bytes").drop("weight")


@query(
    "a9_main_item_weighted",
    f"""WITH w AS (SELECT group_id, concat(path, CASE WHEN episode%2=0 THEN '.1080p.mkv' ELSE '.sample.mkv' END) AS path, bytes, bytes*(CASE WHEN episode%2=0 THEN 1.5::DOUBLE ELSE 1.0 END)*(CASE WHEN episode%2=0 THEN 1.0 ELSE 0.1::DOUBLE END) AS weight FROM v_item)
SELECT group_id, first(path ORDER BY weight DESC, path) AS path, first(bytes ORDER BY weight DESC, path) AS bytes, round(max(weight),3) AS weight FROM w GROUP BY group_id""",
)
def a9_weighted(spark, sf):
    tail = F.when(F.col("episode") % 2 == 0, ".1080p.mkv").otherwise(".sample.mkv")
    items = table(spark, sf, "v_item").withColumn("path", F.concat("path", tail))
    return stats.main_item(items, ["group_id"], "path", "bytes", weighted=True).withColumn("weight", F.round("weight", 3))


@query(
    "a10_nested_by_work",
    """SELECT work_id, CAST(floor(('0x'||substr(md5(row_key),1,8))::BIGINT*4/4294967296.0) AS BIGINT) AS part, CAST(count(*) AS INT) AS entries, string_agg(row_key, ',' ORDER BY row_key) AS row_keys
FROM v_listing GROUP BY 1, 2""",
)
def a10(spark, sf):
    rows = table(spark, sf, "v_listing").select("work_id", "row_key", "raw_title")
    nested = stats.nested_by_work(rows, "work_id", ["row_key"], ["raw_title"], parts=4)
    keys = F.array_join(F.transform("entries", lambda e: e["row_key"]), ",")
    return nested.select("work_id", "part", F.size("entries").alias("entries"), keys.alias("row_keys"))


@query("a10_flattened", "SELECT work_id, row_key, raw_title FROM v_listing")
def a10_flat(spark, sf):
    rows = table(spark, sf, "v_listing").select("work_id", "row_key", "raw_title")
    return stats.flattened(stats.nested_by_work(rows, "work_id", ["row_key"], ["raw_title"], parts=4), "work_id")


@query(
    "a11_search_report",
    f"""WITH {SEARCH_SQL},
m AS (SELECT query_id, count(*) AS matched, count(*) FILTER (tier='2160p') AS tier_2160p, count(*) FILTER (tier='1080p') AS tier_1080p, count(*) FILTER (tier='720p') AS tier_720p, count(*) FILTER (tier='HD') AS tier_hd FROM scored GROUP BY query_id),
k AS (SELECT query_id, count(*) AS kept, string_agg(DISTINCT tier, ',' ORDER BY tier) AS tiers, count(*) FILTER (contains(link,'&n=1')) AS complete_links, avg(length(link)) AS mean_link_length FROM best GROUP BY query_id)
SELECT query_id, matched, tier_2160p, tier_1080p, tier_720p, tier_hd, kept, tiers, complete_links, round(mean_link_length,6) AS mean_link_length,
 (SELECT count(*) FROM v_listing) AS total, round(matched*100.0/(SELECT count(*) FROM v_listing),6) AS match_rate FROM m JOIN k USING (query_id)""",
)
def a11(spark, sf):
    out = search.report(table(spark, sf, "v_query"), search.searchable(table(spark, sf, "v_listing")), "&n=1")
    return out.withColumn("mean_link_length", F.round("mean_link_length", 6)).withColumn("match_rate", F.round("match_rate", 6))
