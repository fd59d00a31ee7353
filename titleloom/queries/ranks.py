"""Top-k, upsert, order and change points."""

from pyspark.sql import functions as F

from titleloom import rules
from titleloom.functions import attributes as A
from titleloom.operators import rank
from titleloom.plans import curated, delivery, search
from titleloom.queries import sqltext as S
from titleloom.queries.base import query, table
from titleloom.queries.joins import _CLEAN_TITLES
from titleloom.sources.pages import first_of_source

SEARCH_SQL = f"""{S.search_tables('SELECT query_id, title FROM v_query', _CLEAN_TITLES)},
l AS (SELECT row_key, link, {S.cleaned('raw_title')} AS title, {S.tier('raw_title')} AS tier, CAST(coalesce(seeders,0) AS BIGINT) AS seeders, {S.size_bytes('size_text')} AS size_bytes FROM v_listing),
scored AS (SELECT query_id, row_key, link, l.title, tier, seeders, size_bytes, match_type, confidence, {S.score('tier', 'confidence', 'l.title', 'seeders')} AS relevance_score FROM linked JOIN l USING (title)),
best AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, tier ORDER BY confidence DESC, relevance_score DESC, seeders DESC, size_bytes DESC, row_key) AS INT) AS rank FROM scored) x WHERE rank<=3)"""


BEST_SQL = f"""WITH {SEARCH_SQL} SELECT query_id, tier, rank, row_key, title, match_type, round(confidence,6) AS confidence, relevance_score, seeders, size_bytes,
 CASE tier WHEN '2160p' THEN 1 WHEN '1080p' THEN 2 WHEN '720p' THEN 3 ELSE 4 END AS tier_order FROM best"""


@query("w1_best_per_tier", BEST_SQL)
def w1(spark, sf):
    best = search.best_matches(table(spark, sf, "v_query"), search.searchable(table(spark, sf, "v_listing")))
    return best.select(
        "query_id", "tier", "rank", "row_key", "title", "match_type", F.round("confidence", 6).alias("confidence"),
        "relevance_score", "seeders", "size_bytes", "tier_order",
    )


_BASE = "CASE WHEN regexp_matches(string_split(composite_id,':')[1], '^tt\\d+$') THEN string_split(composite_id,':')[1] ELSE composite_id END"


def _upsert_sql(keys: str) -> str:
    packed = "struct_pack(a := arrived_at, k := row_key)"
    return f"""SELECT {keys}, max_by(row_key, {packed}) AS row_key, max_by(raw_title, {packed}) AS raw_title, min({packed}).k AS first_row
FROM (SELECT {_BASE} AS work_id, link, listing_id, row_key, raw_title, arrived_at FROM v_listing) x GROUP BY {keys}"""


def _upsert(spark, sf, keys):
    rows = table(spark, sf, "v_listing").withColumn("work_id", A.base_id(F.col("composite_id")))
    kept = rank.keyed_upsert(rows.select(*keys, "row_key", "raw_title", "arrived_at"), keys, ["arrived_at", "row_key"])
    return kept.select(*keys, "row_key", "raw_title", F.col("first_arrival.row_key").alias("first_row"))


@query("w2_keyed_upsert", _upsert_sql("work_id, link"))
def w2(spark, sf):
    return _upsert(spark, sf, ["work_id", "link"])


@query("w2_upsert_by_listing", _upsert_sql("listing_id"))
def w2_listing(spark, sf):
    return _upsert(spark, sf, ["listing_id"])


@query(
    "w2_curated_catalogue",
    f"""WITH c AS (SELECT {_BASE} AS work_id, link, row_key, {S.curated_tier('raw_title')} AS tier, seeders, arrived_at FROM v_listing),
g AS (SELECT * FROM c WHERE tier IN ('4K','1080p','720p','SD') AND coalesce(seeders,0)>0)
SELECT work_id, link, max_by(row_key, struct_pack(a := arrived_at, k := row_key)) AS row_key FROM g GROUP BY work_id, link""",
)
def w2_curated(spark, sf):
    listings = table(spark, sf, "v_listing").select("composite_id", "raw_title", "link", "seeders", "row_key", "arrived_at")
    return curated.curate(listings, "cat:?", ["arrived_at", "row_key"]).select("work_id", "link", "row_key")


@query(
    "w3_catalogue_order",
    f"""SELECT work_id, row_key, row_number() OVER (PARTITION BY work_id ORDER BY CASE {S.curated_tier('raw_title')} WHEN '4K' THEN 4 WHEN '1080p' THEN 3 WHEN '720p' THEN 2 WHEN 'SD' THEN 1 ELSE 0 END DESC, coalesce(seeders,0) DESC, raw_title, row_key) AS place
FROM v_listing""",
)
def w3(spark, sf):
    title = F.col("raw_title")
    rows = table(spark, sf, "v_listing").select(
        "work_id", "row_key", "raw_title",
        (-A.table_value(A.curated_tier(title), rules.CURATED_TIER_SCORE, 0)).alias("tier_place"),
        (-F.coalesce("seeders", F.lit(0))).alias("seeds_place"),
    )
    tie = [F.collate(title, "UNICODE"), F.col("row_key")]
    return rank.positions_within(rows, ["work_id"], ["tier_place", "seeds_place"], tie, "place").select("work_id", "row_key", "place")


_FOUND = """SELECT work_id, item_key, content_hash, raw_title, seeders FROM v_item JOIN v_store USING (content_hash) WHERE work_id IN (SELECT work_id FROM v_request)"""


@query(
    "w4_delivery_answer",
    f"""SELECT * FROM (SELECT work_id, item_key, tier, available, CAST(row_number() OVER (PARTITION BY work_id ORDER BY CASE tier WHEN '2160p' THEN 6 WHEN '1080p' THEN 5 WHEN '720p' THEN 4 WHEN '480p' THEN 3 ELSE 2 END DESC, seeders DESC NULLS FIRST, item_key) AS INT) AS rank
 FROM (SELECT f.*, {S.simple_tier('raw_title')} AS tier, coalesce(s.status='downloaded', false) AS available FROM ({_FOUND}) f LEFT JOIN v_status s ON lower(s.content_hash)=f.content_hash) y) z WHERE rank<=15""",
)
def w4(spark, sf):
    items = table(spark, sf, "v_item").withColumnRenamed("bytes", "item_bytes")
    found = delivery.answer(
        table(spark, sf, "v_request").select("work_id").distinct(), items, table(spark, sf, "v_store"), table(spark, sf, "v_status"),
        ["work_id"], ["item_key"],
    )
    return found.select("work_id", "item_key", "tier", "available", "rank")


@query(
    "w5_score_order",
    f"""WITH t AS (SELECT DISTINCT raw_title FROM v_listing),
p AS (SELECT DISTINCT query_id, raw_title FROM (SELECT query_id, unnest(string_split(lower(title),' ')) AS word FROM v_query) w JOIN t ON length(word)>2 AND contains(lower(raw_title), word)),
s AS (SELECT query_id, row_key, {S.tier_score('raw_title')} + coalesce(seeders,0)/100 AS score FROM p JOIN v_listing USING (raw_title))
SELECT query_id, row_key, round(score, 6) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_key) AS INT) AS rank FROM s) x WHERE rank<=20""",
)
def w5(spark, sf):
    title = F.col("raw_title")
    listings = table(spark, sf, "v_listing").select(
        "row_key", title.alias("title"), rank.indexer_score(title, F.col("seeders")).alias("score")
    )
    best = search.any_word_search(table(spark, sf, "v_query"), listings)
    return best.select("query_id", "row_key", F.round("score", 6).alias("score"), "rank")


@query(
    "w6_source_cap",
    """SELECT provider, row_key, rank, rank<=10 AS saved FROM (SELECT provider, row_key, CAST(row_number() OVER (PARTITION BY provider ORDER BY arrived_at, row_key) AS INT) AS rank FROM v_listing) x WHERE rank<=20""",
)
def w6(spark, sf):
    first = first_of_source(table(spark, sf, "v_listing"), "provider", ["arrived_at", "row_key"])
    return first.select("provider", "row_key", "rank", (F.col("rank") <= rules.SAVE_CAP).alias("saved"))


_S, _E, _R = S.ordinal("path")


@query(
    "w7_ordinal_order",
    f"""SELECT group_id, item_key, row_number() OVER (PARTITION BY group_id ORDER BY {_S}, {_E}, item_key) AS place FROM v_item""",
)
def w7(spark, sf):
    items = table(spark, sf, "v_item").select("group_id", "item_key", A.ordinal(F.col("path")).alias("o"))
    items = items.select("group_id", "item_key", F.col("o.season").alias("s"), F.col("o.episode").alias("e"))
    return rank.positions_within(items, ["group_id"], ["s", "e"], ["item_key"], "place").select("group_id", "item_key", "place")


@query(
    "w8_change_points",
    """SELECT job_id, event_id, status, progress FROM (SELECT *, lag(status) OVER w AS ps, lag(progress) OVER w AS pp, row_number() OVER w AS n
 FROM v_job WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id)) x WHERE n=1 OR status IS DISTINCT FROM ps OR progress IS DISTINCT FROM pp""",
)
def w8(spark, sf):
    changed = rank.change_points(
        table(spark, sf, "v_job"), "job_id", ["ts", "event_id"], ["status", "progress"], F.date_trunc("day", "ts")
    )
    return changed.select("job_id", "event_id", "status", "progress")


@query(
    "w8_status_changes",
    """SELECT job_id, event_id, status FROM (SELECT *, lag(status) OVER w AS ps, row_number() OVER w AS n
 FROM v_job WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id)) x WHERE n=1 OR status IS DISTINCT FROM ps""",
)
def w8_status(spark, sf):
    jobs = table(spark, sf, "v_job")
    return rank.change_points(jobs, "job_id", ["ts", "event_id"], ["status"], F.date_trunc("day", "ts")).select("job_id", "event_id", "status")


@query(
    "w9_top_seeders",
    """SELECT provider, row_key, seeders, rank FROM (SELECT provider, row_key, seeders, CAST(row_number() OVER (PARTITION BY provider ORDER BY seeders DESC NULLS FIRST, row_key) AS INT) AS rank FROM v_listing) x WHERE rank<=500""",
)
def w9(spark, sf):
    order = [F.col("seeders").desc_nulls_first(), F.col("row_key").asc()]
    rows = table(spark, sf, "v_listing").select("provider", "row_key", "seeders")
    return rank.top_k(rows, ["provider"], order, rules.LOOKUP_LIMIT)


@query(
    "e3_curated_search",
    f"""WITH c AS (SELECT {_BASE} AS work_id, link, row_key, raw_title, {S.curated_tier('raw_title')} AS tier, seeders, arrived_at FROM v_listing),
v AS (SELECT work_id, link, max_by(struct_pack(k := row_key, t := raw_title, q := tier, s := seeders), struct_pack(a := arrived_at, k := row_key)) AS r FROM c WHERE tier IN ('4K','1080p','720p','SD') AND coalesce(seeders,0)>0 GROUP BY work_id, link),
g AS (SELECT work_id, r.k AS row_key, r.t AS raw_title, r.q AS tier, r.s AS seeders FROM v),
hit AS (SELECT DISTINCT request_id FROM v_request r JOIN g ON r.work_id=g.work_id),
every AS (SELECT request_id, g.*, 'id' AS via FROM v_request r JOIN g ON r.work_id=g.work_id
 UNION ALL SELECT request_id, g.*, 'title' AS via FROM (SELECT * FROM v_request WHERE request_id NOT IN (SELECT request_id FROM hit)) r JOIN g ON contains(lower(raw_title), lower(wanted)))
SELECT request_id, row_key, via, row_number() OVER (PARTITION BY request_id ORDER BY CASE tier WHEN '4K' THEN 4 WHEN '1080p' THEN 3 WHEN '720p' THEN 2 ELSE 1 END DESC, seeders DESC, raw_title, row_key) AS place FROM every""",
)
def e3(spark, sf):
    """The curated catalogue searched by id, then by title, each request's hits in catalogue order."""
    listings = table(spark, sf, "v_listing").select("composite_id", "raw_title", "link", "seeders", "row_key", "arrived_at")
    catalogue = curated.curate(listings, "cat:?", ["arrived_at", "row_key"])
    found = curated.search_places(table(spark, sf, "v_request"), catalogue, collation="UTF8_BINARY")
    return found.select("request_id", "row_key", "via", "place")
