"""Catalogue documents, payloads, pages and keyed tables."""

from pyspark.sql import functions as F

from titleloom import schemas
from titleloom.functions import attributes as A
from titleloom.functions import text as X
from titleloom.operators import lookup
from titleloom.plans import search
from titleloom.queries import sqltext as S
from titleloom.queries.base import query, table
from titleloom.queries.columns import LINK_PATTERN
from titleloom.queries.ranks import _upsert_sql
from titleloom.sources import catalogue, keyed, pages, payloads
from titleloom.workspace import new_folder

SITE_RULES = (
    {"tld": "com", "priority": 3, "title_regex": "<h1>(.*?)</h1>", "link_regex": 'href="([^"]+)"'},
    {"tld": "net", "priority": 2, "title_regex": "<title>(.*?)</title>", "link_regex": 'href="([^"]+)"'},
    {"tld": "org", "priority": 4, "title_regex": "<h1>(.*?)</h1>", "link_regex": 'href="([^"]+)"'},
)
POST_LINK = r"""cat:\?[^"'\s<>]+"""
AS_OF = "2002-01-01 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def catalogue_documents(spark, sf):
    """One JSON catalogue document per listing; unset dates on line number 7.

    A document per order would gather a hot order in one row.
    """
    entry = F.struct(
        F.col("composite_id").alias("imdbId"), F.col("raw_title").alias("title"), F.col("link").alias("magnet"),
        A.curated_tier(F.col("raw_title")).alias("quality"), (F.col("seeders") - 5).cast("bigint").alias("seeds"),
        F.col("size_text").alias("size"), F.lit("any").alias("category"),
        A.language_tag(F.col("raw_title")).alias("language"),
        F.when(F.col("seeders").isNotNull(), F.date_format("arrived_at", "yyyy-MM-dd'T'HH:mm:ss")).alias("addedAt"),
    )
    document = F.to_json(F.struct(F.lit("1.0.0").alias("version"), F.array(entry).alias("magnets")))
    return table(spark, sf, "v_listing").select(document.alias("document"))


@query(
    "s1_read_catalogue",
    f"""WITH x AS (SELECT composite_id, raw_title, link, seeders-5 AS seeds, seeders, arrived_at, {S.curated_tier('raw_title')} AS tier FROM v_listing)
SELECT composite_id AS work_id, raw_title AS title, link, tier, CAST(seeds AS BIGINT) AS seeds,
 strftime(CASE WHEN seeders IS NULL THEN TIMESTAMP '{AS_OF}' ELSE arrived_at END, '%Y-%m-%d %H:%M:%S') AS added_at,
 coalesce(seeds,0)<>0 AND tier IN ('4K','1080p','720p','SD') AND seeds>=0 AS is_good FROM x""",
)
def s1(spark, sf):
    documents = catalogue_documents(spark, sf).select(F.from_json("document", schemas.CATALOGUE).alias("d"))
    gated = catalogue.curated_gate(catalogue.entries_of(documents, "d.magnets", as_of()), "cat:?")
    return gated.select(
        F.col("imdbId").alias("work_id"), "title", F.col("magnet").alias("link"), F.col("quality").alias("tier"), "seeds",
        F.date_format("addedAt", "yyyy-MM-dd HH:mm:ss").alias("added_at"), (F.size("failures") == 0).alias("is_good"),
    )


@query(
    "s1_event_documents",
    """SELECT event_id, TRY_CAST(json_extract_string(props,'$.k') AS BIGINT) AS k, TRY_CAST(json_extract_string(props,'$.k') AS BIGINT) IS NOT NULL AS is_good FROM events""",
)
def s1_events(spark, sf):
    parsed = F.from_json("props", "k BIGINT")
    return table(spark, sf, "events").select("event_id", parsed["k"].alias("k"), parsed["k"].isNotNull().alias("is_good"))


@query(
    "s1_catalogue_files",
    f"""WITH x AS (SELECT composite_id, raw_title, seeders-5 AS seeds, size_text, {S.curated_tier('raw_title')} AS tier FROM v_listing)
SELECT composite_id AS work_id, raw_title AS title, CASE WHEN coalesce(seeds,0)=0 THEN 'missing:seeds' WHEN tier NOT IN ('4K','1080p','720p','SD') THEN 'tier' WHEN seeds<0 THEN 'negative_seeds' ELSE 'good' END AS outcome FROM x WHERE size_text IS NOT NULL
UNION ALL SELECT NULL, NULL, 'document' FROM x WHERE size_text IS NULL""",
)
def s1_files(spark, sf):
    """Documents written as files, those without a size cut short; read as good and quarantined rows."""
    path = new_folder(spark, "documents")
    whole = catalogue_documents(spark, sf)
    cut = F.when(F.contains("document", F.lit('"size":')), F.col("document")).otherwise(F.substring("document", 1, 30))
    whole.select(cut).write.text(path)
    good, bad = catalogue.read_catalogue(spark, path, as_of(), "cat:?", multi_line=False)
    every = good.withColumn("first_failure", F.lit("good")).unionByName(bad.drop("failures"), allowMissingColumns=True)
    return every.select(F.col("imdbId").alias("work_id"), "title", F.col("first_failure").alias("outcome"))


@query("s2_append_catalogue", _upsert_sql("work_id, link"))
def s2(spark, sf):
    """Append in two writes, read back, resolve duplicates: the same as W2 on all rows."""
    path = new_folder(spark, "catalogue")
    rows = table(spark, sf, "v_listing").select("composite_id", "link", "row_key", "raw_title", "arrived_at")
    rows = rows.withColumn("type", F.when(F.contains("composite_id", F.lit(":")), "series").otherwise("movie"))
    split = F.lit("1998-01-01").cast("timestamp_ntz")
    catalogue.append_catalogue(rows.where(F.col("arrived_at") >= split), path)
    catalogue.append_catalogue(rows.where(F.col("arrived_at") < split), path)
    stored = spark.read.schema(rows.schema).parquet(path).withColumnRenamed("composite_id", "work_id")
    current = catalogue.load_catalogue(stored.drop("type"), "work_id", "link", ["arrived_at", "row_key"])
    return current.select("work_id", "link", "row_key", "raw_title", F.col("first_arrival.row_key").alias("first_row"))


def search_payloads(spark, sf):
    """One search payload per listing, with its provider's base."""
    result = F.struct(
        F.col("row_key").alias("info_hash"),
        F.when(F.col("seeders").isNotNull() | F.contains("raw_title", F.lit("Dual")), F.col("raw_title")).alias("title"),
        F.col("link").alias("magnet_link"), (F.col("seeders") - 1).alias("seed_count"), F.col("size_text").alias("size"),
        F.date_format("arrived_at", "yyyy-MM-dd'T'HH:mm:ss").alias("date"),
    )
    payload = F.to_json(F.struct(F.array(result).alias("results"), F.lit(1).alias("count"))).alias("payload")
    rows = table(spark, sf, "v_listing").select("provider", payload)
    return rows.join(table(spark, sf, "v_source_base"), "provider", "left")


_MAPPED = f"""row_key AS source_row, {S.cleaned('raw_title')} AS title, link,
 CAST(coalesce(nullif(seeders-1,0), round(coalesce(base,30)*{S.multiplier('tier')})) AS BIGINT) AS seeders, CAST(0 AS BIGINT) AS leechers,
 coalesce(size_text,'Size not specified') AS size_text, {S.size_bytes('size_text')} AS size_bytes, tier, provider,
 {S.language('raw_title')} AS language, {S.season('raw_title')} AS season, strftime(arrived_at, '%Y-%m-%d %H:%M:%S') AS updated_at"""


@query(
    "s3_search_payload",
    f"""SELECT {_MAPPED} FROM (SELECT *, {S.tier('raw_title')} AS tier FROM v_listing WHERE seeders IS NOT NULL OR contains(raw_title,'Dual')) l LEFT JOIN v_source_base USING (provider)""",
)
def s3(spark, sf):
    out = payloads.from_search_payload(search_payloads(spark, sf), "payload", as_of())
    return out.withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss")).drop(
        "type", "relevance_score", "confidence"
    )


def post_payloads(spark, sf):
    """One array with one post per listing; size and link are in the content."""
    rendered = F.concat(
        F.lit("<p>"), F.coalesce("size_text", F.lit("n/a")), F.lit('</p><a href="'), F.col("link"), F.lit('">get</a>')
    )
    post = F.struct(
        F.date_format("arrived_at", "yyyy-MM-dd'T'HH:mm:ss").alias("modified"),
        F.struct(F.col("raw_title").alias("rendered")).alias("title"),
        F.struct(rendered.alias("rendered")).alias("content"),
    )
    rows = table(spark, sf, "v_listing").select("provider", F.to_json(F.array(post)).alias("payload"))
    return rows.join(table(spark, sf, "v_source_base"), "provider", "left")


def posts(spark, sf):
    return payloads.from_post_payload(
        post_payloads(spark, sf), "payload", link=POST_LINK, markers=("id=", "&dn="), fallbacks=(POST_LINK,)
    )


@query(
    "s4_post_payload",
    f"""SELECT {S.cleaned('raw_title')} AS title, link, CAST(round(coalesce(base,30)*{S.multiplier('tier')}) AS BIGINT) AS seeders,
 coalesce(size_text,'Size not specified') AS size_text, {S.size_bytes('size_text')} AS size_bytes, tier, provider,
 {S.language('raw_title')} AS language, {S.season('raw_title')} AS season, strftime(arrived_at, '%Y-%m-%d %H:%M:%S') AS updated_at
FROM (SELECT *, {S.tier('raw_title')} AS tier FROM v_listing WHERE length(raw_title)>=5) l LEFT JOIN v_source_base USING (provider)""",
)
def s4(spark, sf):
    return posts(spark, sf).select(
        "title", "link", "seeders", "size_text", "size_bytes", "tier", "provider", "language", "season",
        F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"),
    )


_PLAIN = (
    "replace(replace(replace(replace(replace(regexp_replace({x}, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"
)


def _plain_sql(x: str) -> str:
    return rf"regexp_replace({_PLAIN.replace('{x}', x)}, '^\s+|\s+$', '', 'g')"


@query(
    "s5_extract_items",
    f"""WITH v_site_rule AS (SELECT * FROM (VALUES ('com',3,'<h1>(.*?)</h1>'),('net',2,'<title>(.*?)</title>'),('org',4,'<h1>(.*?)</h1>')) t(tld,priority,rule)),
p AS (SELECT page_id, html, regexp_extract(url, '^[a-z]+://[^/?#]*\\.([a-z]+)', 1) AS tld FROM pages),
m AS (SELECT page_id, tld, priority, CASE tld WHEN 'net' THEN regexp_extract_all(html,'(?s)<title>(.*?)</title>',1) ELSE regexp_extract_all(html,'(?s)<h1>(.*?)</h1>',1) END AS titles, regexp_extract_all(html,'{LINK_PATTERN}',1) AS urls FROM p JOIN v_site_rule USING (tld)),
e AS (SELECT page_id, tld, priority, unnest(titles) AS t, generate_subscripts(titles,1) AS i, urls FROM m)
SELECT page_id, tld, priority, CAST(i-1 AS INT) AS position, {_plain_sql('t')} AS title, urls[i] AS link FROM e WHERE length({_plain_sql('t')})>=5""",
)
def s5(spark, sf):
    return pages.extract_items(table(spark, sf, "pages"), SITE_RULES)


ITEM_RULES = (
    {"tld": "com", "priority": 3, "item_regex": "<li>(.*?)</li>", "title_regex": "<a[^>]*>(.*?)</a>", "link_regex": 'href="([^"]+)"'},
    {"tld": "net", "priority": 2, "item_regex": "<article>(.*?)</article>", "title_regex": "<h1>(.*?)</h1>", "link_regex": 'href="([^"]+)"'},
    {"tld": "org", "priority": 4, "item_regex": "<li>(.*?)</li>", "title_regex": "<a[^>]*>(.*?)</a>", "link_regex": 'href="([^"]+)"'},
)
_ITEMS = f"""p AS (SELECT page_id, html, regexp_extract(url, '^[a-z]+://[^/?#]*\\.([a-z]+)', 1) AS tld FROM pages),
m AS (SELECT page_id, tld, CASE tld WHEN 'net' THEN 2 WHEN 'com' THEN 3 ELSE 4 END AS priority, CASE tld WHEN 'net' THEN regexp_extract_all(html,'(?s)<article>(.*?)</article>',1) ELSE regexp_extract_all(html,'(?s)<li>(.*?)</li>',1) END AS items FROM p WHERE tld IN ('com','net','org')),
e AS (SELECT page_id, tld, priority, unnest(items) AS t, generate_subscripts(items,1) AS i FROM m),
f AS (SELECT page_id, tld, priority, i, CASE tld WHEN 'net' THEN regexp_extract(t,'(?s)<h1>(.*?)</h1>',1) ELSE regexp_extract(t,'(?s)<a[^>]*>(.*?)</a>',1) END AS raw, nullif(regexp_extract(t,'{LINK_PATTERN}',1),'') AS link FROM e),
items AS (SELECT page_id, tld, priority, CAST(i-1 AS INT) AS position, {_plain_sql('raw')} AS title, link FROM f WHERE length({_plain_sql('raw')})>=5)"""


@query("s5_items_inside", f"WITH {_ITEMS} SELECT * FROM items")
def s5_inside(spark, sf):
    """Navigation links are items of their own or lie outside the item: they shift nothing."""
    return pages.extract_items(table(spark, sf, "pages"), ITEM_RULES)


_PAGE_TITLE = S.collapsed(
    r"regexp_replace(regexp_replace(" + _plain_sql("regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1)") + r", '- IMDb$', ''), '\(\d{4}\)', '')"
)


@query("s6_page_title", f"SELECT page_id, {_PAGE_TITLE} AS title FROM pages")
def s6(spark, sf):
    return table(spark, sf, "pages").select("page_id", pages.page_title(F.col("html")).alias("title"))


@query(
    "s7_localized_title",
    f"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]+/([a-z]{{2}})/', 1) AS language, {_PAGE_TITLE} AS title FROM pages)
SELECT host, language, title FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY CASE language WHEN 'fr' THEN 1 ELSE 2 END, page_id) AS n FROM p WHERE language IN ('fr','en') AND title<>'') x WHERE n=1""",
)
def s7(spark, sf):
    rows = table(spark, sf, "pages").select(
        "page_id", pages.page_host(F.col("url")).alias("host"), pages.page_language(F.col("url")).alias("language"),
        pages.page_title(F.col("html")).alias("title"),
    )
    return pages.localized_title(rows, "host", "language", "title", ["fr", "en"], "page_id")


@query(
    "s8_gather",
    f"""SELECT provider, {S.cleaned('raw_title')} AS title, link, row_key AS source_row FROM v_listing WHERE seeders IS NOT NULL OR contains(raw_title,'Dual')
UNION ALL SELECT provider, {S.cleaned('raw_title')}, link, NULL FROM v_listing WHERE length(raw_title)>=5
UNION ALL SELECT provider, {S.cleaned('raw_title')}, NULL, row_key FROM v_listing""",
)
def s8(spark, sf):
    searched = payloads.from_search_payload(search_payloads(spark, sf), "payload", as_of())
    crawled = table(spark, sf, "v_listing").select(
        "provider", X.clean_listing_title(F.col("raw_title")).alias("title"), F.col("row_key").alias("source_row")
    )
    every = payloads.gather(searched, posts(spark, sf), None, payloads.empty_listings(spark), crawled)
    return every.select("provider", "title", "link", "source_row")


_GOOD = "SELECT provider, row_key AS source_row FROM v_listing WHERE seeders IS NOT NULL"


def some_fail(spark, sf):
    """Four sources: two that can be read, one that is not there, one that breaks off in the middle."""
    rows = table(spark, sf, "v_listing").select("provider", F.col("row_key").alias("source_row"), "seeders")
    broken = rows.withColumn("provider", F.when(F.col("seeders") > 40, F.raise_error(F.lit("connection reset"))).otherwise(F.col("provider")))
    sources = {
        "few": lambda: rows.where("seeders < 25"), "missing": lambda: spark.read.parquet(f"{sf}/no_such_source.parquet"),
        "broken": lambda: broken, "many": lambda: rows.where("seeders >= 25").drop("seeders"),
    }
    return payloads.gather_sources(spark, sources, rows.drop("seeders").schema)


@query("s8_gather_with_failures", _GOOD)
def s8_failures(spark, sf):
    return some_fail(spark, sf)[0]


@query(
    "s8_source_report",
    """SELECT 'few' AS source, true AS ok, count(*) AS rows FROM v_listing WHERE seeders < 25
UNION ALL SELECT 'many', true, count(*) FROM v_listing WHERE seeders >= 25 UNION ALL SELECT 'missing', false, 0 UNION ALL SELECT 'broken', false, 0""",
)
def s8_report(spark, sf):
    return some_fail(spark, sf)[1].drop("error")


@query(
    "s9_bucketed_join",
    """SELECT i.content_hash, item_key, row_key, seeders FROM v_item i JOIN v_store USING (content_hash)""",
)
def s9_bucketed(spark, sf):
    """Items and their listings, both stored by content hash: the join moves neither."""
    items, listings = bucketed(spark, sf)
    return items.join(listings, "content_hash").select("content_hash", "item_key", "row_key", "seeders")


@query("j9_orphans_bucketed", "SELECT item_key FROM v_item WHERE content_hash NOT IN (SELECT content_hash FROM v_store WHERE seeders > 30)")
def j9_bucketed(spark, sf):
    """Items whose listing is not among the well-seeded ones, both sides stored by content hash."""
    items, listings = bucketed(spark, sf)
    return lookup.orphans(items, listings.where("seeders > 30"), "content_hash").select("item_key")


def bucketed(spark, sf):
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = (keyed.write_keyed(table(spark, sf, view), view, ["content_hash"], buckets) for view in ("v_item", "v_store"))
    return [spark.table(name).hint("merge") for name in names]  # both may be large


@query(
    "s9_keyed_tables",
    f"""SELECT content_hash, row_key AS source_id, raw_title AS title, size_bytes, CASE WHEN regexp_matches(composite_id, '^tt\\d+:\\d+:\\d+$') THEN 'series' ELSE 'movie' END AS type,
 strftime(arrived_at, '%Y-%m-%d %H:%M:%S') AS uploaded_at, CAST(seeders AS INT) AS seeders, {S.language('raw_title')} AS languages, {S.tier('raw_title')} AS tier FROM v_listing""",
)
def s9(spark, sf):
    """Write the listing table with its schema, partitioned by type, and read it back."""
    path = new_folder(spark, "listing")
    catalogue.write_table(catalogue.listing_table(table(spark, sf, "v_listing")), path, schemas.LISTING, ["type"])
    stored = catalogue.read_table(spark, path, schemas.LISTING)
    return stored.select(
        "content_hash", "source_id", "title", "size_bytes", "type",
        F.date_format("uploaded_at", "yyyy-MM-dd HH:mm:ss").alias("uploaded_at"), F.col("seeders").cast("int").alias("seeders"),
        F.array_join("languages", ",").alias("languages"), "tier",
    )


_GATHERED = f"""{_ITEMS},
g AS (SELECT concat(provider,'|',source_row) AS row_key, link, title, tier, seeders, size_bytes FROM (SELECT {_MAPPED} FROM (SELECT *, {S.tier('raw_title')} AS tier FROM v_listing WHERE seeders IS NOT NULL OR contains(raw_title,'Dual')) l LEFT JOIN v_source_base USING (provider)) a
UNION ALL SELECT concat(provider,'|',link,'|',{S.cleaned('raw_title')}), link, {S.cleaned('raw_title')}, tier, CAST(round(coalesce(base,30)*{S.multiplier('tier')}) AS BIGINT), {S.size_bytes('size_text')}
 FROM (SELECT *, {S.tier('raw_title')} AS tier FROM v_listing WHERE length(raw_title)>=5) l LEFT JOIN v_source_base USING (provider)
UNION ALL SELECT concat(tld,'|',page_id,'-',position), link, {S.cleaned('title')}, tier, CAST(round(30*{S.multiplier('tier')}) AS BIGINT), {S.size_bytes('NULL')} FROM (SELECT *, {S.tier('title')} AS tier FROM items) i)"""


@query(
    "e2_search",
    f"""WITH {_GATHERED}, {S.search_tables('SELECT query_id, title FROM v_query', 'SELECT DISTINCT title FROM g')},
scored AS (SELECT query_id, row_key, g.title, tier, seeders, size_bytes, match_type, confidence, {S.score('tier', 'confidence', 'g.title', 'seeders')} AS relevance_score FROM linked JOIN g USING (title))
SELECT query_id, tier, rank, title, match_type, round(confidence,6) AS confidence, relevance_score, seeders FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, tier ORDER BY confidence DESC, relevance_score DESC, seeders DESC, size_bytes DESC, row_key) AS INT) AS rank FROM scored) x WHERE rank<=3""",
)
def e2(spark, sf):
    """Search payloads, posts and page items, gathered, linked, scored; the best three per query and tier."""
    searched = payloads.from_search_payload(search_payloads(spark, sf), "payload", as_of())
    items = pages.extract_items(table(spark, sf, "pages"), ITEM_RULES).withColumns({"provider": F.col("tld"), "base": F.lit(None).cast("int")})
    gathered = payloads.gather(searched, posts(spark, sf), payloads.from_items(items, as_of()))
    best = search.best_matches(table(spark, sf, "v_query"), search.searchable_sources(gathered))
    return best.select("query_id", "tier", "rank", "title", "match_type", F.round("confidence", 6).alias("confidence"), "relevance_score", "seeders")


@query(
    "s9_item_tables",
    """SELECT 'item' AS kind, content_hash, CAST(season AS INT) AS item_index, path AS title, bytes AS size_bytes, work_id, true AS has_item FROM v_item
UNION ALL SELECT 'attachment', content_hash, CAST(season AS INT), path, bytes, NULL, true FROM v_item WHERE path LIKE '%.txt'""",
)
def s9_items(spark, sf):
    """Write items and attachments with their schemas, read them back, and check attachments against items."""
    items_at, files_at = new_folder(spark, "items"), new_folder(spark, "attachments")
    rows = table(spark, sf, "v_item")
    catalogue.write_table(catalogue.item_table(rows), items_at, schemas.LISTING_ITEM)
    catalogue.write_table(catalogue.attachment_table(rows), files_at, schemas.ITEM_ATTACHMENT)
    items = catalogue.read_table(spark, items_at, schemas.LISTING_ITEM)
    files = catalogue.read_table(spark, files_at, schemas.ITEM_ATTACHMENT)
    lost = lookup.orphans(files, items, "item_id").select("item_id").distinct().withColumn("lost", F.lit(True))
    checked = files.join(lost, "item_id", "left").withColumn("has_item", F.col("lost").isNull())
    every = items.withColumns({"kind": F.lit("item"), "has_item": F.lit(True)}).unionByName(checked.withColumn("kind", F.lit("attachment")), allowMissingColumns=True)
    return every.select("kind", "content_hash", "item_index", "title", "size_bytes", "work_id", "has_item")
