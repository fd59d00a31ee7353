"""Linkage, lookups, enrichment, integrity."""

from pyspark.sql import functions as F

from titleloom import rules
from titleloom.functions import attributes as A
from titleloom.functions import text as X
from titleloom.operators import link, lookup
from titleloom.queries import sqltext as S
from titleloom.queries.base import query, table
from titleloom.sources import points
from titleloom.workspace import stored

_CLEAN_TITLES = f"SELECT DISTINCT {S.cleaned('raw_title')} AS title FROM v_listing"


def clean_titles(spark, sf):
    return table(spark, sf, "v_listing").select(X.clean_listing_title(F.col("raw_title")).alias("title")).distinct()


LINKED = f"WITH {S.search_tables('SELECT query_id, title FROM v_query', _CLEAN_TITLES)} SELECT query_id, title, match_type, round(confidence, 6) AS confidence FROM linked"


@query("j1_title_linkage", LINKED)
def j1(spark, sf):
    pairs = link.link_titles(table(spark, sf, "v_query"), clean_titles(spark, sf))
    return pairs.withColumn("confidence", F.round("confidence", 6))


_HEADINGS = r"SELECT DISTINCT trim(regexp_replace(regexp_extract(html, '(?is)<h1>(.*?)</h1>', 1), '\s+', ' ', 'g')) AS title FROM pages"


@query(
    "j1_heading_linkage",
    f"""WITH {S.search_tables(f"SELECT substr(md5(title),1,12) AS query_id, title FROM ({_HEADINGS}) h", _HEADINGS)}
SELECT query_id, title, match_type, round(confidence, 6) AS confidence FROM linked""",
)
def j1_pages(spark, sf):
    h1 = X.collapse_space(F.regexp_extract("html", "(?is)<h1>(.*?)</h1>", 1)).alias("title")
    headings = table(spark, sf, "pages").select(h1).distinct()
    queries = headings.withColumn("query_id", F.substring(F.md5("title"), 1, 12))
    return link.link_titles(queries, headings, tile=1024).withColumn("confidence", F.round("confidence", 6))


@query(
    "j2_substring_search",
    """WITH t AS (SELECT DISTINCT raw_title AS title FROM v_listing)
SELECT request_id, title FROM v_request JOIN t ON contains(lower(title), lower(wanted))""",
)
def j2(spark, sf):
    titles = table(spark, sf, "v_listing").select(F.col("raw_title").alias("title")).distinct()
    return link.substring_search(table(spark, sf, "v_request"), titles)


@query(
    "j3_id_then_title",
    """WITH hit AS (SELECT DISTINCT request_id FROM v_request r JOIN v_listing l ON r.work_id=l.work_id)
SELECT request_id, row_key, 'id' AS via FROM v_request r JOIN v_listing l ON r.work_id=l.work_id
UNION ALL SELECT request_id, row_key, 'title' AS via FROM (SELECT * FROM v_request WHERE request_id NOT IN (SELECT request_id FROM hit)) r
JOIN v_listing l ON contains(lower(raw_title), lower(wanted))""",
)
def j3(spark, sf):
    listings = stored(table(spark, sf, "v_listing").select("row_key", "work_id", "raw_title"), "listings")  # read four times
    return link.id_then_title(table(spark, sf, "v_request"), listings, "work_id", "raw_title").select("request_id", "row_key", "via")


def _lookup_sql(keys: str, source: str = "v_item", where: str = "") -> str:
    return f"""SELECT * FROM (SELECT {keys}, item_key, row_key, seeders, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY seeders DESC NULLS FIRST, item_key) AS INT) AS rank
 FROM (SELECT DISTINCT {keys} FROM {source}{where}) w JOIN v_item USING ({keys}) JOIN v_store USING (content_hash)) x WHERE rank<=500"""


def _lookup(spark, sf, wanted, keys, wanted_last=False):
    found = lookup.items_of_work(
        wanted, table(spark, sf, "v_item"), table(spark, sf, "v_store"), keys, limit=rules.LOOKUP_LIMIT, tie=["item_key"], wanted_last=wanted_last
    )
    return found.select(*keys, "item_key", "row_key", "seeders", "rank")


@query("j4_items_of_work", _lookup_sql("work_id", "v_request"))
def j4(spark, sf):
    return _lookup(spark, sf, table(spark, sf, "v_request"), ["work_id"])


@query(
    "j4_all_items",
    "SELECT work_id, item_key, row_key, seeders FROM v_item JOIN v_store USING (content_hash) WHERE work_id IN (SELECT work_id FROM v_request)",
)
def j4_all(spark, sf):
    items, listings = table(spark, sf, "v_item"), table(spark, sf, "v_store")
    found = lookup.items_of_work(table(spark, sf, "v_request"), items, listings, ["work_id"])
    return found.select("work_id", "item_key", "row_key", "seeders")


@query("j5_items_of_episode", _lookup_sql("work_id, season, episode"))
def j5(spark, sf):
    return _lookup(spark, sf, table(spark, sf, "v_item"), ["work_id", "season", "episode"], wanted_last=True)


@query("j6_items_of_alternate_id", _lookup_sql("group_id, episode"))
def j6(spark, sf):
    return _lookup(spark, sf, table(spark, sf, "v_item"), ["group_id", "episode"], wanted_last=True)


@query("j7_fetch_by_key", "SELECT row_key, content_hash FROM v_listing WHERE content_hash IN (SELECT lower(content_hash) FROM v_status WHERE status='downloaded')")
def j7(spark, sf):
    wanted = table(spark, sf, "v_status").where(F.col("status") == "downloaded")
    wanted = wanted.select(F.lower("content_hash").alias("content_hash"))
    return lookup.fetch(table(spark, sf, "v_listing"), wanted, "content_hash").select("row_key", "content_hash")


@query(
    "j7_point_reads",
    """SELECT row_key, content_hash FROM v_listing WHERE content_hash IN (SELECT md5(concat('o',o_orderkey)) FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100)""",
)
def j7_points(spark, sf):
    """Listings of the hundred dearest orders, read by key from the stored catalogue."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = points.write_points(table(spark, sf, "v_listing").select("row_key", "content_hash"), "catalogue", "content_hash", buckets)
    dearest = table(spark, sf, "orders").orderBy(F.col("o_totalprice").desc(), F.col("o_orderkey")).limit(100)
    wanted = dearest.select(F.md5(F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))).alias("content_hash"))
    return points.fetch_points(spark.table(name), wanted, "content_hash")


@query(
    "j8_availability",
    """SELECT row_key, coalesce(s.status='downloaded', false) AS available FROM v_listing l LEFT JOIN v_status s ON lower(l.content_hash)=lower(s.content_hash)""",
)
def j8(spark, sf):
    return lookup.with_availability(table(spark, sf, "v_listing"), table(spark, sf, "v_status")).select("row_key", "available")


@query(
    "j9_integrity",
    """SELECT item_key, 'orphan' AS outcome, content_hash FROM v_item WHERE content_hash NOT IN (SELECT lower(content_hash) FROM v_status)
UNION ALL SELECT item_key, 'kept' AS outcome, content_hash FROM v_item WHERE content_hash NOT IN (SELECT lower(content_hash) FROM v_status WHERE status='error')
UNION ALL SELECT item_key, 'nulled' AS outcome, CASE WHEN content_hash NOT IN (SELECT lower(content_hash) FROM v_status WHERE status='error') THEN content_hash END FROM v_item""",
)
def j9(spark, sf):
    # key first, as the anti-joins put it: the items are then dealt by key once for all three checks
    items = table(spark, sf, "v_item").select("content_hash", "item_key")
    parents = table(spark, sf, "v_status").withColumn("content_hash", F.lower("content_hash"))
    deleted = parents.where(F.col("status") == "error")

    def named(df, outcome):
        return df.select("item_key", F.lit(outcome).alias("outcome"), "content_hash")

    return (
        named(lookup.orphans(items, parents, "content_hash"), "orphan")
        .unionByName(named(lookup.cascade_delete(items, deleted, "content_hash"), "kept"))
        .unionByName(named(lookup.set_null(items, deleted, "content_hash"), "nulled"))
    )


@query(
    "j10_point_insert",
    """WITH old AS (SELECT content_hash, row_key, raw_title, arrived_at FROM v_listing WHERE arrived_at < TIMESTAMP '1998-07-01'),
new AS (SELECT content_hash, row_key, raw_title, arrived_at, row_number() OVER (PARTITION BY content_hash ORDER BY arrived_at, row_key) AS n
 FROM v_listing WHERE arrived_at >= TIMESTAMP '1998-07-01' AND content_hash NOT IN (SELECT content_hash FROM old))
SELECT content_hash, row_key, raw_title FROM old UNION ALL SELECT content_hash, row_key, raw_title FROM new WHERE n=1""",
)
def j10_points(spark, sf):
    """The stored catalogue after two batches of later listings (the second brings the first again)."""
    listings = table(spark, sf, "v_listing").select("content_hash", "row_key", "raw_title", "arrived_at")
    split, buckets = F.lit("1998-07-01").cast("timestamp_ntz"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = points.write_points(listings.where(F.col("arrived_at") < split), "catalogue", "content_hash", buckets)
    batch = listings.where(F.col("arrived_at") >= split)
    for _ in range(2):
        points.insert_points(spark, name, batch, "content_hash", ["arrived_at", "row_key"], buckets)
    return spark.table(name).select("content_hash", "row_key", "raw_title")


@query(
    "j10_insert_if_absent",
    """WITH old AS (SELECT content_hash FROM v_listing WHERE arrived_at < TIMESTAMP '1998-01-01'),
new AS (SELECT content_hash, row_key, raw_title, arrived_at, row_number() OVER (PARTITION BY content_hash ORDER BY arrived_at, row_key) AS n
 FROM v_listing WHERE arrived_at >= TIMESTAMP '1998-01-01' AND content_hash NOT IN (SELECT content_hash FROM old))
SELECT content_hash, row_key, raw_title FROM new WHERE n=1""",
)
def j10(spark, sf):
    listings = table(spark, sf, "v_listing").select("content_hash", "row_key", "raw_title", "arrived_at")
    split = F.lit("1998-01-01").cast("timestamp_ntz")
    old, new = listings.where(F.col("arrived_at") < split), listings.where(F.col("arrived_at") >= split)
    added = lookup.insert_if_absent(old, new, "content_hash", ["arrived_at", "row_key"])
    return added.select("content_hash", "row_key", "raw_title")


@query(
    "j11_remove",
    """SELECT row_key FROM v_listing l WHERE NOT EXISTS (SELECT 1 FROM v_item i WHERE i.path LIKE '%.txt' AND i.work_id=l.work_id AND i.content_hash=l.content_hash)""",
)
def j11(spark, sf):
    removals = table(spark, sf, "v_item").where(F.endswith(F.col("path"), F.lit(".txt")))
    return lookup.remove(table(spark, sf, "v_listing"), removals, ["work_id", "content_hash"]).select("row_key")


@query(
    "j12_dictionary_tag",
    f"""WITH t AS (SELECT DISTINCT lower({S.search_form('raw_title')}) AS name FROM v_listing),
hit AS (SELECT name, min_by(dict_id, priority) AS tag FROM t JOIN v_dict ON contains(name, phrase) GROUP BY name)
SELECT row_key, coalesce(tag, concat('auto-', substr(md5(l.name),1,12))) AS tag
FROM (SELECT row_key, lower({S.search_form('raw_title')}) AS name FROM v_listing) l LEFT JOIN hit USING (name)""",
)
def j12(spark, sf):
    name = F.lower(X.clean_search_title(F.col("raw_title"))).alias("name")
    listings = table(spark, sf, "v_listing").select("row_key", name)
    return link.tag_by_dictionary(listings, table(spark, sf, "v_dict"), "name", generated_from="name").select("row_key", "tag")


@query(
    "j12_passage_tag",
    """SELECT doc_id, tag FROM documents LEFT JOIN (SELECT doc_id, min_by(item_id, item_id) AS tag FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text)) GROUP BY doc_id) h USING (doc_id)""",
)
def j12_passages(spark, sf):
    dictionary = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("priority"), F.lower("text").alias("phrase"), F.col("item_id").alias("dict_id")
    )
    docs = table(spark, sf, "documents").select("doc_id", F.lower("text").alias("low"))
    return link.tag_by_dictionary(docs, dictionary, "low", key="doc_id").select("doc_id", F.col("tag").cast("bigint").alias("tag"))


@query(
    "j13_estimated_seeders",
    f"""SELECT row_key, CAST(coalesce(nullif(seeders,0), round(coalesce(base,30)*{S.multiplier('tier')})) AS BIGINT) AS seeders
FROM (SELECT row_key, provider, seeders, {S.tier('raw_title')} AS tier FROM v_listing) l LEFT JOIN v_source_base USING (provider)""",
)
def j13(spark, sf):
    listings = table(spark, sf, "v_listing").select("row_key", "provider", "seeders", A.tier(F.col("raw_title")).alias("tier"))
    return lookup.with_estimated_seeders(listings, table(spark, sf, "v_source_base")).select("row_key", "seeders")


@query(
    "j14_item_detail",
    r"""WITH items AS (SELECT page_id, regexp_extract(url,'^[a-z]+://([^/?#]+)',1) AS source, trim(regexp_extract(html,'(?is)<h1>(.*?)</h1>',1)) AS raw_title, url FROM pages),
first AS (SELECT source, raw_title, min_by(url, page_id) AS detail_url FROM items GROUP BY source, raw_title),
detail AS (SELECT url AS detail_url, min(regexp_extract(html,'href="([^"]+)"',1)) AS link FROM pages GROUP BY url)
SELECT page_id, detail_url, link FROM items JOIN first USING (source, raw_title) JOIN detail USING (detail_url) WHERE link<>''""",
)
def j14(spark, sf):
    pages = table(spark, sf, "pages")
    host = F.regexp_extract("url", r"\A[a-z]+://([^/?#]+)", 1)
    title = F.trim(F.regexp_extract("html", "(?is)<h1>(.*?)</h1>", 1))
    items = pages.select("page_id", host.alias("source"), title.alias("raw_title"), F.col("url").alias("detail_url"), F.col("page_id").alias("position"))
    link_of = F.regexp_extract("html", 'href="([^"]+)"', 1)
    details = pages.groupBy(F.col("url").alias("detail_url")).agg(F.min(link_of).alias("link"))
    listings = items.select("page_id", "source", "raw_title")
    return lookup.attach_detail(listings, items, details).select("page_id", "detail_url", "link")
