"""Registry of checked queries and the views they read.

A query is a function (spark, sf_dir) -> DataFrame; its oracle is the same
result as plain SQL over the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Views derived from the given tables; the SQL runs in Spark and in the oracle.
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    # one noisy listing per line item; line number 7 has null seeders and size
    "v_listing": (
        ("lineitem", "part", "supplier"),
        """
SELECT concat(l_orderkey,'-',l_linenumber,'-',l_partkey,'-',l_suppkey,'-',CAST(l_quantity AS INT),'-',CAST(round(l_extendedprice*100) AS BIGINT)) AS row_key,
 l_orderkey*10+l_linenumber AS listing_id,
 concat('tt',lpad(concat(l_partkey,''),7,'0')) AS work_id,
 CASE WHEN l_linenumber>=4 THEN concat('tt',lpad(concat(l_partkey,''),7,'0'),':',l_linenumber-3,':',CAST(l_quantity AS INT)) ELSE concat('tt',lpad(concat(l_partkey,''),7,'0')) END AS composite_id,
 s_name AS provider,
 concat('[',p_brand,'] ',p_name,CASE l_linenumber WHEN 1 THEN ' 2160p WEB-DL' WHEN 2 THEN ' 1080p BluRay' WHEN 3 THEN '.720p.mkv' WHEN 4 THEN ' S1E3 HDTV' WHEN 5 THEN ' Full HD' WHEN 6 THEN ' Temporada 2 4k' ELSE '' END,CASE l_returnflag WHEN 'A' THEN ' Dual' WHEN 'N' THEN ' Legendado' ELSE ' Dublado' END) AS raw_title,
 CASE WHEN l_linenumber=7 THEN NULL ELSE CAST(l_quantity AS INT) END AS seeders,
 CASE WHEN l_linenumber=7 THEN NULL ELSE concat(CAST(l_quantity AS INT),CASE l_linestatus WHEN 'F' THEN ' GB' ELSE ' MB' END) END AS size_text,
 CAST(round(l_extendedprice*100000) AS BIGINT) AS size_bytes,
 md5(concat('o',l_orderkey)) AS content_hash,
 concat('cat:?id=',md5(concat('o',l_orderkey)),'&n=',l_linenumber,'&dn=',replace(p_name,' ','+')) AS link,
 l_shipdate AS arrived_at
FROM {lineitem} JOIN {part} ON l_partkey=p_partkey JOIN {supplier} ON l_suppkey=s_suppkey""",
    ),
    # wanted titles; about a third with season 2
    "v_query": (
        ("part",),
        """
SELECT substr(md5(p_name),1,12) AS query_id, p_name AS title,
 CASE WHEN substr(md5(p_name),1,1) IN ('0','1','2','3','4') THEN 2 END AS season
FROM (SELECT DISTINCT p_name FROM {part}) p""",
    ),
    # wanted titles, about half of them with a work id (the lowest part of that name)
    "v_request": (
        ("part",),
        """
SELECT substr(md5(p_name),1,12) AS request_id, p_name AS wanted,
 CASE WHEN substr(md5(p_name),2,1) IN ('0','1','2','3','4','5','6','7') THEN concat('tt',lpad(concat(MIN(p_partkey),''),7,'0')) END AS work_id
FROM {part} GROUP BY p_name""",
    ),
    # items under a listing
    "v_item": (
        ("lineitem", "part"),
        """
SELECT l_orderkey AS group_id, md5(concat('o',l_orderkey)) AS content_hash, concat('tt',lpad(concat(l_partkey,''),7,'0')) AS work_id,
 l_linenumber AS season, CAST(l_quantity AS INT) AS episode,
 concat(p_name,'/S',l_linenumber,'E',CAST(l_quantity AS INT),CASE l_linestatus WHEN 'F' THEN '.mkv' ELSE '.txt' END) AS path,
 CAST(round(l_extendedprice*100) AS BIGINT) AS bytes,
 concat(l_orderkey,'-',l_linenumber,'-',l_partkey,'-',l_suppkey,'-',CAST(l_quantity AS INT),'-',CAST(round(l_extendedprice*100) AS BIGINT)) AS item_key
FROM {lineitem} JOIN {part} ON l_partkey=p_partkey""",
    ),
    # one listing per content hash (the largest value of each column of an order)
    "v_store": (
        ("v_listing",),
        """
SELECT content_hash, max(row_key) AS row_key, max(raw_title) AS raw_title, max(seeders) AS seeders, max(size_bytes) AS size_bytes
FROM {v_listing} GROUP BY content_hash""",
    ),
    # availability by upper-case hash; low-priority orders have none
    "v_status": (
        ("orders",),
        """
SELECT upper(md5(concat('o',o_orderkey))) AS content_hash,
 CASE o_orderstatus WHEN 'F' THEN 'downloaded' WHEN 'P' THEN 'downloading' ELSE 'error' END AS status
FROM {orders} WHERE o_orderpriority<>'5-LOW'""",
    ),
    # phrase dictionary of known works; priority orders the longer phrases first
    "v_dict": (
        ("part",),
        """
SELECT concat(lpad(concat(100000-length(phrase),''),6,'0'),phrase) AS priority, phrase, substr(md5(phrase),1,8) AS dict_id
FROM (SELECT DISTINCT lower(concat(p_brand,'] ',p_name)) AS phrase FROM {part}) p""",
    ),
    # status timeline per job
    "v_job": (
        ("events",),
        """
SELECT user_id AS job_id, event_id, ts,
 CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'downloading' WHEN 'click' THEN 'uploading' WHEN 'purchase' THEN 'downloaded' ELSE 'dead' END AS status,
 CAST(floor(value) AS INT) AS progress
FROM {events}""",
    ),
    # base for estimated seeders: known for most sources
    "v_source_base": (
        ("supplier",),
        "SELECT s_name AS provider, 40+s_nationkey AS base FROM {supplier} WHERE s_nationkey<20",
    ),
}

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or one of the views."""
    if name in TABLES:
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        parts = spark.conf.get("titleloom.input.partitions", None)
        return rows.repartition(int(parts)) if parts and name in ("lineitem", "documents", "pages") else rows
    inputs, sql = VIEWS[name]
    return spark.sql(sql, **{i: table(spark, sf_dir, i) for i in inputs})


def _views_in_order(names: list[str], seen: list[str]) -> list[str]:
    for name in names:
        if name in VIEWS and name not in seen:
            _views_in_order(list(VIEWS[name][0]), seen)
            seen.append(name)
    return seen


def with_views(sql: str) -> str:
    """Prefix the views that the SQL mentions as common table expressions."""
    needed = _views_in_order([v for v in VIEWS if v in sql], [])
    if not needed:
        return sql
    parts = [f"{v} AS ({VIEWS[v][1].format(**{i: i for i in VIEWS[v][0]})})" for v in needed]
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body


def query(name: str, oracle: str | None = None):
    """Register a query and its oracle SQL."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return fn

    return register
