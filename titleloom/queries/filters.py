"""Gates and predicates."""

from pyspark.sql import functions as F

from titleloom import rules
from titleloom.functions import attributes as A
from titleloom.operators import quality
from titleloom.operators.link import any_word_join
from titleloom.queries import sqltext as S
from titleloom.queries.base import query, table

_FAIL = """list_filter([
 CASE WHEN composite_id IS NULL OR composite_id IN ('','0') THEN 'missing:composite_id' END,
 CASE WHEN raw_title IS NULL OR raw_title IN ('','0') THEN 'missing:raw_title' END,
 CASE WHEN link IS NULL OR link IN ('','0') THEN 'missing:link' END,
 CASE WHEN tier IS NULL OR tier IN ('','0') THEN 'missing:tier' END,
 CASE WHEN seeds IS NULL OR seeds=0 THEN 'missing:seeds' END,
 CASE WHEN NOT coalesce(starts_with(link,'cat:?'),false) THEN 'link_format' END,
 CASE WHEN NOT coalesce(starts_with(composite_id,'tt'),false) THEN 'id_format' END,
 CASE WHEN NOT coalesce(tier IN ('4K','1080p','720p','SD'),false) THEN 'tier' END,
 CASE WHEN coalesce(seeds<0,false) THEN 'negative_seeds' END], lambda x: x IS NOT NULL)"""


@query(
    "f1_quality_gate",
    f"""WITH x AS (SELECT row_key, composite_id, raw_title, link, {S.curated_tier('raw_title')} AS tier, seeders-5 AS seeds FROM v_listing),
y AS (SELECT row_key, {_FAIL} AS f FROM x)
SELECT row_key, array_to_string(f, ',') AS failures, f[1] AS first_failure, len(f)=0 AS is_good FROM y""",
)
def f1(spark, sf):
    listings = table(spark, sf, "v_listing").select(
        "row_key", "composite_id", "raw_title", "link", A.curated_tier(F.col("raw_title")).alias("tier"),
        (F.col("seeders") - 5).alias("seeds"),
    )
    gated = quality.gate(
        listings, ["composite_id", "raw_title", "link", "tier", "seeds"],
        link="link", work_id="composite_id", tier="tier", seeds="seeds", link_prefix="cat:?",
    )
    return gated.select(
        "row_key", F.array_join("failures", ",").alias("failures"), "first_failure", (F.size("failures") == 0).alias("is_good")
    )


@query(
    "f2_valid_link",
    """SELECT page_id, starts_with(url,'https:') AND contains(url,'example.') AND length(url)>50 AS valid,
 starts_with(url,'https:') AND contains(url,'example.') AS valid_any_length FROM pages""",
)
def f2(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", quality.valid_link(url, "https:", "example.").alias("valid"),
        quality.valid_link(url, "https:", "example.", None).alias("valid_any_length"),
    )


@query(
    "f3_blocked_text",
    f"""SELECT doc_id, {S.blocked('text')} AS blocked, {S.blocked('text', rules.BLOCKED_FILE_KEYWORDS)} AS blocked_file,
 regexp_matches(lower(text), '(^|[^\\pL\\pN_])(?:{"|".join(rules.BLOCKED_KEYWORDS)})($|[^\\pL\\pN_])') AS blocked_word
FROM documents""",
)
def f3(spark, sf):
    text = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", quality.blocked(text).alias("blocked"),
        quality.blocked(text, rules.BLOCKED_FILE_KEYWORDS).alias("blocked_file"),
        quality.blocked(text, whole_word=True).alias("blocked_word"),
    )


@query("f3_blocked_listing", f"SELECT row_key FROM v_listing WHERE NOT {S.blocked('raw_title')}")
def f3_listing(spark, sf):
    return table(spark, sf, "v_listing").where(~quality.blocked(F.col("raw_title"))).select("row_key")


@query("f4_media_suffix", f"SELECT item_key FROM v_item WHERE regexp_matches(lower(path), '\\.(?:{'|'.join(rules.MEDIA_SUFFIXES)})$')")
def f4(spark, sf):
    return table(spark, sf, "v_item").where(quality.allowed_suffix(F.col("path"))).select("item_key")


@query(
    "f5_tier_allowed",
    f"""SELECT row_key, search_tier IN ('2160p','1080p','720p','HD') AS in_search, lower(delivery_tier) IN ('2160p','4k','1080p','720p','480p','hd') AS in_delivery,
 curated_tier IN ('4K','1080p','720p','SD') AS in_curated
FROM (SELECT row_key, {S.tier('raw_title')} AS search_tier, {S.simple_tier('raw_title')} AS delivery_tier, {S.curated_tier('raw_title')} AS curated_tier FROM v_listing) x""",
)
def f5(spark, sf):
    title = F.col("raw_title")
    return table(spark, sf, "v_listing").select(
        "row_key", quality.allowed_tier(A.tier(title), rules.SEARCH_TIERS).alias("in_search"),
        quality.allowed_tier(F.lower(A.simple_tier(title)), list(rules.DELIVERY_TIER_RANK)).alias("in_delivery"),
        quality.allowed_tier(A.curated_tier(title), rules.CURATED_TIERS).alias("in_curated"),
    )


@query(
    "f6_any_word",
    """WITH t AS (SELECT DISTINCT raw_title AS title FROM v_listing)
SELECT DISTINCT query_id, t.title FROM (SELECT query_id, unnest(string_split(lower(title),' ')) AS word FROM v_query) w
JOIN t ON length(word)>2 AND contains(lower(t.title), word)""",
)
def f6(spark, sf):
    titles = table(spark, sf, "v_listing").select(F.col("raw_title").alias("title")).distinct()
    return any_word_join(table(spark, sf, "v_query"), titles)


@query(
    "f7_season_mentioned",
    r"""SELECT row_key, season, regexp_matches(raw_title, concat('(?i)\b(?:s|temporada|season)\s*', season, '\b')) AS mentioned
FROM (SELECT row_key, raw_title, 1+listing_id%10%3 AS season FROM v_listing) x""",
)
def f7(spark, sf):
    rows = table(spark, sf, "v_listing").select("row_key", "raw_title", (1 + F.col("listing_id") % 10 % 3).alias("season"))
    return rows.select("row_key", "season", quality.season_mentioned(F.col("raw_title"), F.col("season")).alias("mentioned"))


@query(
    "f8_all_supported",
    f"""SELECT row_key, {S.language('raw_title')} IN ('pt-BR,en','pt-BR','pt') AS supported, {S.language('raw_title')}='pt' AS supported_narrow FROM v_listing""",
)
def f8(spark, sf):
    tags = A.language_list(A.language_tag(F.col("raw_title")))
    return table(spark, sf, "v_listing").select(
        "row_key", quality.all_supported(tags).alias("supported"), quality.all_supported(tags, ["pt"]).alias("supported_narrow")
    )
