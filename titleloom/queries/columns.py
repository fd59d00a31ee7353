"""Column families over the listing, item, page, document and event tables."""

from pyspark.sql import functions as F

from titleloom import rules
from titleloom.functions import attributes as A
from titleloom.functions import text as X
from titleloom.plans.delivery import delivered
from titleloom.queries import sqltext as S
from titleloom.queries.base import query, table



def raw_title():
    return F.col("raw_title")


@query("t1_normalise_title", f"SELECT row_key, {S.normalised('raw_title')} AS normalised FROM v_listing")
def t1(spark, sf):
    return table(spark, sf, "v_listing").select("row_key", X.normalise_title(raw_title()).alias("normalised"))


H1 = "regexp_extract(html, '(?is)<h1>(.*?)</h1>', 1)"


@query("t1_normalise_heading", f"SELECT page_id, {S.normalised(H1)} AS normalised FROM pages")
def t1_pages(spark, sf):
    h1 = F.regexp_extract("html", "(?is)<h1>(.*?)</h1>", 1)
    return table(spark, sf, "pages").select("page_id", X.normalise_title(h1).alias("normalised"))


@query(
    "t2_clean_title",
    f"""SELECT row_key, {S.cleaned('raw_title')} AS listing_title, {S.search_form('raw_title')} AS search_title,
 {S.collapsed(r"regexp_replace(regexp_replace(concat(raw_title, ' (2024) - IMDb'), '- IMDb$', ''), '\(\d{4}\)', '')")} AS page_title
FROM v_listing""",
)
def t2(spark, sf):
    page = F.concat(raw_title(), F.lit(" (2024) - IMDb"))
    return table(spark, sf, "v_listing").select(
        "row_key",
        X.clean_listing_title(raw_title()).alias("listing_title"),
        X.clean_search_title(raw_title()).alias("search_title"),
        X.clean_page_title(page).alias("page_title"),
    )


@query("t3_tier", f"SELECT row_key, {S.tier('raw_title')} AS tier FROM v_listing")
def t3(spark, sf):
    return table(spark, sf, "v_listing").select("row_key", A.tier(raw_title()).alias("tier"))


@query("t4_simple_tier", f"SELECT row_key, {S.simple_tier('raw_title')} AS tier FROM v_listing")
def t4(spark, sf):
    return table(spark, sf, "v_listing").select("row_key", A.simple_tier(raw_title()).alias("tier"))


@query("t5_curated_tier", f"SELECT row_key, {S.curated_tier('raw_title')} AS tier FROM v_listing")
def t5(spark, sf):
    return table(spark, sf, "v_listing").select("row_key", A.curated_tier(raw_title()).alias("tier"))


@query("t6_tier_score", f"SELECT row_key, CAST({S.tier_score('raw_title')} AS INT) AS score FROM v_listing")
def t6(spark, sf):
    return table(spark, sf, "v_listing").select("row_key", A.tier_score(raw_title()).alias("score"))


@query(
    "t7_language",
    f"""SELECT row_key, {S.language('raw_title')} AS tag, {S.language('raw_title', True)} AS tag_with_english, trim(unnest(string_split({S.language('raw_title')}, ','))) AS language
FROM v_listing""",
)
def t7(spark, sf):
    from titleloom import rules

    tag = A.language_tag(raw_title())
    return table(spark, sf, "v_listing").select(
        "row_key", tag.alias("tag"), A.language_tag(raw_title(), rules.LANGUAGE_KEYWORDS_WITH_ENGLISH).alias("tag_with_english"),
        F.explode(A.language_list(tag)).alias("language"),
    )


@query(
    "t8_language_evidence",
    f"""SELECT doc_id, lang, regexp_matches(lower(text), '[{rules.ACCENTED_LETTERS}]') AS has_accents,
 regexp_matches(lower(text), ' (?:{'|'.join(rules.FUNCTION_WORDS)}) ') AS has_function_words,
 length(text)>3 AS is_long,
 (regexp_matches(lower(text), '[{rules.ACCENTED_LETTERS}]') OR length(text)>3
  OR regexp_matches(lower(text), ' (?:{'|'.join(rules.FUNCTION_WORDS)}) ')) AS accepted
FROM documents""",
)
def t8(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", X.language_evidence(F.col("text")).alias("e"))
    return docs.select("doc_id", "lang", "e.*")


@query("t9_season", f"SELECT row_key, {S.season('raw_title')} AS season FROM v_listing")
def t9(spark, sf):
    return table(spark, sf, "v_listing").select("row_key", A.season_number(raw_title()).alias("season"))


@query(
    "t10_main_title",
    "SELECT row_key, "
    + S.collapsed(
        r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw_title, '(?i)temporada\s*\d+', '', 'g'),"
        r" '(?i)season\s*\d+', '', 'g'), '(?i)\s*\d+ª?\s*temp', '', 'g'), '(?i)s\d+', '', 'g')"
    )
    + " AS main_title FROM v_listing",
)
def t10(spark, sf):
    return table(spark, sf, "v_listing").select("row_key", X.main_title(raw_title()).alias("main_title"))


_S, _E, _R = S.ordinal("path")


@query("t11_ordinal", f"SELECT item_key, path, {_S} AS season, {_E} AS episode, {_R} AS raw FROM v_item")
def t11(spark, sf):
    items = table(spark, sf, "v_item").select("item_key", "path", A.ordinal(F.col("path")).alias("o"))
    return items.select("item_key", "path", "o.*")


_TITLE_SIZE = S.size_text("raw_title", "GB|MB|GiB|MiB|G|M")


@query(
    "t12_size_bytes",
    f"""SELECT row_key, {S.size_bytes('size_text')} AS bytes, {_TITLE_SIZE} AS title_size, {S.size_bytes(f"({_TITLE_SIZE})")} AS title_bytes
FROM v_listing""",
)
def t12(spark, sf):
    in_title = A.size_text_in_title(raw_title())
    return table(spark, sf, "v_listing").select(
        "row_key", A.size_bytes(F.col("size_text")).alias("bytes"),
        in_title.alias("title_size"), A.size_bytes(in_title).alias("title_bytes"),
    )


@query(
    "t13_bytes_text",
    f"""SELECT row_key, {S.bytes_text('size_bytes')} AS size_text, printf('%.2f MB', round(size_bytes/1048576,2)) AS megabytes
FROM v_listing""",
)
def t13(spark, sf):
    size = F.col("size_bytes")
    return table(spark, sf, "v_listing").select(
        "row_key", A.bytes_text(size).alias("size_text"), A.megabytes_text(size).alias("megabytes")
    )


@query(
    "t14_composite_id",
    r"""SELECT row_key, CASE WHEN regexp_matches(string_split(composite_id,':')[1], '^tt\d+$') THEN string_split(composite_id,':')[1] ELSE composite_id END AS base_id,
 nullif(regexp_extract(composite_id, '^(tt\d+)', 1), '') AS prefix_id,
 nullif(regexp_extract(composite_id, '^(tt\d+):(\d+):(\d+)$', 1), '') AS work_id,
 TRY_CAST(regexp_extract(composite_id, '^(tt\d+):(\d+):(\d+)$', 2) AS BIGINT) AS season,
 TRY_CAST(regexp_extract(composite_id, '^(tt\d+):(\d+):(\d+)$', 3) AS BIGINT) AS episode
FROM v_listing""",
)
def t14(spark, sf):
    full = F.col("composite_id")
    rows = table(spark, sf, "v_listing").select(
        "row_key", A.base_id(full).alias("base_id"), A.prefix_id(full).alias("prefix_id"), A.episode_id(full).alias("e")
    )
    return rows.select("row_key", "base_id", "prefix_id", "e.*")


@query(
    "t15_link_attributes",
    r"""SELECT row_key, lower(nullif(regexp_extract(link, '(?i)id=([a-zA-Z0-9]+)', 1), '')) AS content_hash,
 trim(regexp_replace(replace(regexp_extract(link, 'dn=([^&]+)', 1), '+', ' '), '\s+', ' ', 'g')) AS name,
 array_to_string(regexp_extract_all(link, '[?&]n=([^&#]*)', 1), ',') AS numbers,
 '1080p' AS tier, concat('dht:', lower(regexp_extract(link, '(?i)id=([a-zA-Z0-9]+)', 1))) AS source
FROM v_listing""",
)
def t15(spark, sf):
    link = F.col("link")
    return table(spark, sf, "v_listing").select(
        "row_key", A.content_hash(link, "id=").alias("content_hash"), A.display_name(link).alias("name"),
        F.array_join(A.repeated_parameter(link, "n"), ",").alias("numbers"),
        A.curated_tier(A.display_name(link)).alias("tier"),
        F.get(A.link_sources(link, "cat:", "id="), F.lit(0)).alias("source"),
    )


@query(
    "t15_name_tier",
    f"""SELECT row_key, name, {S.curated_tier('name')} AS tier FROM (SELECT row_key, trim(regexp_replace(regexp_replace(raw_title, '[._+]', ' ', 'g'), '\\s+', ' ', 'g')) AS name FROM v_listing) x""",
)
def t15_tier(spark, sf):
    """Links whose dn carries the whole title, so that every tier occurs."""
    link = F.concat(F.lit("cat:?id=1&dn="), F.replace("raw_title", F.lit(" "), F.lit("+")), F.lit("&n=1"))
    name = A.display_name(link)
    return table(spark, sf, "v_listing").select("row_key", name.alias("name"), A.curated_tier(name).alias("tier"))


@query(
    "t15_page_url_attributes",
    r"""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
 array_to_string(regexp_extract_all(url, '[?&]ref=([^&#]*)', 1), ',') AS refs
FROM pages""",
)
def t15_pages(spark, sf):
    from titleloom.sources.pages import page_host

    url = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", page_host(url).alias("host"), F.array_join(A.repeated_parameter(url, "ref"), ",").alias("refs")
    )


LINK_PATTERN = 'href="([^"]+)"'


@query(
    "t16_links_in_text",
    f"""WITH l AS (SELECT page_id, regexp_extract_all(html, '{LINK_PATTERN}', 1) AS found FROM pages)
SELECT page_id, CAST(i-1 AS INT) AS position, found[i] AS link, found[1] AS first_link FROM (SELECT page_id, found, unnest(generate_series(1, len(found))) AS i FROM l) x""",
)
def t16(spark, sf):
    return X.each_link(table(spark, sf, "pages"), X.links(F.col("html"), LINK_PATTERN, 1), "page_id")


@query(
    "t17_relevance_score",
    f"""SELECT row_key, {S.score('tier', '0.8::DOUBLE', 'raw_title', 'seeders')} AS score
FROM (SELECT row_key, raw_title, seeders, {S.tier('raw_title')} AS tier FROM v_listing) x""",
)
def t17(spark, sf):
    return table(spark, sf, "v_listing").select(
        "row_key", A.relevance_score(A.tier(raw_title()), F.lit(0.8), raw_title(), F.col("seeders")).alias("score")
    )


@query(
    "t18_mask_text",
    r"""SELECT doc_id, md5(regexp_replace(text, '(\d+)\.(\d+)\.(\d+)\.(\d+)', '\1.\2.***.***')) AS first_masked,
 md5(regexp_replace(text, '(\d+)\.(\d+)\.(\d+)\.(\d+)', '\1.\2.***.***', 'g')) AS all_masked,
 CASE WHEN length(text)>50 THEN concat(substr(text,1,50),'...') ELSE text END AS cut,
 concat(substr(md5(text),1,8),'...') AS masked_id, concat(substr(md5(text),1,8),'...',right(md5(text),4)) AS masked_key
FROM documents""",
)
def t18(spark, sf):
    text = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(X.mask_address(text)).alias("first_masked"),
        F.md5(X.mask_address(text, all_matches=True)).alias("all_masked"), X.cut_text(text).alias("cut"),
        X.mask_id(F.md5(text)).alias("masked_id"), X.mask_key(F.md5(text)).alias("masked_key"),
    )


@query(
    "t18_mask_url",
    r"""SELECT page_id, concat(regexp_extract(url, '^([a-z]+://[^/?#]+)', 1), CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)='' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) END, '?***') AS masked,
 CASE WHEN length(url)<=50 THEN url ELSE concat(substr(url,1,47),'...') END AS cut
FROM pages""",
)
def t18_pages(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select("page_id", X.mask_url(url).alias("masked"), X.cut_link(url).alias("cut"))


@query(
    "t19_request_key",
    """SELECT event_id, CASE WHEN event_type='signup' THEN concat('app://', user_id) ELSE
 array_to_string(list_filter([event_type, nullif(CAST(user_id AS VARCHAR),''), json_extract_string(props,'$.k')], lambda x: x IS NOT NULL AND x<>''), '|') END AS request_key
FROM events""",
)
def t19(spark, sf):
    url = F.when(F.col("event_type") == "signup", F.concat(F.lit("app://"), F.col("user_id").cast("string")))
    parts = [F.col("event_type"), F.col("user_id"), F.get_json_object("props", "$.k")]
    return table(spark, sf, "events").select("event_id", A.request_key(parts, url).alias("request_key"))


@query(
    "t20_delivery",
    f"""SELECT row_key, concat(raw_title,' | Seeds: ',coalesce(seeders,0),' | ',{S.bytes_text('size_bytes')}) AS title,
 concat('Catalogue [',{S.simple_tier('raw_title')},']') AS name, concat('dht:',content_hash) AS source,
 CASE WHEN coalesce(season,0)<>0 AND coalesce(episode,0)<>0 THEN concat('catalogue-',work_id,'-s',season) ELSE concat('catalogue-',substr(content_hash,1,8)) END AS hint_group
FROM (SELECT *, TRY_CAST(regexp_extract(composite_id, ':(\\d+):(\\d+)$', 1) AS BIGINT) AS season, TRY_CAST(regexp_extract(composite_id, ':(\\d+):(\\d+)$', 2) AS BIGINT) AS episode FROM v_listing) x""",
)
def t20(spark, sf):
    parsed = A.episode_id(F.col("composite_id"))
    rows = table(spark, sf, "v_listing").withColumn("season", parsed["season"]).withColumn("episode", parsed["episode"])
    out = rows.select("row_key", *delivered())
    return out.select("row_key", "title", "name", F.get("sources", F.lit(0)).alias("source"), F.col("hints.group").alias("hint_group"))


@query(
    "t21_query_variants",
    """SELECT query_id, unnest(CASE WHEN season IS NULL THEN [title] ELSE [title, concat(title,' Temporada ',season), concat(title,' Season ',season), concat(title,' S',season)] END) AS variant
FROM v_query""",
)
def t21(spark, sf):
    q = table(spark, sf, "v_query")
    return q.select("query_id", F.explode(A.query_variants(F.col("title"), F.col("season"))).alias("variant"))


@query(
    "t22_seeders_number",
    """SELECT row_key, CAST(coalesce(CASE WHEN TRY_CAST(seeders AS BIGINT)-5>=0 THEN seeders-5 END, 50) AS BIGINT) AS seeders FROM v_listing""",
)
def t22(spark, sf):
    text = F.concat(F.lit(" "), (F.col("seeders") - 5).cast("string"), F.lit(" seeds"))
    return table(spark, sf, "v_listing").select("row_key", A.seeders_number(text).alias("seeders"))
