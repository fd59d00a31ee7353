"""JSON payloads of search services and of content systems."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from titleloom import rules, schemas
from titleloom.functions import attributes as A
from titleloom.functions import text as X
from titleloom.operators.lookup import estimated_seeders
from titleloom.workspace import new_folder


def _listing(
    source_row: Column, title: Column, link: Column, seeders: Column, leechers: Column, size_text: Column,
    provider: Column, kind: Column, updated_at: Column,
) -> list[Column]:
    """Columns of schemas.SCORED_LISTING for a raw title, whose tier is the column _tier."""
    return [
        source_row.alias("source_row"),
        X.clean_listing_title(title).alias("title"),
        link.alias("link"),
        F.coalesce(F.nullif(seeders, F.lit(0)), estimated_seeders(F.col("base"), F.col("_tier"))).cast("bigint").alias("seeders"),
        F.coalesce(leechers, F.lit(0)).cast("bigint").alias("leechers"),
        size_text.alias("size_text"),
        A.size_bytes(size_text).alias("size_bytes"),
        F.col("_tier").alias("tier"),
        provider.alias("provider"),
        A.language_tag(title).alias("language"),
        kind.alias("type"),
        F.lit(100).alias("relevance_score"),
        A.season_number(title).alias("season"),
        updated_at.alias("updated_at"),
        F.lit(0.5).alias("confidence"),
    ]


def _filled(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def from_search_payload(
    df: DataFrame, payload: str, as_of: Column, provider: str = "provider", base: str = "base",
    kind: Column | None = None, cap: int | None = None,
) -> DataFrame:
    """Listings of {"results": [...]} payloads, one row per usable result.

    df: payload JSON, provider and its base for estimated seeders. Broken JSON
    gives no rows. With cap only the first cap results of a payload are mapped,
    for sources whose contract says so.
    """
    results = F.from_json(F.col(payload), schemas.SEARCH_PAYLOAD)["results"]
    if cap is not None:
        results = F.slice(results, 1, cap)
    # outer: inline would infer a filter that parses the payload a second time;
    # the empty rows fall to the next filter
    rows = df.select(F.col(provider).alias("provider"), F.col(base).alias("base"), F.inline_outer(results))
    usable = rows.where(_filled(F.col("title")) & _filled(F.col("magnet_link"))).withColumn("_tier", A.tier(F.col("title")))
    return usable.select(
        *_listing(
            F.col("info_hash"), F.col("title"), F.col("magnet_link"), F.col("seed_count"), F.col("leech_count"),
            F.coalesce(F.nullif("size", F.lit("")), F.lit(rules.SIZE_UNSPECIFIED)), F.col("provider"),
            F.lit("movie") if kind is None else kind,
            F.coalesce(F.nullif(F.col("date"), F.lit("")).try_cast("timestamp"), as_of.cast("timestamp")),
        )
    )


# fixed values: link markers and patterns of post contents
POST_LINK = r"""magnet:\?[^"'\s<>]+"""
POST_LINK_MARKERS = ("xt=urn:btih:", "&dn=")
POST_LINK_FALLBACKS = (
    r"""magnet:\?xt=urn:btih:[a-zA-Z0-9]+&dn=[^"'\s<>]+""",
    r"""magnet:\?xt=urn:btih:[a-zA-Z0-9]+[^"'\s<>]*""",
    r"""magnet:\?[^"'\s<>]*xt=urn:btih:[a-zA-Z0-9]+[^"'\s<>]*""",
)


def from_post_payload(
    df: DataFrame, payload: str, provider: str = "provider", base: str = "base", kind: Column | None = None,
    link: str = POST_LINK, markers: Sequence[str] = POST_LINK_MARKERS, fallbacks: Sequence[str] = POST_LINK_FALLBACKS,
) -> DataFrame:
    """Listings of arrays of posts with nested title, content and modified."""
    posts = F.inline_outer(F.from_json(F.col(payload), schemas.POST_PAYLOAD))  # outer: as above
    rows = df.select(F.col(provider).alias("provider"), F.col(base).alias("base"), posts)
    title, content = F.col("title.rendered"), F.col("content.rendered")
    usable = rows.where(F.length(title) >= rules.MIN_TITLE_LENGTH).withColumn("_tier", A.tier(title))
    return usable.select(
        *_listing(
            F.lit(None).cast("string"), title,
            F.coalesce(X.best_link(content, link, markers, fallbacks), F.lit("")),
            F.lit(None).cast("bigint"), F.lit(0), A.size_text_in_content(content), F.col("provider"),
            F.lit("movie") if kind is None else kind,
            F.col("modified").try_cast("timestamp"),
        )
    )


def from_items(
    df: DataFrame, as_of: Column, provider: str = "provider", kind: Column | None = None
) -> DataFrame:
    """Listings of items read from pages (pages.extract_items), with provider and its base in `base`.

    A page tells no seeders: they are estimated; the size is looked for in the title.
    """
    title = F.col("title")
    return df.withColumn("_tier", A.tier(title)).select(
        *_listing(
            F.concat_ws("-", "page_id", "position"), title, F.col("link"), F.lit(None).cast("bigint"), F.lit(0),
            A.size_text_in_content(title), F.col(provider), F.lit("movie") if kind is None else kind, as_of.cast("timestamp"),
        )
    )


def empty_listings(spark) -> DataFrame:
    return spark.createDataFrame([], schemas.SCORED_LISTING)


def gather(*sources: DataFrame | None) -> DataFrame:
    """UNION ALL of listing sources; a failed source is None and adds nothing."""
    present = [s for s in sources if s is not None]
    if not present:
        raise ValueError("gather needs at least one source")
    out = present[0]
    for source in present[1:]:
        out = out.unionByName(source, allowMissingColumns=True)
    return out


REPORT = "source STRING, ok BOOLEAN, rows BIGINT, error STRING"


def gather_sources(spark: SparkSession, sources: Mapping[str, Callable[[], DataFrame]], schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(listings, report) of named sources, of which any may fail (runs a write per source).

    A source is a function that gives its listings. Each is read on its own
    and its rows are written; one that raises, in planning or while it is read,
    costs its own rows only and is reported with its error. Columns that a source
    does not have are null, others than those of schema are left out. report has
    a row per source; a session that is lost is no fault of a source and raises.
    """
    held, report = [spark.createDataFrame([], schema)], []
    for name, source in sources.items():
        path = new_folder(spark, "source")
        try:
            rows = source()
            found = set(rows.columns)
            rows = rows.select(*[(F.col(f"`{f.name}`") if f.name in found else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
            rows.write.parquet(path)
            read = spark.read.schema(schema).parquet(path)
            report.append((name, True, read.count(), None))
            held.append(read)
        except Exception as error:
            if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
                raise
            report.append((name, False, 0, (str(error).splitlines() or [type(error).__name__])[0][:500]))
    return gather(*held), spark.createDataFrame(report, REPORT)
