"""Title search: listings x wanted titles to the best few per query and tier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titleloom import rules
from titleloom.functions import attributes as A
from titleloom.functions import text as X
from titleloom.operators import rank, stats
from titleloom.operators.link import link_titles, query_words, titles_with_word
from titleloom.workspace import new_folder


def searchable(listings: DataFrame) -> DataFrame:
    """Listings with clean title, tier and numeric seeders and size.

    The title is never null, so joins on it add no null filter that would
    compute it a second time.
    """
    return listings.select(
        "row_key", "link",
        F.coalesce(X.clean_listing_title(F.col("raw_title")), F.lit("")).alias("title"),
        A.tier(F.col("raw_title")).alias("tier"),
        F.coalesce("seeders", F.lit(0)).cast("bigint").alias("seeders"),
        A.size_bytes(F.col("size_text")).alias("size_bytes"),
    )


def searchable_sources(gathered: DataFrame) -> DataFrame:
    """The same columns from gathered listings of sources (schemas.SCORED_LISTING).

    The key is the source's row, or link and title where it has none.
    """
    key = F.coalesce("source_row", F.concat_ws("|", "link", "title"))
    return gathered.select(
        F.concat_ws("|", "provider", key).alias("row_key"), "link", F.coalesce("title", F.lit("")).alias("title"), "tier", "seeders", "size_bytes"
    )


def title_leaders(listings: DataFrame, k: int = rules.TOP_PER_TIER) -> DataFrame:
    """(title, leaders): the k best listings per (title, tier), whatever the query.

    For one query all listings with the same title and tier share confidence,
    and their score only grows with seeders. So the best k per query and tier
    are among the best k per (title, tier): the listing table shrinks before
    any join. leaders holds at most k rows per tier.
    """
    order = [F.col("seeders").desc(), F.col("size_bytes").desc(), F.col("row_key").asc()]
    best = rank.top_k(listings, ["title", "tier"], order, k, "place")
    entry = F.struct("tier", "row_key", "link", "seeders", "size_bytes")
    return best.groupBy("title").agg(F.collect_list(entry).alias("leaders"))


def best_matches(queries: DataFrame, listings: DataFrame, k: int = rules.TOP_PER_TIER) -> DataFrame:
    """Best k listings per query and tier.

    queries: query_id, title. listings: output of searchable, read once.
    """
    pairs = link_titles(queries, title_leaders(listings, k), keep=["leaders"])
    return score_and_rank(pairs, k)


def score_and_rank(pairs: DataFrame, k: int) -> DataFrame:
    rows = pairs.select("query_id", "title", "match_type", "confidence", F.inline("leaders"))
    score = A.relevance_score(F.col("tier"), F.col("confidence"), F.col("title"), F.col("seeders"))
    return rank.best_per_tier(rows.withColumn("relevance_score", score), k=k)


def any_word_search(queries: DataFrame, listings: DataFrame, k: int = rules.SOURCE_CAP) -> DataFrame:
    """Best k listings per query whose title holds any of its words.

    queries: query_id, title. listings: row_key, title, score. Scores belong to
    listings, so the best k of a query are among the best k of its words, and
    those among the best k of each title. Every step keeps k rows per group
    before the next join.
    """
    order = [F.col("score").desc(), F.col("row_key").asc()]
    leaders = rank.top_k(listings, ["title"], order, k, "place").drop("place")
    words = query_words(queries)
    hits = titles_with_word(words, leaders.select("title").distinct()).join(leaders, "title")
    per_word = rank.top_k(hits, ["word"], order, k, "place").drop("place")
    found = per_word.join(words, "word").dropDuplicates(["query_id", "row_key"])
    return rank.top_k(found, ["query_id"], order, k)


def report(queries: DataFrame, listings: DataFrame, repeated: str) -> DataFrame:
    """Search report per query; listings are counted per title and tier first.

    The pairs are linked once and written to the shared folder (runs a write),
    as both the counts and the best listings are made from them.
    """
    tiers = [f"tier_{t.lower()}" for t in rules.SEARCH_TIERS]
    counts = listings.groupBy("title").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("tier") == t).alias(c) for t, c in zip(rules.SEARCH_TIERS, tiers)],
    )
    titles = counts.drop("n").join(title_leaders(listings), "title")
    linked = link_titles(queries, titles, keep=["leaders", *tiers])
    path = new_folder(queries.sparkSession, "pairs")
    linked.write.parquet(path)
    pairs = queries.sparkSession.read.schema(linked.schema).parquet(path)
    best = score_and_rank(pairs, rules.TOP_PER_TIER)
    # the grand total comes from the per-title counts
    total = counts.agg(F.sum("n").alias("total"))
    return stats.search_report(pairs, tiers, best, total, F.contains(F.col("link"), F.lit(repeated)))
