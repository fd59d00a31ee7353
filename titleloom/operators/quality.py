"""Filters and data-quality gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titleloom import rules
from titleloom.functions.text import alternation


def _blank(c: Column) -> Column:
    return c.isNull() | (c.cast("string").isin("", "0"))


def gate(
    df: DataFrame,
    required: Sequence[str],
    link: str,
    work_id: str,
    tier: str,
    seeds: str,
    link_prefix: str,
    id_prefix: str = "tt",
    tiers: Sequence[str] = rules.CURATED_TIERS,
) -> DataFrame:
    """Add failures (all failing rules) and first_failure (null for good rows).

    Empty text and 0 count as missing. Split with good() and quarantine().
    """
    checks = [(_blank(F.col(c)), f"missing:{c}") for c in required]
    checks += [
        (~F.coalesce(F.startswith(F.col(link), F.lit(link_prefix)), F.lit(False)), "link_format"),
        (~F.coalesce(F.startswith(F.col(work_id), F.lit(id_prefix)), F.lit(False)), "id_format"),
        (~F.coalesce(F.col(tier).isin(*tiers), F.lit(False)), "tier"),
        (F.coalesce(F.col(seeds) < 0, F.lit(False)), "negative_seeds"),
    ]
    failures = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for bad, name in checks]))
    return df.withColumn("failures", failures).withColumn(
        "first_failure", F.get(F.col("failures"), F.lit(0))
    )


def good(gated: DataFrame) -> DataFrame:
    """Rows without failures, inlined: a filter would be pushed below the columns that the rules read and compute each of them again."""
    kept = F.struct(*[F.col(f"`{c}`") for c in gated.columns if c not in ("failures", "first_failure")])
    return gated.select(F.inline(F.when(F.size("failures") == 0, F.array(kept))))


def quarantine(gated: DataFrame) -> DataFrame:
    return gated.where(F.size("failures") > 0)


def valid_link(link: Column, prefix: str, marker: str, longer_than: int | None = 50) -> Column:
    """Prefix and marker present; length is not checked when longer_than is None."""
    ok = F.startswith(link, F.lit(prefix)) & F.contains(link, F.lit(marker))
    if longer_than is not None:
        ok = ok & (F.length(link) > longer_than)
    return F.coalesce(ok, F.lit(False))


def blocked(
    text: Column, keywords: Sequence[str] = rules.BLOCKED_KEYWORDS, whole_word: bool = False
) -> Column:
    """Text holds a blocked keyword; as a substring unless whole_word is set."""
    body = f"(?:{alternation(keywords)})"
    if whole_word:
        body = rf"(?<![\p{{L}}\p{{N}}_]){body}(?![\p{{L}}\p{{N}}_])"
    return F.lower(text).rlike(body)


def allowed_suffix(path: Column, suffixes: Sequence[str] = rules.MEDIA_SUFFIXES) -> Column:
    return F.lower(path).rlike(rf"\.(?:{alternation(suffixes)})\z")


def allowed_tier(tier: Column, tiers: Sequence[str]) -> Column:
    return tier.isin(*tiers)


def any_word(title: Column, query: str, longer_than: int = 2) -> Column:
    """Title contains any query word longer than the limit (one query)."""
    words = [w for w in query.lower().split(" ") if len(w) > longer_than]
    if not words:
        return F.lit(False)
    return F.lower(title).rlike(f"(?:{alternation(words)})")


def season_mentioned(title: Column, season: Column) -> Column:
    """Title names the season given in the same row."""
    pattern = F.concat(
        F.lit(r"(?i)(?<![A-Za-z0-9_])(?:s|temporada|season)\s*"), season.cast("string"),
        F.lit("(?![A-Za-z0-9_])"),
    )
    return F.coalesce(F.regexp_like(title, pattern), F.lit(False))


def all_supported(tags: Column, supported: Sequence[str] = rules.SUPPORTED_LANGUAGES) -> Column:
    """Every entry of the tag array is supported and there is at least one."""
    known = F.array(*[F.lit(s) for s in supported])
    return (F.size(tags) > 0) & (F.size(F.array_except(tags, known)) == 0)
