"""Attributes read from titles, sizes, ids and links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from titleloom import rules
from titleloom.functions.text import collapse_space, once


def _has(c: Column, text: str) -> Column:
    return F.contains(c, F.lit(text))


def _has_any(c: Column, *texts: str) -> Column:
    found = _has(c, texts[0])
    for text in texts[1:]:
        found = found | _has(c, text)
    return found


def _word(c: Column, body: str) -> Column:
    """ASCII word boundaries: Java's \\b counts accented letters as word characters."""
    return c.rlike(f"(?<![A-Za-z0-9_]){body}(?![A-Za-z0-9_])")


def number_in(c: Column, pattern: str, group: int = 1) -> Column:
    """First match as a long; null when absent or out of range.

    A failing try_cast costs an exception per row, so "no match" becomes null first.
    """
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit("")).try_cast("bigint")


# --- tiers ----------------------------------------------------------------


def tier(title: Column) -> Column:
    """Search tier of a title: 2160p, 1080p, 720p or HD.

    Explicit resolutions come first, then dotted source tags, then words. The
    bare word "hd" is tested before "full hd" and "ultra hd", so those are HD.
    """
    return once(F.lower(title), _tier)


def _tier(t: Column) -> Column:
    return (
        F.when(_has_any(t, "2160p", "4k"), "2160p")
        .when(_has(t, "1080p"), "1080p")
        .when(_has(t, "720p"), "720p")
        .when(_has(t, ".web-dl."), "1080p")
        .when(_has(t, ".remux."), "2160p")
        .when(_word(t, "hd"), "HD")
        .when(_word(t, "(?:uhd|ultra.hd)"), "2160p")
        .when(_word(t, "(?:fhd|full.hd)"), "1080p")
        .when(_word(t, "hd.rip"), "720p")
        .when(_word(t, "high.def"), "HD")
        .when(_has_any(t, ".bluray.", ".blu-ray.", ".webrip."), "1080p")
        .when(_has(t, ".hdtv."), "720p")
        .when(_has_any(t, ".brrip.", ".bdrip."), "1080p")
        .when(_has_any(t, "remux", "web-dl", "bluray", "blu-ray"), "1080p")
        .when(_has(t, "hdtv"), "720p")
        .otherwise("HD")
    )


def simple_tier(title: Column) -> Column:
    t = F.lower(title)
    return (
        F.when(_has_any(t, "2160p", "4k"), "2160p")
        .when(_has(t, "1080p"), "1080p")
        .when(_has(t, "720p"), "720p")
        .when(_has(t, "480p"), "480p")
        .otherwise("HD")
    )


def curated_tier(title: Column) -> Column:
    """Leftmost tier token lower-cased, 2160p as 4K, 1080p when there is none."""
    found = F.lower(F.regexp_extract(title, "(?i)(4K|2160p|1080p|720p|480p|SD)", 1))
    return once(found, lambda x: F.when(x == "", "1080p").when(x == "2160p", "4K").otherwise(x))


def tier_score(title: Column) -> Column:
    t = F.lower(title)
    return (
        F.when(_has_any(t, "4k", "2160p"), 100)
        .when(_has(t, "1080p"), 80)
        .when(_has(t, "720p"), 60)
        .when(_has(t, "480p"), 40)
        .when(_has_any(t, "bluray", "web-dl"), 30)
        .when(_has(t, "dvdrip"), 20)
        .otherwise(10)
    )


def table_value(key: Column, table: dict[str, float], default) -> Column:
    """CASE over a small fixed table."""
    out = None
    for name, value in table.items():
        out = F.when(key == name, F.lit(value)) if out is None else out.when(key == name, F.lit(value))
    return out.otherwise(F.lit(default))


# --- language -------------------------------------------------------------


def language_tag(
    title: Column,
    keywords: Sequence[tuple[str, str]] = rules.LANGUAGE_KEYWORDS,
    default: str = rules.DEFAULT_LANGUAGE,
) -> Column:
    t = F.lower(title)
    hits = [F.when(_has(t, word), tag) for word, tag in keywords]
    return F.coalesce(*hits, F.lit(default))


def language_list(tag: Column) -> Column:
    return F.transform(F.split(tag, ","), lambda x: F.trim(x))


# --- season, episode ------------------------------------------------------

# fixed values: season patterns in order of trust
SEASON_PATTERNS = (
    r"(?i)temporada\s*(\d+)",
    r"(?i)(\d+)\s*temporada",
    r"(?i)season\s*(\d+)",
    r"(?i)s(\d+)",
    r"(?i)(\d+)\s*ª?\s*temp",
)

# fixed values: ordinal patterns in order of trust
ORDINAL_PATTERNS = (
    r"(?i)(\d+)x(\d+)",
    r"(?i)s(\d+)e(\d+)",
    r"(?i)season[\s\._-]?(\d+)[\s\._-]?episode[\s\._-]?(\d+)",
    r"(?i)ep[\s\._-]?(\d+)",
    r"(\d+)(?:\s*-\s*|\s*)(\d+)",
    r"\A(\d+)\z",
)


def season_number(title: Column) -> Column:
    """First season pattern that gives a number above zero."""
    numbers = F.array(*[number_in(title, pattern) for pattern in SEASON_PATTERNS])
    return F.get(F.filter(numbers, lambda n: n > 0), F.lit(0))


def ordinal(path: Column, fix_season_episode: bool = False) -> Column:
    """struct<season, episode, raw> of an item path.

    "season N episode M" counts as an episode-only name by default, so its
    first number is the episode and the season is 1; fix_season_episode reads
    both numbers instead.
    """
    one = F.lit(1).cast("bigint")
    zero = F.lit(0).cast("bigint")
    nxm, sxe, words, ep, pair, whole = ORDINAL_PATTERNS

    def item(pattern: str, read) -> Column:
        def value(raw: Column) -> Column:
            season, episode = read(raw)
            row = F.struct(season.alias("season"), episode.alias("episode"), raw.alias("raw"))
            return F.when((raw != "") & season.isNotNull() & episode.isNotNull(), row)

        return once(F.regexp_extract(path, pattern, 0), value)

    def both(pattern: str) -> Column:
        return item(pattern, lambda raw: (number_in(raw, pattern, 1), number_in(raw, pattern, 2)))

    def episode_only(pattern: str) -> Column:
        return item(pattern, lambda raw: (one, number_in(raw, pattern, 1)))

    digits = F.regexp_extract(path, r"\d+", 0)
    rest = F.struct(
        one.alias("season"),
        F.coalesce(F.nullif(digits, F.lit("")).try_cast("bigint"), zero).alias("episode"),
        F.when(digits == "", "unknown").otherwise(digits).alias("raw"),
    )
    return F.coalesce(
        both(nxm), both(sxe), both(words) if fix_season_episode else episode_only(words),
        episode_only(ep), both(pair), episode_only(whole), rest,
    )


# --- sizes ----------------------------------------------------------------


def size_bytes(text: Column) -> Column:
    """Bytes of the first "number unit" as a double; 1.5 GiB when there is none."""
    pattern = r"(?i)(\d+\.?\d*)\s*(GB|MB|G|M)"

    def read(found: Column) -> Column:
        value = F.nullif(F.regexp_extract(found, pattern, 1), F.lit("")).try_cast("double")
        unit = F.upper(F.substring(F.regexp_extract(found, pattern, 2), 1, 1))
        return F.when(unit == "G", value * F.lit(1024.0 ** 3)).when(unit == "M", value * F.lit(1024.0 ** 2))

    # the whole match alone is read further: the text, which may be made by patterns itself, is gone through once
    return F.coalesce(once(F.regexp_extract(text, pattern, 0), read), F.lit(float(rules.DEFAULT_SIZE_BYTES)))


def _size_text(text: Column, units: str) -> Column:
    pattern = rf"(?i)(\d+\.?\d*)\s*({units})"
    number = F.regexp_extract(text, pattern, 1)
    shown = F.concat(number, F.lit(" "), F.upper(F.regexp_extract(text, pattern, 2)))
    return F.when(F.coalesce(number, F.lit("")) == "", rules.SIZE_UNSPECIFIED).otherwise(shown)


def size_text_in_title(title: Column) -> Column:
    return _size_text(title, "GB|MB|GiB|MiB|G|M")


def size_text_in_content(content: Column) -> Column:
    return _size_text(content, "GB|MB|GiB|MiB")


def bytes_text(size: Column) -> Column:
    """Base-1024 text with one decimal; null and 0 are "Unknown"."""
    value = size.cast("double")
    power = F.least(F.floor(F.ln(value) / F.ln(F.lit(1024.0))).cast("int"), F.lit(len(rules.SIZE_UNITS) - 1))
    number = F.round(value / F.pow(F.lit(1024.0), power), 1)
    unit = F.get(F.array(*[F.lit(u) for u in rules.SIZE_UNITS]), power)
    shown = F.concat(F.format_string("%.1f", number), F.lit(" "), unit)
    return F.when(size.isNull() | (size == 0), "Unknown").otherwise(shown)


def megabytes_text(size: Column) -> Column:
    return F.format_string("%.2f MB", F.round(size.cast("double") / 1048576.0, 2))


# --- ids, links, seeders --------------------------------------------------


def base_id(full_id: Column) -> Column:
    """"tt<digits>" in front of the first colon, else the id unchanged."""
    head = F.regexp_extract(full_id, r"\A(tt[0-9]+)(?::|\z)", 1)
    return F.when(head == "", full_id).otherwise(head)


def prefix_id(full_id: Column) -> Column:
    return F.nullif(F.regexp_extract(full_id, r"\A(tt[0-9]+)", 1), F.lit(""))


def episode_id(full_id: Column) -> Column:
    """struct<work_id, season, episode>, null unless the id has all three parts."""
    pattern = r"\A(tt[0-9]+):([0-9]+):([0-9]+)\z"
    work = F.regexp_extract(full_id, pattern, 1)
    value = F.struct(
        work.alias("work_id"),
        number_in(full_id, pattern, 2).alias("season"),
        number_in(full_id, pattern, 3).alias("episode"),
    )
    return F.when(work != "", value)


def content_hash(link: Column, marker: str = "btih:") -> Column:
    """Hash after the marker, lower-cased; null when there is none."""
    found = F.regexp_extract(link, f"(?i){marker}([a-zA-Z0-9]+)", 1)
    return F.lower(F.nullif(found, F.lit("")))


def link_sources(link: Column, prefix: str = "magnet:", marker: str = "btih:") -> Column:
    """Source list of a delivered row: the content hash for hash links, else the link itself."""
    by_hash = F.concat(F.lit("dht:"), content_hash(link, marker))
    return F.array(F.when(F.startswith(link, F.lit(prefix)), by_hash).otherwise(link))


def display_name(link: Column, default: str = rules.DEFAULT_TITLE) -> Column:
    """Decoded dn= parameter with separators as spaces.

    Broken percent escapes give the default, as does a missing parameter.
    """
    raw = F.nullif(F.regexp_extract(link, "dn=([^&]+)", 1), F.lit(""))
    decoded = F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))
    return F.coalesce(collapse_space(F.regexp_replace(decoded, "[._+]", " ")), F.lit(default))


def repeated_parameter(link: Column, name: str) -> Column:
    """All values of a repeated query parameter, in order."""
    return F.regexp_extract_all(link, F.lit(f"[?&]{name}=([^&#]*)"), 1)


def seeders_number(text: Column, default: int = rules.DEFAULT_SEEDERS) -> Column:
    """Leading integer of a text; the default for blank, bad or negative text."""
    value = number_in(text, r"\A\s*([+-]?[0-9]+)")
    return F.coalesce(F.when(value >= 0, value), F.lit(default).cast("bigint"))


# --- score, key, variants -------------------------------------------------


def title_bonus(title: Column) -> Column:
    """Part of the relevance score that depends on the title alone."""
    t = F.lower(title)
    pattern, points = rules.TITLE_BONUS_PATTERN
    bonus = F.when(t.rlike(pattern), points).otherwise(0)
    for words, more in rules.TITLE_BONUS_WORDS:
        bonus = bonus + F.when(_has_any(t, *words), more).otherwise(0)
    return bonus


def relevance_score(tier_col: Column, confidence: Column, title: Column, seeders: Column) -> Column:
    """Tier base + 200 x confidence + title bonus + up to 50 for seeders, rounded."""
    base = table_value(tier_col, rules.SEARCH_TIER_BASE, rules.SEARCH_TIER_BASE_DEFAULT)
    popularity = F.when(seeders > 0, F.least(seeders * F.lit(0.5), F.lit(50.0))).otherwise(0.0)
    return F.round(base + confidence * 200 + title_bonus(title) + popularity).cast("int")


def request_key(parts: Sequence[Column], url: Column | None = None) -> Column:
    """Non-empty parts joined by "|", or the URL when there is one."""
    filled = [F.nullif(p.cast("string"), F.lit("")) for p in parts]
    key = F.nullif(F.concat_ws("|", *filled), F.lit(""))
    return key if url is None else F.coalesce(F.nullif(url, F.lit("")), key)


def session_key(key: Column) -> Column:
    return F.concat(F.lit("session_"), F.lower(F.hex(F.xxhash64(key))))


def query_variants(title: Column, season: Column) -> Column:
    """Array of the distinct texts to search for one wanted title."""
    bare = title
    for pattern in (r"(?i)temporada\s*\d+", r"(?i)season\s*\d+"):
        bare = F.regexp_replace(bare, pattern, "")
    bare = collapse_space(bare)
    n = season.cast("string")
    named = F.array(
        title,
        F.concat(bare, F.lit(" Temporada "), n),
        F.concat(bare, F.lit(" Season "), n),
        F.concat(bare, F.lit(" S"), n),
    )
    plain = F.array(title, F.concat(F.lit("Temporada "), n), F.concat(F.lit("Season "), n))
    return F.array_distinct(
        F.when(season.isNull() | (season == 0), F.array(title))
        .when(F.length(bare) < 2, plain)
        .otherwise(named)
    )
