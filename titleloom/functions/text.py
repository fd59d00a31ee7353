"""Title and page text: normalising, cleaning, links, masking."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titleloom import rules

# White space beyond Java's ASCII \s.
WIDE_SPACES = "\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def _fold_map() -> tuple[str, str]:
    """Letters that decompose to one ASCII letter plus combining marks."""
    src, dst = [], []
    for code in range(0xC0, 0x10000):
        if 0xD800 <= code <= 0xDFFF:
            continue
        char = chr(code)
        base = [c for c in unicodedata.normalize("NFD", char) if not 0x300 <= ord(c) <= 0x36F]
        if len(base) == 1 and base[0] != char and base[0].isascii():
            src.append(char)
            dst.append(base[0])
    return "".join(src), "".join(dst)


_FOLD_FROM, _FOLD_TO = _fold_map()


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value written and evaluated a single time.

    Naming an expression several times in branches repeats it in the plan; here
    it is bound to a lambda variable instead.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def alternation(words: Iterable[str]) -> str:
    """Regex alternation of literal words (safe in Java and RE2)."""
    return "|".join(re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", w) for w in words)


def is_ascii(c: Column) -> Column:
    """One byte per character; much cheaper than walking the text with translate()."""
    return F.length(c) == F.octet_length(c)


def _by_first_letter(words: Iterable[str]) -> str:
    """Alternation that fails on the first letter instead of trying every word."""
    tails: dict[str, list[str]] = {}
    for word in words:
        tails.setdefault(word[0], []).append(word[1:])
    return "|".join(alternation([letter]) + f"(?:{alternation(ends)})" for letter, ends in tails.items())


def strip_marks(c: Column) -> Column:
    """Fold accented Latin letters to ASCII and drop combining marks."""

    def fold(x: Column) -> Column:
        return F.regexp_replace(F.translate(x, _FOLD_FROM, _FOLD_TO), r"[\u0300-\u036f]", "")

    return once(c, lambda x: F.when(is_ascii(x), x).otherwise(fold(x)))


def narrow_space(c: Column) -> Column:
    """Any Unicode white space as a plain space; far cheaper than a wide regex class."""
    spaces = " " * len(WIDE_SPACES)
    return once(c, lambda x: F.when(is_ascii(x), x).otherwise(F.translate(x, WIDE_SPACES, spaces)))


def single_space(c: Column) -> Column:
    """Runs of white space as one space. Lone plain spaces do not match, so most rows stay as they are, without the regex."""

    def squeeze(x: Column) -> Column:
        plain = ~F.contains(x, F.lit("  "))
        for space in "\t\n\x0b\f\r":
            plain = plain & ~F.contains(x, F.lit(space))
        return F.when(plain, x).otherwise(F.regexp_replace(x, r"\s{2,}|[\t\n\x0B\f\r]", " "))

    return once(narrow_space(c), squeeze)


def collapse_space(c: Column) -> Column:
    return F.trim(single_space(c))


def normalise_title(c: Column, stop_words: Sequence[str] = rules.STOP_WORDS) -> Column:
    """Lower-case ASCII words without stop words.

    Deleting a stop word leaves the spaces around it, so inner double spaces
    are part of the result ("senhor dos aneis" -> "senhor  aneis").
    """
    words = F.regexp_replace(strip_marks(F.lower(c)), "[^A-Za-z0-9_]+", " ")
    return F.trim(F.regexp_replace(words, rf"\b(?:{_by_first_letter(stop_words)})\b", ""))


def single_spaced(normalised: Column) -> Column:
    return F.trim(F.regexp_replace(normalised, " {2,}", " "))


def replace_first(c: Column, pattern: str, replacement: str = "") -> Column:
    return F.array_join(F.split(c, pattern, 2), replacement)


def clean_listing_title(c: Column) -> Column:
    """Collapse white space, then drop bracketed tags (may leave two spaces)."""
    return F.trim(F.regexp_replace(single_space(c), r"\[[^\]]*\]", ""))


def clean_page_title(c: Column, site_suffix: str = "IMDb") -> Column:
    """Drop the site suffix and the first "(dddd)", then collapse."""
    tail = alternation([site_suffix])
    c = F.regexp_replace(c, rf"- {tail}\z", "")
    c = replace_first(c, rules.YEAR_IN_BRACKETS)
    return collapse_space(F.regexp_replace(narrow_space(c), rf"\s*-\s*{tail}\s*\z", ""))


def clean_search_title(c: Column, words: Sequence[str] = rules.SEARCH_FORMAT_WORDS) -> Column:
    """Drop the first four digits and format words, separators to spaces."""
    c = F.regexp_replace(replace_first(c, "[0-9]{4}"), f"(?i){alternation(words)}", "")
    return collapse_space(F.regexp_replace(c, rules.TITLE_SEPARATORS, " "))


def main_title(c: Column) -> Column:
    """Title without its season phrases."""
    for pattern in rules.SEASON_PHRASES:
        c = F.regexp_replace(c, pattern, "")
    return collapse_space(c)


def language_evidence(c: Column) -> Column:
    """struct<has_accents, has_function_words, is_long, accepted>."""
    low = F.lower(c)
    accents = low.rlike(f"[{rules.ACCENTED_LETTERS}]")
    words = low.rlike(f" (?:{alternation(rules.FUNCTION_WORDS)}) ")
    is_long = F.length(low) > 3
    return F.struct(
        accents.alias("has_accents"),
        words.alias("has_function_words"),
        is_long.alias("is_long"),
        (accents | words | is_long).alias("accepted"),
    )


# --- links in text --------------------------------------------------------


def links(text: Column, pattern: str, group: int = 0) -> Column:
    """All links of a pattern in order of appearance."""
    return F.regexp_extract_all(text, F.lit(pattern), group)


def first_link(found: Column) -> Column:
    return F.get(found, F.lit(0))


def each_link(df: DataFrame, found: Column, *keep: str) -> DataFrame:
    """One row per link with its position; rows without links drop out.

    The outer form keeps Spark from extracting the links twice (explode infers
    a filter on the list).
    """
    rows = df.select(*keep, found.alias("_found"))
    out = rows.select(*keep, F.posexplode_outer("_found").alias("position", "link"), F.get("_found", F.lit(0)).alias("first_link"))
    return out.where(F.col("link").isNotNull())


def longest_link(found: Column) -> Column:
    """Longest link, the first one on ties; no shuffle, it stays in the row."""
    ranked = F.transform(
        found, lambda x, i: F.struct(F.length(x).alias("len"), (-i).alias("neg"), x.alias("link"))
    )
    return F.array_max(ranked)["link"]


def best_link(text: Column, pattern: str, markers: Sequence[str], fallbacks: Sequence[str]) -> Column:
    """Longest link if it holds all markers, else the first fallback pattern that hits."""
    best = longest_link(links(text, pattern))
    complete = F.lit(True)
    for marker in markers:
        complete = complete & F.contains(best, F.lit(marker))
    hits = [F.nullif(F.regexp_extract(text, p, 0), F.lit("")) for p in fallbacks]
    return F.coalesce(F.when(complete, best), *hits)


# --- masking --------------------------------------------------------------


def _missing(c: Column) -> Column:
    return c.isNull() | (c == "")


def mask_key(c: Column) -> Column:
    shown = F.concat(F.substring(c, 1, 8), F.lit("..."), F.right(c, F.lit(4)))
    return F.when(_missing(c), "unknown").otherwise(shown)


def mask_id(c: Column) -> Column:
    return F.when(_missing(c), "unknown").otherwise(F.concat(F.substring(c, 1, 8), F.lit("...")))


_ADDRESS = r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)"


def mask_address(c: Column, all_matches: bool = False) -> Column:
    """Keep two octets of the first (or of every) dotted address."""
    if all_matches:
        masked = F.regexp_replace(c, _ADDRESS, "$1.$2.***.***")
    else:
        masked = F.regexp_replace(c, rf"(?s)\A(.*?){_ADDRESS}", "$1$2.$3.***.***")
    return F.when(_missing(c), "unknown").otherwise(masked)


def mask_url(c: Column) -> Column:
    """Origin and path only; text that is no URL becomes "invalid_url"."""
    pattern = r"^([A-Za-z][A-Za-z0-9+.-]*://)(?:[^/?#@]*@)?([^/?#]+)([^?#]*)"
    host = F.regexp_extract(c, pattern, 2)
    path = F.regexp_extract(c, pattern, 3)
    shown = F.concat(
        F.lower(F.regexp_extract(c, pattern, 1)), F.lower(host),
        F.when(path == "", "/").otherwise(path), F.lit("?***"),
    )
    return F.when(_missing(c), "unknown").when(host == "", "invalid_url").otherwise(shown)


def cut_text(c: Column, limit: int = 50) -> Column:
    """At most limit characters and "..." when something was cut."""
    cut = F.concat(F.substring(c, 1, limit), F.lit("..."))
    return F.when(_missing(c), "unknown").when(F.length(c) > limit, cut).otherwise(c)


def cut_link(c: Column, limit: int = 50) -> Column:
    """At most limit characters with the "..." included."""
    return F.when(F.length(c) <= limit, c).otherwise(
        F.concat(F.substring(c, 1, limit - 3), F.lit("..."))
    )
