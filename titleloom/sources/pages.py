"""Titles and items read from HTML pages by regex rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titleloom import rules
from titleloom.functions.text import clean_page_title, narrow_space
from titleloom.operators.rank import top_k


def trimmed(c: Column) -> Column:
    return F.regexp_replace(narrow_space(c), r"\A\s+|\s+\z", "")


def plain_text(html: Column) -> Column:
    """Inner text of a fragment: tags dropped, the five basic entities decoded."""
    text = F.regexp_replace(html, "<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def page_title(html: Column, marker: str = "hero__pageTitle", site_suffix: str = "IMDb") -> Column:
    """First of: marked h1, first h1, og:title, JSON-LD name; then cleaned."""
    marked = rf"""(?is)<h1\b[^>]*data-testid="{marker}"[^>]*>(.*?)</h1>"""
    og = r"""(?is)<meta\b[^>]*property="og:title"[^>]*content="([^"]*)\""""
    ld = r"""(?is)<script\b[^>]*type="application/ld\+json"[^>]*>(.*?)</script>"""

    def filled(c: Column) -> Column:
        return F.nullif(c, F.lit(""))

    title = F.coalesce(
        filled(trimmed(plain_text(F.regexp_extract(html, marked, 1)))),
        filled(trimmed(plain_text(F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1)))),
        filled(plain_text(F.regexp_extract(html, og, 1))),
        filled(F.get_json_object(F.regexp_extract(html, ld, 1), "$.name")),
    )
    return clean_page_title(title, site_suffix)


def page_language(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"\A[a-z]+://[^/]+/([a-z]{2})/", 1), F.lit(""))


def localized_title(
    pages: DataFrame, key: str, language: str, title: str, prefer: Sequence[str], tie: str
) -> DataFrame:
    """One title per key: the most preferred language that has one.

    Pages in a language outside prefer or without a title do not take part.
    """
    place = F.array_position(F.array(*[F.lit(p) for p in prefer]), F.col(language))
    usable = (place > 0) & (F.col(title) != "")
    entry = F.struct(place.alias("place"), F.col(tie).alias("tie"), F.col(language), F.col(title))
    # rows that do not take part are null here, and min skips nulls
    first = pages.groupBy(key).agg(F.min(F.when(usable, entry)).alias("row"))
    return first.where(F.col("row").isNotNull()).select(key, f"row.{language}", f"row.{title}")


def page_host(url: Column) -> Column:
    return F.regexp_extract(url, r"\A[a-z]+://([^/?#]+)", 1)


def _paired(titles: Column, urls: Column) -> Column:
    return F.transform(titles, lambda t, i: F.struct(t.alias("title"), F.get(urls, i).alias("link")))


def _inside(items: Column, rule: dict) -> Column:
    def first(item: Column, pattern: str) -> Column:
        return F.nullif(F.regexp_extract(item, "(?s)" + pattern, 1), F.lit(""))

    return F.transform(items, lambda i: F.struct(first(i, rule["title_regex"]).alias("title"), first(i, rule["link_regex"]).alias("link")))


def extract_items(pages: DataFrame, site_rules: Sequence[dict], min_length: int = rules.MIN_TITLE_LENGTH) -> DataFrame:
    """Items of pages by site rule: page_id, tld, priority, position, title, link.

    site_rules: tld, priority, title_regex, link_regex. They are a handful of
    settings, so they become CASE branches and patterns stay constant (a
    pattern column would be compiled again for every row). With item_regex the
    items are its matches, and title and link are looked for inside each, so
    links elsewhere on the page never shift them. Without it item i pairs the
    page's title i with its link i. A title below min_length drops the item.
    """
    tld = F.regexp_extract(page_host(F.col("url")), r"\.([a-z]+)\z", 1)
    found = None
    for rule in site_rules:
        if "item_regex" in rule:
            items = _inside(F.regexp_extract_all("html", F.lit("(?s)" + rule["item_regex"]), 1), rule)
        else:
            titles = F.regexp_extract_all("html", F.lit("(?s)" + rule["title_regex"]), 1)
            urls = F.regexp_extract_all("html", F.lit("(?s)" + rule["link_regex"]), 1)
            items = _paired(titles, urls)
        branch = F.struct(F.lit(rule["priority"]).alias("priority"), items.alias("items"))
        hit = tld == rule["tld"]
        found = F.when(hit, branch) if found is None else found.when(hit, branch)
    rows = pages.select("page_id", tld.alias("tld"), found.alias("found"))
    # outer: posexplode would infer a filter that extracts everything twice; pages
    # without items fall to the length filter
    exploded = rows.select("page_id", "tld", F.col("found.priority").alias("priority"), F.posexplode_outer("found.items"))
    title = trimmed(plain_text(F.col("col.title")))
    return exploded.select(
        "page_id", "tld", "priority", F.col("pos").alias("position"), title.alias("title"), F.col("col.link").alias("link")
    ).where(F.length("title") >= min_length)


def first_of_source(df: DataFrame, source: str, order: Sequence[str], cap: int = rules.SOURCE_CAP) -> DataFrame:
    """The first cap rows of every source by position."""
    return top_k(df, [source], [F.col(c).asc() for c in order], cap)
