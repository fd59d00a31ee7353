import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from titleloom import schemas
from titleloom.sources import catalogue, pages, payloads


def test_read_catalogue_splits_and_defaults(spark, tmp_path):
    good = {"imdbId": "tt1:1:1", "title": "A", "magnet": "magnet:?a", "quality": "4K", "seeds": 3}
    doc = {"version": "1", "magnets": [good, {**good, "seeds": 0}, {**good, "magnet": "x", "addedAt": "2024-05-01T00:00:00.000Z"}]}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"version": "1"}))
    as_of = F.lit("2024-01-01 00:00:00")
    ok, bad = catalogue.read_catalogue(spark, str(tmp_path), as_of)
    assert [(r["title"], r["addedAt"]) for r in ok.collect()] == [("A", datetime(2024, 1, 1))]
    assert sorted(r["first_failure"] for r in bad.collect()) == ["link_format", "missing:seeds"]


def test_broken_documents_are_quarantined(spark, tmp_path):
    good = json.dumps({"version": "1", "magnets": [{"imdbId": "tt1:1:1", "title": "A", "magnet": "magnet:?a", "quality": "4K", "seeds": 3}]})
    (tmp_path / "a.json").write_text(good)
    (tmp_path / "b.json").write_text(good[:40])
    (tmp_path / "c.json").write_text("")
    ok, bad = catalogue.read_catalogue(spark, str(tmp_path), F.lit("2024-01-01 00:00:00"))
    assert ok.count() == 1
    assert [(r["title"], r["first_failure"].split("_")[0], list(r["failures"])[0]) for r in bad.collect()] == [(None, "document", bad.first()["first_failure"])]


def test_append_and_load(spark, tmp_path):
    path = str(tmp_path / "c")
    one = spark.createDataFrame([("tt1:1:1", "l", 1, "old", "series")], "work_id STRING, link STRING, at INT, title STRING, type STRING")
    catalogue.append_catalogue(one, path)
    catalogue.append_catalogue(one.withColumn("at", F.lit(2)).withColumn("title", F.lit("new")), path)
    got = catalogue.load_catalogue(spark.read.schema(one.schema).parquet(path), "work_id", "link", ["at"]).collect()
    assert [(r["work_id"], r["title"], r["first_arrival"]["at"]) for r in got] == [("tt1", "new", 1)]


def test_search_payload(spark):
    result = {"title": "[x] A  1080p", "magnet_link": "m", "seed_count": 0, "size": "2 GB", "date": "2024-02-03"}
    body = {"results": [result, {**result, "title": ""}, {**result, "magnet_link": None}, {**result, "seed_count": 9, "size": "", "date": "bad"}]}
    df = spark.createDataFrame([(json.dumps(body), "p", 50), ("{broken", "p", 50), ('{"count": 0}', "p", 50)], "j STRING, provider STRING, base INT")
    rows = payloads.from_search_payload(df, "j", F.lit("2020-01-01")).collect()
    assert [(r["title"], r["seeders"], r["leechers"], r["size_text"], r["updated_at"].year) for r in rows] == [
        ("A 1080p", 65, 0, "2 GB", 2024), ("A 1080p", 9, 0, "Size not specified", 2020),
    ]
    many = spark.createDataFrame([(json.dumps({"results": [result] * 30}), "p", None)], "j STRING, provider STRING, base INT")
    assert payloads.from_search_payload(many, "j", F.lit("2020-01-01")).count() == 30
    assert payloads.from_search_payload(many, "j", F.lit("2020-01-01"), cap=20).count() == 20


def test_post_payload(spark):
    link = "magnet:?xt=urn:btih:abc&dn=n"
    posts = [
        {"title": {"rendered": "Film 4k S2"}, "content": {"rendered": f'1.5 GB <a href="{link}">'}, "modified": "2024-01-02T03:04:05"},
        {"title": {"rendered": "abcd"}, "content": {"rendered": ""}, "modified": ""},
        {"title": {"rendered": "No link here"}, "content": {"rendered": "2 M"}, "modified": "x"},
    ]
    df = spark.createDataFrame([(json.dumps(posts), "p", None)], "j STRING, provider STRING, base INT")
    got = [(r["tier"], r["season"], r["link"], r["size_text"], r["seeders"]) for r in payloads.from_post_payload(df, "j").collect()]
    assert got == [("2160p", 2, link, "1.5 GB", 45), ("HD", None, "", "Size not specified", 33)]


def test_page_title_branches(values):
    rows = [
        '<h1>First</h1><h1 data-testid="hero__pageTitle">Marked (2001) - IMDb</h1>', "<h1 class=a> A &amp; <b>B</b> </h1>",
        '<meta property="og:title" content="Og - IMDb">', '<h1> </h1><script type="application/ld+json">{"name": "Ld"}</script>', "<p>", None,
        '<script type="application/ld+json">{broken</script>',
    ]
    assert values(pages.page_title(F.col("x")), rows) == ["Marked", "A & B", "Og", "Ld", None, None, None]


def test_localized_title(spark):
    df = spark.createDataFrame([("k", "en", "E", 1), ("k", "pt", "P", 2), ("k", "pt", "Q", 3), ("j", "pt", "", 1), ("j", "en", "F", 2), ("z", "de", "D", 1)], "key STRING, lang STRING, title STRING, i INT")
    got = {r["key"]: r["title"] for r in pages.localized_title(df, "key", "lang", "title", ["pt", "en"], "i").collect()}
    assert got == {"k": "P", "j": "F"}


def test_extract_items(spark):
    html = '<li><b>Title one</b><a href="/1"></li><li><b> abc </b><a href="/2"></li><li><b>Third &lt;x&gt;</b></li>'
    df = spark.createDataFrame([(1, "http://a.com/p", html), (2, "http://a.xyz/p", html)], "page_id INT, url STRING, html STRING")
    rules = [{"tld": "com", "priority": 1, "title_regex": "<b>(.*?)</b>", "link_regex": 'href="([^"]+)"'}]
    got = [(r["page_id"], r["position"], r["title"], r["link"]) for r in pages.extract_items(df, rules).orderBy("position").collect()]
    assert got == [(1, 0, "Title one", "/1"), (1, 2, "Third <x>", None)]


def test_items_with_navigation_before_them(spark):
    html = '<nav><a href="/nav">home</a></nav><h2>no</h2><li><b>Title one 2 GB 4k</b><a href="/1"></li><li><b> abc </b><a href="/2"></li><li><a href="/3"><b>Title two</b></li>'
    df = spark.createDataFrame([(1, "http://a.com/p", html)], "page_id INT, url STRING, html STRING")
    rules = [{"tld": "com", "priority": 1, "item_regex": "<li>(.*?)</li>", "title_regex": "<b>(.*?)</b>", "link_regex": 'href="([^"]+)"'}]
    items = pages.extract_items(df, rules)
    assert sorted((r["position"], r["title"], r["link"]) for r in items.collect()) == [(0, "Title one 2 GB 4k", "/1"), (2, "Title two", "/3")]
    rows = payloads.from_items(items.selectExpr("*", "'p' AS provider", "60 AS base"), F.lit("2024-01-01"))
    assert sorted((r["source_row"], r["tier"], r["seeders"], r["size_text"], r["link"]) for r in rows.collect()) == [
        ("1-0", "2160p", 90, "2 GB", "/1"), ("1-2", "HD", 66, "Size not specified", "/3"),
    ]


def test_gather(spark):
    a = spark.createDataFrame([("t", "l")], "title STRING, link STRING")
    out = payloads.gather(a, None, payloads.empty_listings(spark), a.drop("link"))
    assert out.count() == 2 and "tier" in out.columns
    with pytest.raises(ValueError):
        payloads.gather(None)


def test_tables_keep_their_schema(spark, tmp_path):
    for name in ("LISTING", "LISTING_ITEM", "ITEM_ATTACHMENT"):
        schema = getattr(schemas, name)
        path = str(tmp_path / name)
        catalogue.write_table(spark.createDataFrame([], schema), path, schema)
        assert catalogue.read_table(spark, path, schema).schema == schema
