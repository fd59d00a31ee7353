"""Literal rows for every column family, with the odd cases spelled out."""

from pyspark.sql import functions as F

from titleloom import rules
from titleloom.functions import attributes as A
from titleloom.functions import text as X


def x():
    return F.col("x")


def test_normalise_title(values):
    rows = ["O Senhor dos Anéis", "Incrível!", "LEÃO", "a_b  c", "日本", "", "The", "A\u0301bc", None]
    assert values(X.normalise_title(x()), rows) == [
        "senhor  aneis", "incrivel", "leao", "a_b c", "", "", "", "abc", None,
    ]
    assert values(X.single_spaced(X.normalise_title(x())), ["O Senhor dos Anéis"]) == ["senhor aneis"]


def test_clean_titles(values):
    assert values(X.clean_listing_title(x()), ["[a] b  [c] d", "x\u00a0\ty", "[open", None]) == ["b  d", "x y", "[open", None]
    assert values(X.clean_page_title(x()), ["Cars (2006) - IMDb", "A (1999) (2000)", "B - IMDb  "]) == ["Cars", "A (2000)", "B"]
    assert values(X.clean_search_title(x()), ["2006.Cars.1080p+WEB-DL_dual 2007", "Toy-Story"]) == ["Cars 2007", "Toy Story"]
    assert values(X.main_title(x()), ["Show Temporada 2 S3", "Show 2ª temp", "Show season 4 x"]) == ["Show", "Show", "Show x"]


def test_tier(values):
    rows = [
        "x 2160p", "a 4K", "1080P", "720p", "m.web-dl.x", "m.REMUX.x", "Full HD", "Ultra HD", "HD Rip", "uhd", "fhd",
        "ultraxhd", "fullxhd", "hdxrip", "high def", "m.bluray.x", "m.hdtv.x", "m.bdrip.x", "remux", "web-dl", "hdtv",
        "480p", "éhd", "hdé", None,
    ]
    assert values(A.tier(x()), rows) == [
        "2160p", "2160p", "1080p", "720p", "1080p", "2160p", "HD", "HD", "HD", "2160p", "1080p",
        "2160p", "1080p", "720p", "HD", "1080p", "720p", "1080p", "1080p", "1080p", "720p",
        "HD", "HD", "HD", "HD",
    ]


def test_other_tiers(values):
    assert values(A.simple_tier(x()), ["4k", "1080p 720p", "480P", "?"]) == ["2160p", "1080p", "480p", "HD"]
    assert values(A.curated_tier(x()), ["2160p 720p", "4K", "wednesday", "none", "720P"]) == ["4K", "4k", "sd", "1080p", "720p"]
    rows = ["4k", "1080p", "720p", "480p", "bluray", "dvdrip", "x"]
    assert values(A.tier_score(x()), rows) == [100, 80, 60, 40, 30, 20, 10]


def test_language(values):
    rows = ["Dual dublado", "DUBLADO", "legendado", "English", "x"]
    assert values(A.language_tag(x()), rows) == ["pt-BR,en", "pt-BR", "pt", "pt-BR", "pt-BR"]
    assert values(A.language_tag(x(), rules.LANGUAGE_KEYWORDS_WITH_ENGLISH), rows)[3] == "en"
    assert values(A.language_list(x()), ["a, b,c"]) == [["a", "b", "c"]]
    got = values(X.language_evidence(x()), ["São", "um o b", "abc", "abcd"])
    assert [tuple(r) for r in got] == [
        (True, False, False, True), (False, True, True, True), (False, False, False, False), (False, False, True, True),
    ]


def test_season(values):
    rows = ["Temporada 3", "2 temporada", "season04", "S05E01", "7ª temp", "temporada 0 s9", "none", "s99999999999999999999"]
    assert values(A.season_number(x()), rows) == [3, 2, 4, 5, 7, 9, None, None]


def test_ordinal(values):
    rows = ["3x07.mkv", "S02E11", "season 1 episode 2", "ep.9", "4 - 12", "105", "7", "none", "x8y"]
    got = [tuple(r) for r in values(A.ordinal(x()), rows)]
    assert got == [
        (3, 7, "3x07"), (2, 11, "S02E11"), (1, 1, "season 1 episode 2"), (1, 9, "ep.9"), (4, 12, "4 - 12"),
        (10, 5, "105"), (1, 7, "7"), (1, 0, "unknown"), (1, 8, "8"),
    ]
    fixed = values(A.ordinal(x(), fix_season_episode=True), ["season 3 episode 2"])
    assert tuple(fixed[0]) == (3, 2, "season 3 episode 2")


def test_sizes(values):
    rows = ["2 GB", "1.5GiB", "700 mb", "1,5 GB", "?", "", None, "3M"]
    g = 1024.0 ** 3
    assert values(A.size_bytes(x()), rows) == [2 * g, 1.5 * g, 700 * 1024.0 ** 2, 5 * g, 1.5 * g, 1.5 * g, 1.5 * g, 3 * 1024.0 ** 2]
    assert values(A.size_text_in_title(x()), ["Shrek 2 Movie", "x 5 GiB", "n"]) == ["2 M", "5 GIB", "Size not specified"]
    assert values(A.size_text_in_content(x()), ["Shrek 2 Movie", "x 5 gib"]) == ["Size not specified", "5 GIB"]
    numbers = ["0", None, "1", "1280", "1048576", "1073741824", "5497558138880"]
    assert values(A.bytes_text(x().cast("bigint")), numbers) == [
        "Unknown", "Unknown", "1.0 B", "1.3 KB", "1.0 MB", "1.0 GB", "5.0 TB",
    ]
    assert values(A.megabytes_text(x().cast("bigint")), ["1048576", "5000"]) == ["1.00 MB", "0.00 MB"]


def test_ids(values):
    rows = ["tt12:1:2", "tt12", "tt12x:1", "kitsu:1", "tt5:1"]
    assert values(A.base_id(x()), rows) == ["tt12", "tt12", "tt12x:1", "kitsu:1", "tt5"]
    assert values(A.prefix_id(x()), rows) == ["tt12", "tt12", "tt12", None, "tt5"]
    got = values(A.episode_id(x()), rows)
    assert tuple(got[0]) == ("tt12", 1, 2) and got[1:] == [None] * 4


def test_link_attributes(values):
    rows = ["m:?xt=urn:BTIH:ABC1&dn=A.b%20c+d_e&tr=u1&tr=u2", "m:?dn=%E0%A4%A&tr=z", "m:?dn=bad%zz", "none"]
    assert values(A.content_hash(x()), rows) == ["abc1", None, None, None]
    assert values(A.display_name(x()), rows)[0] == "A b c d e"
    assert values(A.display_name(x()), rows)[2:] == [rules.DEFAULT_TITLE] * 2
    assert values(A.repeated_parameter(x(), "tr"), rows)[0] == ["u1", "u2"]
    assert values(A.link_sources(x(), "m:"), ["m:?x=btih:AB1&y", "http://a"]) == [["dht:ab1"], ["http://a"]]


def test_seeders(values):
    assert values(A.seeders_number(x()), ["12", " 7 up", "", "-3", "x", "0", None]) == [12, 7, 50, 50, 50, 0, 50]


def test_links_in_text(values):
    found = X.links(x(), r"m:\?[^\"'\s<>]+")
    rows = ["a m:?bb m:?cc m:?d", "none"]
    assert values(X.longest_link(found), rows) == ["m:?bb", None]
    assert values(X.first_link(found), rows) == ["m:?bb", None]
    best = X.best_link(x(), r"m:\?[^\s]+", ("h=", "&n="), (r"m:\?h=[a-z]+&n=[a-z]+", r"m:\?h=[a-z]+"))
    assert values(best, ["m:?h=a&n=b m:?h=a", "m:?zzzzzzzzzzzz m:?h=a", "m:?q"]) == ["m:?h=a&n=b", "m:?h=a", None]


def test_masking(values):
    assert values(X.mask_key(x()), ["abcdefghijklmnop", "", None]) == ["abcdefgh...mnop", "unknown", "unknown"]
    assert values(X.mask_id(x()), ["abcdefghij"]) == ["abcdefgh..."]
    two = ["at 1.2.3.4 and 5.6.7.8"]
    assert values(X.mask_address(x()), two) == ["at 1.2.***.*** and 5.6.7.8"]
    assert values(X.mask_address(x(), all_matches=True), two) == ["at 1.2.***.*** and 5.6.***.***"]
    rows = ["https://Host.x/p/q?k=1#f", "http://u:p@h", "nonsense", None]
    assert values(X.mask_url(x()), rows) == ["https://host.x/p/q?***", "http://h/?***", "invalid_url", "unknown"]
    assert values(X.cut_text(x()), ["a" * 50, "a" * 51]) == ["a" * 50, "a" * 50 + "..."]
    assert values(X.cut_link(x()), ["a" * 50, "a" * 51]) == ["a" * 50, "a" * 47 + "..."]


def test_request_key_and_variants(spark, values):
    assert values(A.request_key([x(), F.lit(None), F.lit("t")]), ["a", ""]) == ["a|t", "t"]
    assert values(A.request_key([F.lit("a")], x()), ["u", ""]) == ["u", "a"]
    rows = ["Show", "Season 3", "S"]
    assert values(A.query_variants(x(), F.lit(2)), rows) == [
        ["Show", "Show Temporada 2", "Show Season 2", "Show S2"],
        ["Season 3", "Temporada 2", "Season 2"],
        ["S", "Temporada 2", "Season 2"],
    ]
    assert values(A.query_variants(x(), F.lit(None).cast("int")), ["Show"]) == [["Show"]]


def test_relevance_score(spark):
    df = spark.createDataFrame([("x dual bluray s1e2", "2160p", 0.95, 200), ("x", "HD", 0.8, 0)], "t STRING, q STRING, c DOUBLE, s INT")
    score = A.relevance_score(F.col("q"), F.col("c"), F.col("t"), F.col("s"))
    assert [r[0] for r in df.select(score).collect()] == [400 + 190 + 25 + 20 + 50 + 15, 150 + 160]
