from pyspark.sql import functions as F

from titleloom import rules
from titleloom.operators import quality


def x():
    return F.col("x")


def test_gate_reports_each_rule(spark):
    rows = [
        ("tt1", "t", "m:?a", "4K", 5), ("tt1", "", "m:?a", "4K", 5), ("tt1", "t", "http", "4K", 5), ("xx1", "t", "m:?a", "4K", 5),
        ("tt1", "t", "m:?a", "4k", 5), ("tt1", "t", "m:?a", "SD", 0), ("tt1", "t", "m:?a", "SD", -1), (None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "id STRING, title STRING, link STRING, tier STRING, seeds INT")
    gated = quality.gate(df, ["id", "title", "link", "tier", "seeds"], "link", "id", "tier", "seeds", "m:?")
    got = [r["failures"] for r in gated.collect()]
    assert got[:7] == [[], ["missing:title"], ["link_format"], ["id_format"], ["tier"], ["missing:seeds"], ["negative_seeds"]]
    assert got[7][0] == "missing:id" and "tier" in got[7]
    assert quality.good(gated).count() == 1 and quality.quarantine(gated).count() == 7


def test_blocked(values):
    assert values(quality.blocked(x()), ["better", "Alphabet", "BÔNUS", "fine"]) == [True, True, True, False]
    assert values(quality.blocked(x(), whole_word=True), ["better", "a BET!", "fine"]) == [False, True, False]
    assert values(quality.blocked(x(), rules.BLOCKED_FILE_KEYWORDS), ["Teaser.mkv", "casino"]) == [True, False]


def test_links_suffixes_words(values):
    long = "m:xt=urn:" + "a" * 60
    assert values(quality.valid_link(x(), "m:", "xt=urn:"), [long, "m:xt=urn:a", None]) == [True, False, False]
    assert values(quality.valid_link(x(), "m:", "xt=urn:", None), ["m:xt=urn:a"]) == [True]
    assert values(quality.allowed_suffix(x()), ["a.MKV", "a.mkv.txt", "mkv", "a.ts\n"]) == [True, False, False, False]
    assert values(quality.any_word(x(), "To the Moon+"), ["moon+x", "moon", "gather"]) == [True, False, True]
    assert values(quality.any_word(x(), "a to"), ["a to"]) == [False]
    rows = ["x S2 y", "temporada 2", "Season2!", "s21", "seasons 2", "és2"]
    assert values(quality.season_mentioned(x(), F.lit(2)), rows) == [True, True, True, False, False, True]


def test_supported(values):
    assert values(quality.all_supported(F.split(x(), ",")), ["pt,en", "pt,xx", "dual"]) == [True, False, True]
