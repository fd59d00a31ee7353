"""Linkage and substring joins against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from titleloom import rules
from titleloom.functions import attributes as A
from titleloom.operators import link


def wanted_match(qn, raw_title, rn):
    """Plain model of the match rules for one pair."""
    if any(k in rn for k in rules.BLOCKED_KEYWORDS) or any(k in raw_title.lower() for k in rules.BLOCKED_KEYWORDS):
        return None
    qc, rc = " ".join(qn.split()), " ".join(rn.split())
    if qc == rc:
        return "exact-clean", 1.0
    words = [w for w in qc.split(" ") if len(w) > 2]
    found = [w for w in rc.split(" ") if len(w) > 2]
    phrases = []
    if words:
        phrases.append(qc)
        if len(words) > 1:
            phrases.append(" ".join(words[:4]))
        if len(words) >= 3:
            phrases.append(" ".join(words[::2]))
        phrases += [w for w in words if len(w) > 3]
    for p in phrases:
        if re.search(rf"\b{re.escape(p)}\b", rc, re.ASCII):
            share = min(len(p) / len(qn), 1.0)
            return ("exact", max(share, 0.95)) if len(p) > 0.8 * len(qn) else ("partial", max(share, 0.8))
    shared = sum(w in found for w in words)
    foreign = [w for w in found if w not in words and len(w) > 3]
    if len(words) >= 3:
        if shared == len(words):
            return "exact-words", 1.0
        if shared >= 0.9 * len(words) and not foreign:
            return "strict-keyword", max(shared / len(words), 0.9)
    if len(words) == 2 and shared == 2:
        return "exact-short", 1.0
    return None


def random_titles(rng, vocabulary, n, longest):
    return sorted({" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, longest))) for _ in range(n)})


def test_linkage_equals_brute_force(spark):
    rng = random.Random(7)
    vocabulary = ["red", "fox", "sun", "sky", "old", "one", "blue", "castle", "winter", "o", "de", "tv", "4k", "bet", "mon_o", "ab", "zed", "lee"]
    short = [w for w in vocabulary if len(w) <= 3]
    queries = random_titles(rng, vocabulary, 120, 5) + random_titles(rng, short, 60, 12) + ["red fox sun", "sky old", "fox"]
    titles = random_titles(rng, vocabulary, 300, 6) + random_titles(rng, short, 200, 14)
    q = spark.createDataFrame([(t, t) for t in sorted(set(queries))], "query_id STRING, title STRING")
    t = spark.createDataFrame([(x,) for x in sorted(set(titles))], "title STRING")
    got = {(r[0], r[1]): (r[2], round(r[3], 9)) for r in link.link_titles(q, t).collect()}

    def norm(s):
        s = re.sub(r"[^a-z0-9_]+", " ", s.lower())
        return re.sub(rf"\b(?:{'|'.join(rules.STOP_WORDS)})\b", "", s, flags=re.ASCII).strip()

    want = {}
    for a in set(queries):
        for b in set(titles):
            hit = wanted_match(norm(a), b, norm(b))
            if hit:
                want[(a, b)] = (hit[0], round(hit[1], 9))
    assert got == want
    assert {"exact-clean", "exact", "partial", "exact-words", "exact-short"} <= {v[0] for v in want.values()}


def test_linkage_returns_each_pair_once(spark):
    q = spark.createDataFrame([(1, "winter castle fox")], "query_id INT, title STRING")
    t = spark.createDataFrame([("winter castle fox blue",), ("fox",)], "title STRING")
    rows = link.link_titles(q, t).collect()
    assert [(r["title"], r["match_type"]) for r in rows] == [("winter castle fox blue", "exact")]


def test_strict_keyword_through_the_blocking_prefix(spark):
    """A title that lacks the first word can still match; the prefix must reach the second."""
    words = ["aaa", "bbb", "ccc", "ddd", "eee", "fff", "ggg", "hhh", "iii", "jjj"]
    q = spark.createDataFrame([(1, " ".join(words))], "query_id INT, title STRING")
    t = spark.createDataFrame([(" ".join(reversed(words[1:])),), (" ".join(reversed(words[2:])),)], "title STRING")
    rows = link.link_titles(q, t).collect()
    assert [(r["match_type"], r["confidence"]) for r in rows] == [("strict-keyword", 0.9)]


def test_contains_join_equals_brute_force(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcé \n") for _ in range(rng.randint(0, 40))) for _ in range(200)] + ["", "😀abcdefghij", None]
    needles = ["".join(rng.choice("abcé ") for _ in range(n)) for n in (1, 2, 3, 4, 7, 8, 9, 12) for _ in range(6)]
    needles += ["a longestword b", "xa longestword bx", "longestword", " longestword "]
    texts += ["a longestword b", "xxa longestword bxx", "alongestwordb", "longestword  longestword"]
    needles += [t[5:16] for t in texts[:40] if t and len(t) > 20] + ["", "😀", "😀abcdefgh", None]
    a = spark.createDataFrame([(n,) for n in sorted(set(n for n in needles if n is not None))] + [(None,)], "n STRING")
    b = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    got = sorted((r["n"], r["i"]) for r in link.contains_join(a, b, "n", "t").collect())
    want = sorted((n, i) for n in set(needles) if n for i, t in enumerate(texts) if t and n in t)
    assert got == want
    joined = link.contains_join(a, b, "n", "t", key="i")
    assert sorted((r["n"], r["i"]) for r in joined.collect()) == want


def test_any_word_join(spark):
    q = spark.createDataFrame([(1, "To the Moon moon"), (2, "ab c")], "query_id INT, title STRING")
    t = spark.createDataFrame([("MOONRISE",), ("gather",), ("x",)], "title STRING")
    got = sorted((r[0], r[1]) for r in link.any_word_join(q, t).collect())
    assert got == [(1, "MOONRISE"), (1, "gather")]


def test_id_then_title(spark):
    requests = spark.createDataFrame([("a", "tt1", "zzz"), ("b", "tt9", "Red"), ("c", None, "red f"), ("d", "tt9", "")], "request_id STRING, work_id STRING, wanted STRING")
    listings = spark.createDataFrame([("k1", "tt1", "Red Fox"), ("k2", "tt2", "Blue")], "row_key STRING, work_id STRING, raw_title STRING")
    got = sorted((r["request_id"], r["row_key"], r["via"]) for r in link.id_then_title(requests, listings, "work_id", "raw_title").collect())
    assert got == [("a", "k1", "id"), ("b", "k1", "title"), ("c", "k1", "title")]


@pytest.mark.parametrize("size", [1, 64, 65, 500])
def test_dictionary_of_any_size(spark, size):
    words = ["red bolt", "bolt", "ring", "gear"][: max(1, min(4, size))] + [f"zz{i}" for i in range(size - 4)]
    dictionary = spark.createDataFrame([(i, w, i * 10) for i, w in enumerate(words)], "priority INT, phrase STRING, dict_id INT")
    df = spark.createDataFrame([("a red bolt",), ("bolts and ring",), ("earring",), ("none",), (None,)], "t STRING")
    want = {t: next((10 * i for i, w in enumerate(words) if t and w in t), None) for t in ("a red bolt", "bolts and ring", "earring", "none", None)}
    for key in (None, "t"):
        tagged = link.tag_by_dictionary(df, dictionary, "t", key=key)
        assert {r["t"]: r["tag"] for r in tagged.collect()} == want and tagged.schema["tag"].dataType.simpleString() == "int"
    made = link.tag_by_dictionary(df, dictionary, "t", generated_from="t").where("t = 'none'").first()["tag"]
    assert made.startswith("auto-") and len(made) == 17


def test_dictionary_rows_without_priority_or_id_take_no_part(spark):
    rows = [(None, "red", "x"), (1, "red", None), (3, "bolt", "b"), (2, "gear", "a"), (2, "gear", "c"), (0, None, "n"), (0, "", "e")]
    dictionary = spark.createDataFrame(rows, "priority INT, phrase STRING, dict_id STRING")
    df = spark.createDataFrame([("red bolt gear",), ("red bolt",), ("red",)], "t STRING")
    assert {r["t"]: r["tag"] for r in link.tag_by_dictionary(df, dictionary, "t").collect()} == {"red bolt gear": "a", "red bolt": "b", "red": None}
    none = link.tag_by_dictionary(df, dictionary.limit(0), "t")
    assert {r["tag"] for r in none.collect()} == {None} and none.schema["tag"].dataType.simpleString() == "string"


def test_tier_property(spark):
    """Random titles against the ordered rule list behind the closed form."""
    rng = random.Random(11)
    parts = ["2160p", "4k", "1080p", "720p", "480p", ".web-dl.", ".remux.", " hd ", "uhd", "fhd", "ultra hd", "full hd", "hd rip", "high def", ".bluray.", ".hdtv.", ".bdrip.", "remux", "bluray", "hdtv", "x", ".", " ", "é"]
    titles = sorted({"".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(1500)})

    def has(p, t):
        return re.search(p, t, re.ASCII) is not None

    ordered = [
        (r"2160p|4k", "2160p"), (r"1080p", "1080p"), (r"720p", "720p"), (r"\.web-dl\.", "1080p"), (r"\.remux\.", "2160p"),
        (r"\bhd\b", "HD"), (r"\buhd\b|\bultra.hd\b", "2160p"), (r"\bfhd\b|\bfull.hd\b", "1080p"), (r"\bhd.rip\b", "720p"),
        (r"\bhigh.def\b", "HD"), (r"\.bluray\.|\.blu-ray\.|\.webrip\.", "1080p"), (r"\.hdtv\.", "720p"),
        (r"\.brrip\.|\.bdrip\.", "1080p"), (r"remux|web-dl|bluray|blu-ray", "1080p"), (r"hdtv", "720p"), (r"", "HD"),
    ]
    want = {t: next(tier for p, tier in ordered if has(p, t)) for t in titles}
    df = spark.createDataFrame([(t,) for t in titles], "t STRING").select("t", A.tier(F.col("t")).alias("q"))
    assert {r["t"]: r["q"] for r in df.collect()} == want
