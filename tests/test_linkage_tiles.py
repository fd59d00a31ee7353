"""Linkage where words are short, repeated or held by many titles, against brute force; and how its pairs are made."""

import contextlib
import io
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from titleloom import rules
from titleloom.operators import link
from titleloom.queries import QUERIES
from tests.test_link import wanted_match


def norm(s):
    s = re.sub(r"[^a-z0-9_]+", " ", s.lower())
    return re.sub(rf"\b(?:{'|'.join(rules.STOP_WORDS)})\b", "", s, flags=re.ASCII).strip()


def brute_force(queries, titles):
    found = {}
    for number, a in queries:
        for b in titles:
            if a is not None and b is not None and (hit := wanted_match(norm(a), b, norm(b))):
                found[(number, b)] = (hit[0], round(hit[1], 9))
    return found


def found_by(pairs):
    rows = [((r.query_id, r.title), (r.match_type, round(r.confidence, 9))) for r in pairs.collect()]
    assert len(rows) == len(dict(rows))  # each pair once
    return dict(rows)


def odd_titles(rng):
    short, long_words = ["red", "fox", "sun", "sky", "old", "one", "zed", "lee", "kit", "oak", "elm", "ash"], ["blue", "castle", "winter_", "monolith"]
    out = {"", "de", "ab cd", "red", "of red", "trailer red", "castle", "red red red", "castle castle", "red castle red castle fox"}
    for _ in range(150):
        words = rng.choices(short, k=rng.randint(1, 5)) + rng.choices(long_words, k=rng.randint(0, 2)) + rng.choices(["ab", "o", "de"], k=rng.randint(0, 1))
        rng.shuffle(words)
        out.add(" ".join(words))
    for _ in range(40):  # long ones, and copies that lack some words, with and without foreign ones
        words = rng.choices(short, k=rng.randint(9, 32)) + rng.choices(long_words, k=rng.choice([0, 0, 1, 2, 4]))
        rng.shuffle(words)
        out.add(" ".join(words))
        for lacking in (1, 2, 3):
            gone = set(rng.sample(sorted(set(words)), min(lacking, len(set(words)) - 1)))
            left = [w for w in words if w not in gone]
            rng.shuffle(left)
            out.update({" ".join(left), " ".join([*left, "foreign"])})
    unique = [f"w{i}" if i > 9 else f"v0{i}" for i in range(34)]
    for n in (9, 10, 11, 20, 30, 34):  # words that come once: strict keywords
        out.add(" ".join(unique[:n]))
        out.update(" ".join(reversed(unique[k:n])) for k in (1, 2, 3, 4))
        out.update(" ".join([*reversed(unique[k:n]), "extra"]) for k in (0, 1))
        out.add(" ".join([*unique[: n - 1], "castle"]))
    return sorted(out)


def test_short_words_and_tiles_equal_brute_force(spark):
    texts = odd_titles(random.Random(5))
    numbered = [*enumerate(texts), (9_001, None), (None, "red castle red castle fox")]
    queries = spark.createDataFrame(numbered, "query_id INT, title STRING")
    titles = spark.createDataFrame([(t,) for t in [*texts, None]], "title STRING")
    want = brute_force(numbered, texts)
    assert {v[0] for v in want.values()} == {"exact-clean", "exact", "partial", "exact-words", "strict-keyword", "exact-short"}
    assert found_by(link.link_titles(queries, titles)) == want
    for tile in (7, 10_000):
        assert found_by(link.link_titles(queries, titles, tile=tile)) == want


def test_tiles_keep_repeated_queries_and_columns(spark):
    queries = spark.createDataFrame([(1, "castle red")] * 3 + [(2, "castle red")], "query_id INT, title STRING")
    titles = spark.createDataFrame([(f"castle {i}", i) for i in range(20)], "title STRING, n INT")
    for tile in (None, 4):
        rows = link.link_titles(queries, titles, keep=["n"], tile=tile).collect()
        assert Counter((r.query_id, r.n) for r in rows) == {(q, n): 3 if q == 1 else 1 for q in (1, 2) for n in range(20)}
        assert all(r.title == f"castle {r.n}" and r.match_type == "partial" for r in rows)
    assert link.link_titles(queries, titles, min_confidence=0.9, tile=4).count() == 0


def test_one_common_word_does_not_fill_one_task(spark):
    titles = spark.createDataFrame([(f"castle w{i}",) for i in range(400)], "title STRING")
    pairs = link.link_titles(titles.withColumn("query_id", F.md5("title")), titles, tile=32)
    by_task = Counter(r[0] for r in pairs.select(F.spark_partition_id()).collect())
    assert sum(by_task.values()) == 400 * 400
    assert max(by_task.values()) < 0.2 * 400 * 400


def test_headings_are_paired_in_generated_code(spark):
    """Above the join of the pairs there is neither a generator nor a higher-order function."""
    from tests.conftest import SF_DIR

    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        QUERIES["j1_heading_linkage"](spark, SF_DIR).explain()
    above = text.getvalue().split("Join")[0]
    assert "lambda" not in above and "Generate" not in above and "q_tile" in text.getvalue()
