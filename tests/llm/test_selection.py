"""op11, op12, op13: resampling, periodic runs, shards."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import ODD
from tests.llm.test_text_operators import LOWER, WORD
from titleloom.llm import periods, resampling, sharding
from titleloom.llm.numbering import running

# --- running totals


def test_running_totals_by_cell(spark):
    rows = [(i, i % 3 if i % 7 else None, i % 5) for i in range(1000)]
    df = spark.createDataFrame(rows, "i LONG, cell LONG, w LONG").repartition(7).orderBy("i")
    from pyspark.sql import functions as F

    seen, wanted = Counter(), {}
    for i, cell, w in rows:
        wanted[i] = seen[cell]
        seen[cell] += w
    assert {r.i: r.upto for r in running(df, F.col("w"), F.col("cell"), "upto").collect()} == wanted
    assert running(df.limit(0)).collect() == []


# --- op11


def plain_resampling(docs, target, words=1, buckets=10_000, least=20, share=(10, 100), seed=2024):
    """{row number: (n_features, weight, score, rank)} of rows (id, text)."""

    def feats(text):
        own = WORD.findall((text or "").translate(LOWER))
        return len(own), [" ".join(own[i : i + n]) for n in range(1, words + 1) for i in range(len(own) - n + 1)]

    of = lambda f: zlib.crc32(f.encode()) % buckets
    all_s = Counter(of(f) for _, t in docs for f in feats(t)[1])
    all_t = Counter(of(f) for t in target for f in feats(t)[1])
    s, t = sum(all_s.values()), sum(all_t.values())
    rows, able = {}, []
    for k, (doc, text) in enumerate(docs):
        n, own = feats(text)
        weight = sum(math.floor(1000 * math.log((all_t[of(f)] + 1) * (s + buckets) / ((all_s[of(f)] + 1) * (t + buckets)))) for f in own)
        h = int(hashlib.sha256(f"{seed}:{'null' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows[k] = [len(own), weight, score, None]
        if n >= least:
            able.append((-score, doc is None, doc or 0, k))
    for place, (*_, k) in enumerate(sorted(able)[: len(able) * share[0] // share[1]]):
        rows[k][3] = place + 1
    return rows


def test_op11_equals_plain(result, texts, items):
    ids = sorted(texts)
    wanted = plain_resampling([(d, texts[d]) for d in ids], list(items.values()))
    found = {r.doc_id: (r.n_features, r.weight, r.score, r.rank) for r in result("op11_importance_resampling")}
    assert found == {ids[k]: tuple(v) for k, v in wanted.items()}
    assert sum(v[3] is not None for v in found.values()) > 10


@pytest.mark.parametrize("n, spread", [(1, 1), (40, 0), (300, 4), (400, 1000)])
def test_cutoff_is_exact(spark, n, spread):
    draw = random.Random(n)
    keys = [(draw.randint(0, spread), draw.randint(0, 1), draw.randint(0, spread), k) for k in range(n)]
    df = spark.createDataFrame(keys, "low LONG, no_id LONG, id LONG, row LONG").repartition(5)
    for need in {n, draw.randint(1, n)}:
        assert resampling.cutoff(df, need, small=3, block=16) == sorted(keys)[need - 1]


def test_resampling_ties_word_pairs_and_odd_rows(spark, odd, empty):
    draw = random.Random(2)
    docs = [(k % 40 if k % 9 else None, " ".join(draw.choice("ab cd ef gh".split()) for _ in range(draw.choice([3, 25, 25])))) for k in range(300)]
    docs += [(7, "Ab CD " * 20)] * 50  # equal in id, text and score
    df = spark.createDataFrame(docs, "doc_id LONG, text STRING").repartition(4)
    bench = spark.createDataFrame([("ab cd",), (None,), ("",)], "text STRING")
    found = resampling.resample(df, bench, words=2, buckets=50, share=(1, 3), small=5, block=32).collect()
    wanted = plain_resampling(docs, ["ab cd", None, ""], words=2, buckets=50, share=(1, 3))
    # rows alike in id and score are interchangeable
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in found) == Counter((docs[k][0], *v) for k, v in wanted.items())
    rows = resampling.resample(odd, bench).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(d) for d, _ in ODD)
    assert all((r.n_words, r.weight) == (0, 0) for r in rows if r.doc_id in (1, 2, 3, 4))
    assert resampling.resample(empty, bench).collect() == []
    none = resampling.resample(df, bench.limit(0)).collect()
    assert len(none) == len(docs) and sum(r["rank"] is not None for r in none) == sum(len(t.split()) >= 20 for _, t in docs) * 10 // 100


# --- op12


def plain_runs(words, exponent=4, least=6):
    n, out = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            end = i
            while end + q < n and words[end] == words[end + q]:
                end += 1
            if end + q - i >= max(least, exponent * q):
                out.setdefault((i, end + q), q)  # periods ascend: the smallest comes first
            i = end
    return sorted((a, b - a, q) for (a, b), q in out.items())


BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def planted(doc, words):
    h, n = zlib.crc32(str("null" if doc is None else doc).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def plain_digest(doc, text):
    words = planted(doc, BLANK.findall(text or ""))
    runs = plain_runs(words)
    cut = {i for s, n, q in runs for i in range(s + q, s + n)}
    s, n, q = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None, None, None)
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    left = " ".join(w for i, w in enumerate(words) if i not in cut)
    return len(runs), s, n, q, 1000 * n // q if runs else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest()


def test_op12_equals_plain(result, texts):
    found = {r.doc_id: tuple(r)[1:] for r in result("op12_periodic_runs")}
    short = {d for d, t in texts.items() if len(t or "") < 12_000}
    assert set(found) == set(texts) and len(short) > 190
    assert {d: found[d] for d in short} == {d: plain_digest(d, texts[d]) for d in short}
    assert sum(v[0] > 0 for v in found.values()) > 5


def periodic(draw, n, letters):
    """Words with planted stretches of small and large periods."""
    words = []
    while len(words) < n:
        q = draw.choice([1, 1, 2, 3, 5, 8, 13, 21])
        base = [draw.randrange(letters) for _ in range(q)]
        words += (base * 9)[: draw.randint(1, 7 * q)]
    return words[:n]


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2**32), st.integers(0, 300), st.integers(1, 4), st.sampled_from([(4, 6), (2, 2), (3, 4), (8, 9)]))
def test_catchers_find_all_runs_for_any_chunks(seed, n, letters, law):
    draw = random.Random(seed)
    words = periodic(draw, n, letters)
    catcher, at = periods.Catcher(*law), 0
    while at < n:
        step = draw.choice([1, 2, 7, 40, n])
        catcher.append(np.array(words[at : at + step], np.int64))
        at += step
        if at <= n and draw.random() < 0.1:
            assert catcher.runs() == plain_runs(words[:at], *law)
    assert catcher.runs() == plain_runs(words, *law)


def test_runs_of_several_texts_do_not_touch():
    draw = random.Random(3)
    texts = [[b"%d" % w for w in periodic(draw, draw.randint(0, 200), 3)] for _ in range(60)] + [[b"x"] * 20, [b"x"] * 20]
    assert periods.runs_of(texts) == [plain_runs(t) for t in texts]
    assert periods.runs_of([]) == []


def test_one_word_a_million_times():
    long = [b"a"] * 1_000_000
    assert periods.runs_of([long, [b"a"] * 5]) == [[(0, 1_000_000, 1)], []]
    draw = random.Random(1)
    block = [b"%d" % draw.randrange(10**6) for _ in range(40_000)]
    assert periods.runs_of([[b"q"] * 4 + block * 5 + [b"r"]]) == [[(4, 200_000, 40_000)]]


def test_periods_odd_rows(spark, odd, empty):
    rows = periods.periodic_runs(odd).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(d) for d, _ in ODD)
    by = {r.doc_id: r for r in rows}
    assert (by[1].n_words, by[1].runs, by[1].text) == (0, [], "") and by[3].text == ""
    assert [tuple(x) for x in by[6].runs] == [(0, 45_000, 5)] and by[6].text == "Thin erand of the ouble."
    kept = periods.collapsed(odd)
    assert kept.columns == odd.columns
    wanted = [(d, "Thin erand of the ouble." if d == 6 else t) for d, t in ODD]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(wanted, key=str)
    assert periods.periodic_runs(empty).collect() == [] and periods.collapsed(empty).collect() == []


# --- op13


def check_shards(rows, docs, shards=8):
    """rows of the operator; docs: (id, text). Returns for each text its numbers of rows by shard."""
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    sizes = [len(slots[k]) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    held = defaultdict(Counter)
    for r in rows:
        held[bytes(r.key)][r.shard] += 1
    return held


def cut_links(held):
    return sum((sum(c.values()) ** 2 - sum(n * n for n in c.values())) // 2 for c in held.values())


def test_op13_law(result, texts):
    rows = result("op13_balanced_shards")
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert {r.doc_id: (r.size, r.text_crc32, r.law, r.grown_shard) for r in rows} == {d: (len(t.encode()) + 1, zlib.crc32(t.encode()), "rows", None) for d, t in texts.items()}
    assert sorted((r.shard, r.slot) for r in rows) == [(k, i) for k in range(8) for i in range(sizes[k])]
    of = defaultdict(set)
    for r in rows:
        of[texts[r.doc_id]].add(r.shard)
    assert sum(len(s) > 1 for s in of.values()) == 0  # all copies of a text are together here


@pytest.mark.parametrize("free", [600, 0])
def test_shards_keep_copies_together(spark, free):
    """A text with a third of all rows, many small groups, and with or without unlinked rows."""
    draw = random.Random(4)
    docs = [(k, "the hot text") for k in range(500)]
    docs += [(1000 + 10 * g + k, f"group {g}") for g in range(150) for k in range(draw.choice([2, 2, 3, 5]))]
    docs += [(10_000 + k, f"alone {k}") for k in range(free)]
    draw.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id LONG, text STRING").repartition(6)
    held = check_shards(sharding.shard(df).collect(), docs)
    hot = max(held.values(), key=lambda c: sum(c.values()))
    small = [c for c in held.values() if 1 < sum(c.values()) < 10]
    split = sum(len(c) > 1 for c in small)
    if free:
        assert len(hot) <= 4 and split <= len(small) // 10
    else:
        assert split <= len(small) // 2
    dealt = sum(n * n * 7 / 16 for n in Counter(t for _, t in docs).values())  # of links are cut where rows lie evenly
    assert cut_links(held) < (0.9 if free else 1) * dealt


def test_flows_keep_quotas():
    draw = np.random.default_rng(5)
    for _ in range(200):
        k = int(draw.integers(1, 9))
        quota = draw.integers(1, 100, k)
        load = [int(draw.integers(0, q + 1)) for q in quota]
        wishes = np.zeros((k, k), np.int64)
        for i in range(k):
            wishes[i] = draw.multinomial(draw.integers(0, load[i] + 1), np.ones(k) / k)
            wishes[i, i] = 0
        flow = sharding.flows(wishes, load, quota.tolist())
        after = np.array(load) - flow.sum(axis=1) + flow.sum(axis=0)
        assert (flow >= 0).all() and (flow <= wishes).all() and (after <= quota).all()
        if (np.array(load) - wishes.sum(axis=1) + wishes.sum(axis=0) <= quota).all():
            assert (flow == wishes).all()


def test_shards_odd_rows(spark, odd, empty):
    check_shards(sharding.shard(odd, shards=3).collect(), ODD, 3)
    check_shards(sharding.shard(odd, shards=1).collect(), ODD, 1)
    check_shards(sharding.shard(odd, shards=40).collect(), ODD, 40)
    assert sharding.shard(empty).collect() == []
