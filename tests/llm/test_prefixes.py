"""Exact groups by shingle sets, against all pairs."""

import math
import os
import random
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.conftest import ODD
from tests.llm.test_copies import jaccard_groups
from titleloom.llm import prefixes, shingles, simhash
from titleloom.llm.simhash import components
from titleloom.workspace import CLEANUP, shared_root


def families():
    """Texts whose similarity lies around the bound, a passage that many share, copies, and texts of few words."""
    draw = random.Random(12)
    base = [f"w{draw.randrange(9000)}" for _ in range(150)]
    passage = " ".join(f"p{i}" for i in range(40))
    texts = ["", " ", "a b", "A  b", "a c", "one two three four five six seven eight nine", "one two three four five six seven eight nine ten"]
    for _ in range(90):
        own = list(base)
        for at in draw.sample(range(150), draw.choice((2, 4, 6))):
            own[at] = f"x{draw.randrange(9000)}"
        texts.append(" ".join(own))
        texts.append(passage + " " + " ".join(f"y{draw.randrange(9000)}" for _ in range(draw.choice((4, 8, 60)))))
    draw.shuffle(texts)
    return texts + texts[:10]


def same_groups(found, roots):
    """found (a name per text) and roots part the texts alike."""
    pairs = set(zip(found, roots, strict=True))
    return len(pairs) == len({f for f, _ in pairs}) == len({r for _, r in pairs})


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING").repartition(4)


@pytest.mark.parametrize("bound", [0.8, 0.5])
def test_prefixes_alone_find_every_link(spark, bound):
    texts = families()
    docs = frame(spark, texts)
    sets = prefixes.sets_of(docs, "text", 5).cache()
    none = spark.createDataFrame([], "a LONG, b LONG")
    roots = {r.node: r.root for r in components(prefixes.missed(sets, none, bound)).collect()}
    keys = {r.doc_id: r.key for r in docs.select("doc_id", prefixes.text_key(docs.text).alias("key")).collect()}
    blank = [i for i, t in enumerate(texts) if not t.split()]  # no shingle, so the bands alone join them
    found = ["blank" if i in blank else roots.get(keys[i], keys[i]) for i in range(len(texts))]
    assert same_groups(found, jaccard_groups(texts, bound=bound))


def test_exact_groups_equal_all_pairs(spark):
    texts = families()
    found = {r.doc_id: r.component for r in prefixes.similar(frame(spark, texts)).collect()}
    roots = jaccard_groups(texts)
    assert same_groups([found[i] for i in range(len(texts))], roots)
    assert {r.doc_id for r in prefixes.drop_similar(frame(spark, texts)).collect()} == set(roots)


def test_copies_of_one_group_make_no_pair(spark):
    text = " ".join(f"w{i}" for i in range(60))
    sets = prefixes.sets_of(frame(spark, [f"{text} {i}" for i in range(300)]), "text", 5).cache()
    keys = sorted(r.text_key for r in sets.collect())
    links = spark.createDataFrame([(keys[0], k) for k in keys[1:]], "a LONG, b LONG")
    assert prefixes.missed(sets, links).collect() == []
    assert prefixes.leading(sets, 0.8).count() <= 300 * 13


def test_exact_groups_of_odd_and_empty_tables(odd, empty):
    rows = prefixes.similar(odd).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(d) for d, _ in ODD)
    by = defaultdict(set)
    for r in rows:
        by[r.doc_id].add(r.component)
    assert by[1] == by[2] == by[3] and by[10] == by[7] and len(by[7]) == 1 and len(by[None]) == 2
    kept = prefixes.drop_similar(odd)
    # groups: rows without a word (1, 2, 3, null), copies (7, 7, 10), and six of one row
    assert kept.columns == odd.columns and kept.count() == 8
    assert prefixes.similar(empty).collect() == []


def hidden_pairs():
    """A family whose members are mostly under the bound, with close pairs hidden in it."""
    draw = random.Random(8)
    base, texts = [f"w{draw.randrange(9000)}" for _ in range(150)], []
    for _ in range(250):
        own = list(base)
        for at in draw.sample(range(150), 6):
            own[at] = f"x{draw.randrange(9000)}"
        texts.append(" ".join(own))
        if draw.random() < 0.3:
            own[draw.randrange(150)] = "y"
            texts.append(" ".join(own))
    draw.shuffle(texts)
    return texts


def test_stage_goes_through_anchors_and_misses_no_link(spark, monkeypatch):
    texts, compared = hidden_pairs(), []
    links = simhash.links
    monkeypatch.setattr(simhash, "links", lambda classes, *rest: compared.append(classes.count()) or links(classes, *rest))
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, frame(spark, texts), None).collect()}
    assert kept == set(jaccard_groups(texts))
    assert compared == [len({simhash.fingerprint(t, 5) for t in texts})]


def test_any_order_of_shingles_finds_every_link():
    draw = np.random.default_rng(3)
    for _ in range(300):
        every = np.unique(draw.integers(0, 1 << 62, 60).astype(np.uint64))
        a, b = (np.sort(draw.choice(every, draw.integers(1, len(every)), replace=False)) for _ in range(2))
        b = np.unique(np.concatenate([a[: int(len(a) * 0.9)], b[:2]]))
        common = draw.choice(every, 20, replace=False)
        if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)):
            assert len(np.intersect1d(prefixes.lead_of(a, common, 0.8), prefixes.lead_of(b, common, 0.8)))


def drawn_sets():
    """Sets around a base of 120: some at the bound or above it with another, most with a third of it or less in common."""
    draw = np.random.default_rng(21)
    base, sets = draw.integers(-(1 << 62), 1 << 62, 120), []
    for i in range(120):
        own = draw.choice(base, 40 if i % 4 else 118, replace=False)
        sets.append(np.unique(np.concatenate([own, draw.integers(-(1 << 62), 1 << 62, 80 if i % 4 else draw.integers(0, 20))])))
    return sets


def jaccard(a, b):
    return len(np.intersect1d(a, b)) / len(np.union1d(a, b))


def test_pairs_that_share_too_little_of_their_prefixes_are_no_candidates(spark):
    held = drawn_sets()
    similar = {(a, b) for b in range(len(held)) for a in range(b) if jaccard(held[a], held[b]) >= 0.8}
    sets = spark.createDataFrame([(i, h.tolist()) for i, h in enumerate(held)], "text_key LONG, held ARRAY<LONG>")
    none = spark.createDataFrame([], "a LONG, b LONG")
    found = {(r.a, r.b) for r in prefixes.candidates(prefixes.leads_in(sets, 0.8), none, 0.8).collect()}
    assert similar and similar <= found
    assert len(found) <= 2 * len(similar)


@pytest.mark.parametrize("bound", [0.8, 0.75, 0.5])
def test_no_similar_pair_is_held_impossible(spark, bound):
    draw, rows = np.random.default_rng(5), []
    for _ in range(600):
        whole = draw.integers(0, 1 << 62, 60).astype(np.uint64)
        n, m = (int(draw.integers(max(1, int(30 * bound)), 31)) for _ in range(2))
        shared = int(draw.integers(0, min(n, m) + 1)) if draw.random() < 0.3 else min(n, m, math.ceil(bound / (1 + bound) * (n + m)))
        a, b = np.sort(whole[:n]), np.sort(np.concatenate([whole[:shared], whole[30 : 30 + m - shared]]))
        common = draw.choice(whole, 15, replace=False)
        heads = [prefixes.lead_of(s, common, bound).tolist() for s in (a, b)]
        met = set(heads[0]) & set(heads[1])
        if jaccard(a, b) >= bound:
            assert met
            rows.append((n, m, len(met), *[max(h.index(t) for t in met) for h in heads]))
    frame = spark.createDataFrame(rows, "n INT, m INT, met LONG, at_n INT, at_m INT")
    assert len(rows) > 100 and frame.where(~prefixes.can_be_similar(bound)).collect() == []


def test_steps_leave_no_shuffle_files(spark, monkeypatch):
    texts, seen, sketched = families()[:30], [], shingles.sketched
    before = spark.conf.get(CLEANUP)
    monkeypatch.setattr(shingles, "sketched", lambda *args: seen.append(spark.conf.get(CLEANUP)) or sketched(*args))
    prefixes.similar(frame(spark, texts))
    assert seen == ["true"] and spark.conf.get(CLEANUP) == before


def test_components_keep_no_table_of_earlier_rounds(spark):
    root = shared_root(spark).removeprefix("file:")
    before = set(os.listdir(root))
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(50, 60)], "a LONG, b LONG")
    found = {r.node: r.root for r in components(links).collect()}
    assert found == {**dict.fromkeys(range(41), 0), 50: 50, 60: 50}
    assert [name.split("-")[0] for name in set(os.listdir(root)) - before] == ["edges"]
