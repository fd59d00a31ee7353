"""op6, op8, op9, op10 and the pipeline: near-duplicates, sketches, leaks, lines."""

import hashlib
import random
import time
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from tests.conftest import SF_DIR
from tests.llm.conftest import ODD
from tests.llm.test_text_operators import LOWER, WORD
from titleloom.llm import contamination, lines, shingles, simhash, sketches
from titleloom.llm.common import documents, stored

# --- near-duplicates


def plain_print(text):
    words = (text or "").encode().lower().split()
    k = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)] if words else []
    return sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(64))


def groups(prints, bits=4):
    """Root position of every print, by comparing all pairs."""
    values, parent = np.array(prints, np.uint64), list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i] ^ values[i + 1 :]) <= bits) + i + 1:
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(values))]


def test_op6_equals_all_pairs(result, texts):
    ids = sorted(texts)
    prints = [plain_print(texts[d]) for d in ids]
    roots = groups(prints)
    wanted = {d: (f"{p:016x}", ids[r]) for d, p, r in zip(ids, prints, roots, strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in result("op6_simhash_near_dedup")} == wanted


def test_every_neighbour_meets_at_home():
    draw = random.Random(3)
    for _ in range(300):
        x = draw.getrandbits(64)
        y = x
        for b in draw.sample(range(64), draw.randint(0, 4)):
            y ^= 1 << b
        home = set(simhash.homes(np.array([x], np.uint64))[1].tolist())
        near = {k for _, keys in simhash._anchors(np.array([y], np.uint64), 2) for k in keys.tolist()}
        assert home & near
    assert len(near) <= 3 * 22 + 3


@pytest.mark.parametrize("tile", [4096, 8])
def test_links_keep_dense_groups_whole(spark, tile):
    """Chains, balls and crowded anchors: the groups of all pairs, with far fewer links."""
    draw = random.Random(7)
    prints = {draw.getrandbits(64) for _ in range(300)}
    for _ in range(6):
        x = draw.getrandbits(64)
        for _ in range(60):
            prints.add(x)
            y = x
            for b in draw.sample(range(64), draw.randint(1, 5)):
                y ^= 1 << b
            prints.add(y)
            x = y if draw.random() < 0.3 else x
    values = sorted(prints, key=lambda p: p - (1 << 64) if p >> 63 else p)
    signed = [p - (1 << 64) if p >> 63 else p for p in values]
    links = simhash.links(spark.createDataFrame([(p,) for p in signed], "print LONG"), tile)
    found = {r.node: r.root for r in simhash.components(links).collect()}
    roots = groups(values)
    assert [found.get(p, p) for p in signed] == [signed[r] for r in roots]
    assert links.count() < 20 * len(values)


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 100)] + [(5000, 5000)]
    df = spark.createDataFrame(edges, "a LONG, b LONG")
    found = {r.node: r.root for r in simhash.components(df).collect()}
    assert found == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(1000, 1100), 1000)}


def test_near_duplicates_odd_rows(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    by = defaultdict(set)
    for r in rows:
        by[r.doc_id].add((r.print, r.component_id))
    assert by[1] == by[2] == by[3] == {(0, 1)} and by[10] == by[7] and len(by[7]) == 1
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(7) == 1 and ids.count(1) == 1 and not {2, 3, 10} & set(ids)
    assert simhash.near_duplicates(empty).collect() == [] and simhash.drop_near_duplicates(empty).collect() == []


def jaccard_groups(texts, width=5, bound=0.8):
    """Root position of every text, by the Jaccard similarity of all pairs."""
    sets = []
    for text in texts:
        own = (text or "").encode().lower().split()
        k = min(width, len(own))
        sets.append({tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if own else set())
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            b = sets[j]
            if len(a & b) >= bound * len(a | b):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def test_stage_links_texts_that_share_four_fifths_of_their_shingles(spark):
    draw = random.Random(5)
    texts = []
    for edits in (1, 1, 2, 2, 3, 4, 5, 6) * 5:
        own = [f"w{draw.randrange(5000)}" for _ in range(120)]
        texts.append(" ".join(own))
        for _ in range(2):
            for at in draw.sample(range(120), edits):
                own[at] = f"x{draw.randrange(5000)}"
            texts.append(" ".join(own))
    texts += ["", "a b", "A  b", "a c", "  ", *texts[:3]]
    roots = jaccard_groups(texts)
    assert set(roots) != set(groups([plain_print(t) for t in texts]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING").repartition(4)
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF_DIR).collect()}
    assert kept == set(roots)


# --- sketches


def test_op8_equals_sets_of_paragraphs(result, texts):
    ids = sorted(texts)
    rows = {r.doc_id: r for r in result("op8_document_fingerprints")}
    assert set(rows) == set(ids)
    sets = {}

    def alike(a, b):
        x, y = (sets.setdefault(t, set(sketches.digests(t).tolist())) for t in (a, b))
        return len(x & y) / len(x | y) if x | y else 1.0

    for i, d in enumerate(ids):
        text, following = texts[d], texts[ids[(i + 1) % len(ids)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = rows[d]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(alike(text, edited)) and r.near_next == pytest.approx(alike(text, following))
    same = defaultdict(set)
    for d in ids:
        same[texts[d]].add(rows[d].fingerprint)
    assert all(len(v) == 1 for v in same.values())


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 300), st.integers(0, 300), st.integers(0, 300), st.integers(0, 2**32))
def test_peeling_recovers_the_difference(shared, only_a, only_b, seed):
    draw = np.random.default_rng(seed).integers(0, 1 << 63, shared + only_a + only_b).astype(np.uint64)
    a, b = draw[: shared + only_a], np.concatenate([draw[:shared], draw[shared + only_a :]])
    ((left, right),) = sketches.differences([a], [b])
    assert sorted(left) == sorted(draw[shared : shared + only_a]) and sorted(right) == sorted(draw[shared + only_a :])


def test_next_document_across_parts(spark, odd, empty):
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        docs = spark.createDataFrame([(i * 7, f"text {i}\nsecond line of {i}") for i in range(57)], "doc_id LONG, text STRING").repartition(6)
        rows = {r.doc_id: r for r in sketches.fingerprints(docs).collect()}
        for i in range(57):
            text, following = (f"text {k}\nsecond line of {k}" for k in (i, (i + 1) % 57))
            assert rows[i * 7].edited_sha256 == hashlib.sha256(sketches.edit(text, following).encode()).hexdigest()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    (one,) = sketches.fingerprints(spark.createDataFrame([(3, "abcd")], "doc_id LONG, text STRING")).collect()
    assert (one.edited_sha256, one.near_next) == (hashlib.sha256(b"abab").hexdigest(), 1.0)
    rows = sketches.fingerprints(odd).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in rows) == sorted((str(d), len(t or "")) for d, t in ODD)
    assert len({r.fingerprint for r in rows if r.n_chars == 0}) == 1
    assert sketches.fingerprints(empty).collect() == []


# --- leaks


def tiled(text, item, least=5):
    """Longest common unmarked run, again and again, by trying all places."""
    free_a, free_b, total = [True] * len(text), [True] * len(item), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(text)):
            for j in range(len(item)):
                n = 0
                while i + n < len(text) and j + n < len(item) and text[i + n] == item[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return total
        free_a[i : i + n] = free_b[j : j + n] = [False] * n
        total += n


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.lists(st.integers(0, 3), max_size=25))
def test_tiles_are_disjoint_equal_runs_and_none_is_left(text, item):
    found = contamination.tiles(text, item, 3)
    a, b = bytearray(len(text)), bytearray(len(item))
    for i, j, n in found:
        assert n >= 3 and text[i : i + n] == item[j : j + n] and not any(a[i : i + n]) and not any(b[j : j + n])
        a[i : i + n] = b[j : j + n] = b"\1" * n
    for i in range(len(text) - 2):
        for j in range(len(item) - 2):
            assert text[i : i + 3] != item[j : j + 3] or any(a[i : i + 3]) or any(b[j : j + 3])


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def leaked(texts, items):
    owned, found = {}, set()
    for item, text in sorted(items.items()):
        owned.setdefault(tuple(words(text)), item)
    owned.pop((), None)
    grams = {d: {tuple(w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1)} for d, w in ((d, words(t)) for d, t in texts.items())}
    for own, item in owned.items():
        k = min(5, len(own))
        seeds = {own[i : i + k] for i in range(len(own) - k + 1)}
        for d, text in texts.items():
            if seeds & grams[d] and tiled(words(text), list(own), k) / len(own) >= 0.5:
                found.add((d, item))
    return found


def test_op9_equals_tiling_of_whole_texts(result, texts, items):
    assert {(r.doc_id, r.item_id) for r in result("op9_decontamination")} == leaked(texts, items)


def test_reordered_and_partial_passages(spark, items, odd, empty):
    item = words(items[0])
    half = len(item) // 2
    rows = [
        (1, " ".join(["x", *item[half:], "y", *item[:half]])), (2, " ".join(item[: len(item) // 3])), (3, " ".join(item[::-1])),
        (4, ". ".join(" ".join(item[i : i + 5]).upper() for i in range(0, len(item), 5))), (4, ". ".join(" ".join(item[i : i + 5]).upper() for i in range(0, len(item), 5))), (None, " ".join(item)), (5, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    bench = spark.createDataFrame([(7, items[0]), (8, items[0]), (9, None), (10, "too short"), (11, "")], "item_id LONG, text STRING")
    found = contamination.leaks(docs, bench).collect()
    assert sorted(str(r.id) for r in found) == ["1", "4", "None"] and {(r.item_id, tuple(r.item_ids)) for r in found} == {(7, (7, 8))}
    assert [r.doc_id for r in contamination.drop_leaked(docs, bench).orderBy("doc_id").collect()] == [2, 3, 5]
    clean = contamination.drop_leaked(odd, bench)
    assert clean.columns == odd.columns and clean.count() == len(ODD)
    assert contamination.leaks(empty, bench).collect() == [] and contamination.leaks(docs, bench.limit(0)).collect() == []


def test_short_items_and_a_gram_of_many_items(spark):
    draw = random.Random(6)
    docs = {i: " ".join(draw.choice("abcdefgh") for _ in range(draw.randint(1, 14))) for i in range(60)}
    items = {i: " ".join(draw.choice("abcdefgh") for _ in range(draw.randint(0, 7))) for i in range(40)}
    df = spark.createDataFrame(list(docs.items()), "doc_id LONG, text STRING")
    found = contamination.leaks(df, spark.createDataFrame(list(items.items()), "item_id LONG, text STRING")).collect()
    assert {(r.id, r.item_id) for r in found} == leaked(docs, items)
    for r in found:
        assert r.item_ids == sorted(i for i, t in items.items() if t == items[r.item_id])
    # one passage opens ten thousand items; two of them are here in full
    many = spark.range(10_000).selectExpr("id AS item_id", "concat('shared words at the front of ', id, ' x', id, ' y', id, ' z', id) AS text")
    rows = [(k, f"shared words at the front of {k} x{k} y{k} z{k}") for k in (3, 77)] + [(5, "shared words at the front of it all")]
    got = contamination.leaks(spark.createDataFrame(rows, "doc_id LONG, text STRING"), many.repartition(4)).where("coverage > 0.9").collect()
    assert {(r.id, r.item_id) for r in got} == {(3, 3), (77, 77)}


# --- lines


def test_many_blank_lines_take_time_in_proportion():
    start = time.monotonic()
    found = lines.windows("\n" * 200_000 + " ".join(f"w{i}" for i in range(60)))
    assert len(found) == 200_001 and time.monotonic() - start < 20


def cut_lines(docs, run_words=50):
    """docs: (id, text) in order; the kept lines of each, comparing runs of lines themselves."""
    first, cuts = {}, defaultdict(set)
    key = lambda d: (d[0] is None, d[0] or 0, xxhash.xxh64_intdigest((d[1] or "").encode(), 42) - (1 << 64) * (xxhash.xxh64_intdigest((d[1] or "").encode(), 42) >> 63))
    for doc, text in sorted(set(docs), key=key):
        if text is None:
            continue
        own = text.split("\n")
        n = [len(x.encode().split()) for x in own]
        found = set()
        for i in range(len(own)):
            found.update([next(((i, j) for j in range(i + 1, len(own) + 1) if sum(n[i:j]) >= run_words), None)])
            found.update([next(((j, i + 1) for j in range(i, -1, -1) if sum(n[j : i + 1]) >= run_words), None)])
        for i, j in sorted(found - {None}):
            run = tuple(own[i:j])
            at = first.setdefault(run, (doc, text, i, j))
            if at[:2] != (doc, text) or i >= at[3]:
                cuts[doc, text].update(range(i, j))
    return {(d, t): None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in cuts[d, t]) if cuts[d, t] else t for d, t in docs}


def test_op10_equals_plain_comparison(result, texts):
    wanted = cut_lines(list(texts.items()))
    assert {r.doc_id: r.text for r in result("op10_line_dedup")} == {d: t for (d, _), t in wanted.items()}
    assert sum(r.lines_removed for r in result("op10_line_dedup")) > 0


def test_lines_random_runs(spark):
    draw = random.Random(11)
    pool = [" ".join(draw.choice("abcdefg") * draw.randint(1, 3) for _ in range(draw.choice([3, 8, 15, 30, 60]))) for _ in range(30)]
    docs = []
    for d in range(120):
        own = [draw.choice(pool) if draw.random() < 0.5 else f"{d} own line {i} " * draw.randint(1, 5) for i in range(draw.randint(1, 12))]
        for _ in range(draw.randint(0, 2)):
            at = draw.randint(0, 25)
            own[draw.randint(0, len(own)) :] = pool[at : at + 4]
        docs.append((d, "\n".join(own)))
    df = spark.createDataFrame(docs, "doc_id LONG, text STRING").repartition(5)
    assert {(r.doc_id, r.text) for r in lines.drop_repeated_runs(df).collect()} == {(d, t) for (d, _), t in cut_lines(docs).items()}


def test_lines_contract(spark, odd, empty):
    a, b = " ".join(f"w{i}" for i in range(60)), "\n".join(f"line {i} has seven words in it" for i in range(20))
    docs = [(1, f"x\n{a}\ny"), (2, f"{a}\nz"), (3, f"{b}\n{b}"), (4, f"p\n{b}\nq"), (5, "short\nlines"), (6, "short\nlines"), (None, a)]
    df = spark.createDataFrame(docs, "doc_id LONG, text STRING")
    rows = {r.doc_id: r for r in lines.drop_repeated_runs(df).collect()}
    assert [rows[k].text for k in (1, 2, 3, 4, 5, 6, None)] == [f"x\n{a}\ny", "z", b, "p\nq", "short\nlines", "short\nlines", ""]
    assert [tuple(r) for r in rows[4].removed_runs] == [(1, 21)]
    found = lines.drop_repeated_runs(odd)
    assert found.columns == [c for c in odd.columns if c != "removed_runs"] + ["removed_runs"]
    assert sorted(((r.doc_id, r.text) for r in found.collect()), key=str) == sorted(ODD, key=str)
    assert lines.drop_repeated_runs(empty).collect() == []


# --- pipeline


def test_pipeline_stages_keep_their_contracts(spark, odd, empty, texts, items):
    rows = documents(spark, SF_DIR)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, rows = rows, stored(stage(spark, rows, SF_DIR), "test")
        seen[name] = rows
        if name != "packing":
            assert rows.columns == before.columns and rows.schema.simpleString() == before.schema.simpleString()
    held = {n: {r.doc_id: r.text for r in df.collect()} for n, df in seen.items() if n != "packing"}
    assert len(held["language_id"]) >= 0.97 * len(texts)
    wanted = cut_lines(list(held["language_id"].items()))
    assert held["line_dedup"] == {d: t for (d, _), t in wanted.items()}
    assert all(r.n_chars == len(r.text) for r in seen["line_dedup"].collect())
    ids = sorted(held["line_dedup"])
    roots = jaccard_groups([held["line_dedup"][d] for d in ids])
    assert set(held["near_dedup"]) == {ids[r] for r in roots}
    dirty = {d for d, _ in leaked(held["near_dedup"], items)}
    assert set(held["decontamination"]) == set(held["near_dedup"]) - dirty
    assert {r.doc_id for r in seen["packing"].collect()} == set(held["decontamination"])


@pytest.mark.parametrize("table", ["odd", "empty"])
def test_pipeline_takes_odd_and_empty_tables(spark, odd, empty, table):
    docs = rows = odd if table == "odd" else empty
    for name, stage in corpus_pipeline.STAGES:
        before, rows = rows, stored(stage(spark, rows, SF_DIR), "test")
        if name != "packing":
            assert rows.schema.simpleString() == before.schema.simpleString()
        if name == "language_id" and table == "odd":
            # rows without a letter go; all others are of the one language that is known
            assert sorted(str(r.doc_id) for r in rows.collect()) == sorted(str(d) for d, t in ODD if t and any(map(str.isalpha, t)))
        if name == "near_dedup" and table == "odd":
            assert sorted(str(r.doc_id) for r in rows.collect()) == sorted(map(str, (5, 6, 7, 8, 9, None)))
    assert (rows.count() > 0) == (table == "odd") and docs.columns == before.columns


def test_similar_takes_odd_and_empty_tables(odd, empty):
    rows = shingles.similar(odd).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(d) for d, _ in ODD)
    by = defaultdict(set)
    for r in rows:
        by[r.doc_id].add(r.component)
    assert by[1] == by[2] == by[3] and by[10] == by[7] and len(by[7]) == 1 and len(by[None]) == 2
    kept = shingles.drop_similar(odd)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == odd.columns and ids.count(7) == 1 and ids.count(1) == 1 and not {2, 3, 10} & set(ids)
    assert shingles.similar(empty).collect() == [] and shingles.drop_similar(empty).collect() == []


def test_mixed_buckets_are_cut_and_not_joined_with_themselves(spark):
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
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING").repartition(4)
    roots = jaccard_groups(texts)
    found = {r.doc_id: r.component for r in shingles.similar(docs).collect()}
    joined = defaultdict(set)
    for i, r in enumerate(roots):
        joined[r].add(found[i])
    whole = sum(1 for i, r in enumerate(roots) if len(joined[r]) == 1)
    assert whole >= 0.97 * len(texts)
    owners = defaultdict(set)
    for i, r in enumerate(roots):
        owners[found[i]].add(r)
    assert all(len(o) == 1 for o in owners.values())  # nothing under the bound is linked
    crowd = spark.createDataFrame([(1, 0, 0, k, 100, k) for k in range(3000)], "key LONG, band INT, step INT, text_key LONG, n INT, group LONG")
    assert shingles.stars(crowd, 0.8, 2).count() <= 2 * 3000
