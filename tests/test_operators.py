"""Ranking, lookups, statistics on small rows; hot keys included."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from titleloom.operators import lookup, rank, stats
from titleloom.plans import curated, search
from titleloom.streaming import jobs, sessions, ttl


def test_best_per_tier_orders_and_limits(spark):
    rows = [("q", "HD", 0.8, 10, 5, 1.0, f"k{i}") for i in range(5)] + [("q", "HD", 0.9, 1, 0, 0.0, "z"), ("q", "480p", 1.0, 99, 9, 9.0, "no")]
    df = spark.createDataFrame(rows, "query_id STRING, tier STRING, confidence DOUBLE, relevance_score INT, seeders INT, size_bytes DOUBLE, row_key STRING")
    got = [(r["row_key"], r["rank"], r["tier_order"]) for r in rank.best_per_tier(df).orderBy("rank").collect()]
    assert got == [("z", 1, 4), ("k0", 2, 4), ("k1", 3, 4)]


def test_title_leaders_lose_no_best_listing(spark):
    """The pre-selection per title equals ranking all scored listings."""
    rng = random.Random(5)
    titles = ["red fox 1080p", "red fox dual", "fox s1e2 bluray", "sun"]
    rows = [(f"k{i:04d}", "l", rng.choice(titles), rng.choice(["HD", "1080p"]), rng.randint(0, 120), float(rng.randint(0, 3))) for i in range(600)]
    listings = spark.createDataFrame(rows, "row_key STRING, link STRING, title STRING, tier STRING, seeders BIGINT, size_bytes DOUBLE")
    queries = spark.createDataFrame([("a", "Red Fox"), ("b", "fox")], "query_id STRING, title STRING")
    got = search.best_matches(queries, listings)
    from titleloom.functions import attributes as A
    from titleloom.operators.link import link_titles

    pairs = link_titles(queries, listings.select("title").distinct()).join(listings, "title")
    full = pairs.withColumn("relevance_score", A.relevance_score(F.col("tier"), F.col("confidence"), F.col("title"), F.col("seeders")))
    want = rank.best_per_tier(full)
    cols = ["query_id", "tier", "rank", "row_key"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_upsert_keeps_last_value_and_first_position(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, None)], "k STRING, at INT, v STRING")
    got = {r["k"]: (r["v"], r["at"], r["first_arrival"]["at"]) for r in rank.keyed_upsert(df, ["k"], ["at"]).collect()}
    assert got == {"a": (None, 3, 1), "b": ("y", 2, 2)}


def test_catalogue_order_is_locale_aware(spark):
    df = spark.createDataFrame([("SD", 9, "a"), ("4K", 1, "b"), ("4K", 5, "Zed"), ("4K", 5, "émile"), ("4K", 5, "Fox")], "tier STRING, seeds INT, title STRING")
    order = rank.catalogue_order(F.col("tier"), F.col("seeds"), F.col("title"), F.col("title"))
    assert [r["title"] for r in df.orderBy(*order).collect()] == ["émile", "Fox", "Zed", "b", "a"]


def test_positions_within_equals_row_number(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else f"g{rng.randint(0, 5)}", rng.choice([None, 1, 2]), rng.randint(0, 3), i) for i in range(400)]
    df = spark.createDataFrame(rows, "g STRING, a INT, b INT, k INT")
    got = {(r["g"], r["k"]): r["place"] for r in rank.positions_within(df, ["g"], ["a", "b"], ["k"], "place").collect()}
    want = {}
    for g in {r[0] for r in rows}:
        inside = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        want.update({(g, r[3]): n + 1 for n, r in enumerate(inside)})
    assert got == want


def test_positions_of_one_hot_level_are_split(spark):
    """All rows share group and level: no window may hold them all."""
    df = spark.range(0, 5000, 1, 8).select(F.lit("g").alias("g"), F.lit(1).alias("a"), (F.col("id") * 7919 % 5000).alias("k"))
    got = rank.positions_within(df, ["g"], ["a"], ["k"], "place")
    assert got.where("place <> k + 1").count() == 0 and got.count() == 5000
    assert "hashpartitioning(_part" in got._jdf.queryExecution().executedPlan().toString()


def test_null_keys_and_times_are_kept(spark):
    rows = [("a", datetime(2024, 1, 1), 1, "x"), ("a", None, 2, "x"), (None, datetime(2024, 1, 1), 3, "x"), (None, None, 4, "y"), (None, datetime(2024, 1, 5), 5, "x")]
    df = spark.createDataFrame(rows, "k STRING, ts TIMESTAMP, i INT, s STRING")
    changed = rank.change_points(df, "k", ["ts", "i"], ["s"], F.date_trunc("day", "ts"))
    assert sorted(r["i"] for r in changed.collect()) == [2, 3, 4]
    sessions_ = sessions.idle_sessions(df, "k", "ts", ["i"], 3600)
    assert sessions_.agg(F.sum("requests")).first()[0] == 5


def _timeline(rng, keys, n, gap):
    start = datetime(2024, 1, 1)
    return [(rng.choice(keys), start + timedelta(minutes=rng.randint(0, gap)), i) for i in range(n)]


def test_change_points_and_sessions_across_buckets(spark):
    rng = random.Random(2)
    rows = [(k, t, i, rng.choice(["a", "b", None])) for k, t, i in _timeline(rng, ["hot"] * 5 + ["x", "y"], 300, 20_000)]
    df = spark.createDataFrame(rows, "k STRING, ts TIMESTAMP, i INT, s STRING")
    changed = rank.change_points(df, "k", ["ts", "i"], ["s"], F.date_trunc("hour", "ts"))
    got = {r["i"] for r in changed.collect()}
    want, by_key = set(), {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        if r[0] not in by_key or by_key[r[0]] != r[3]:
            want.add(r[2])
        by_key[r[0]] = r[3]
    assert got == want

    got = sorted((r["k"], r["session"], r["requests"]) for r in sessions.idle_sessions(df, "k", "ts", ["i"], 3600, "hour").collect())
    state, counts = {}, {}
    for k, t, i, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        number, last = state.get(k, (0, None))
        if last is None or t - last > timedelta(seconds=3600):
            number += 1
        state[k] = (number, t)
        counts[(k, number)] = counts.get((k, number), 0) + 1
    assert got == sorted((k, n, c) for (k, n), c in counts.items())


def test_ttl_boundary_and_delete(spark):
    t0 = datetime(2024, 1, 1)

    def at(s):
        return t0 + timedelta(seconds=s)

    rows = [
        ("a", at(0), 1, "set", "v"), ("a", at(3600), 2, "get", None), ("a", at(3600) + timedelta(microseconds=1), 3, "get", None),
        ("b", at(10), 4, "set", "w"), ("b", at(20), 5, "delete", None), ("b", at(30), 6, "get", None), ("c", at(5), 7, "get", None),
        ("d", at(50), 8, "set", "x"), ("d", at(50), 9, "get", None), ("d", at(50), 10, "set", "y"), ("d", at(60), 11, "get", None),
    ]
    log = spark.createDataFrame(rows, "key STRING, at TIMESTAMP, seq INT, op STRING, value STRING")
    got = {r["seq"]: r["value"] for r in ttl.reads(log).collect()}
    assert got == {2: "v", 3: None, 6: None, 7: None, 9: "x", 11: "y"}
    live = {r["key"]: r["value"] for r in ttl.live(log, F.lit(at(3600)).cast("timestamp")).collect()}
    assert live == {"a": "v", "d": "y"}


def test_job_outcomes(spark):
    t0 = datetime(2024, 1, 1)
    rows = [
        ("ok", 0, "queued"), ("ok", 29, "downloaded"), ("late", 0, "queued"), ("late", 30, "downloaded"), ("bad", 0, "queued"),
        ("bad", 1, "virus"), ("bad", 2, "downloaded"), ("none", 0, "queued"),
    ]
    df = spark.createDataFrame([(k, t0 + timedelta(minutes=m), i, s) for i, (k, m, s) in enumerate(rows)], "job_id STRING, ts TIMESTAMP, event_id INT, status STRING")
    got = {r["job_id"]: (r["outcome"], r["status"]) for r in jobs.outcomes(df).collect()}
    assert got == {"ok": ("success", "downloaded"), "late": ("stalled", None), "bad": ("failure", "virus"), "none": ("stalled", None)}


def test_lookups(spark):
    items = spark.createDataFrame([("w1", "h1", "i1"), ("w1", "h2", "i2"), ("w1", "h9", "i3"), ("w2", "h1", "i4")], "work_id STRING, content_hash STRING, item_key STRING")
    listings = spark.createDataFrame([("h1", 5), ("h2", None)], "content_hash STRING, seeders INT")
    wanted = spark.createDataFrame([("w1",)], "work_id STRING")
    assert sorted(r["item_key"] for r in lookup.items_of_work(wanted, items, listings, ["work_id"]).collect()) == ["i1", "i2"]
    found = lookup.items_of_work(wanted, items, listings, ["work_id"], limit=9, tie=["item_key"]).orderBy("rank").collect()
    assert [(r["item_key"], r["rank"]) for r in found] == [("i2", 1), ("i1", 2)]
    assert len(lookup.items_of_work(wanted, items, listings, ["work_id"], limit=1, tie=["item_key"]).collect()) == 1

    status = spark.createDataFrame([("H1", "downloaded"), ("h1", "error"), ("H2", "error")], "content_hash STRING, status STRING")
    got = {r["content_hash"]: r["available"] for r in lookup.with_availability(listings.unionByName(spark.createDataFrame([("h3", 1)], listings.schema)), status).collect()}
    assert got == {"h1": True, "h2": False, "h3": False}

    deleted = spark.createDataFrame([("h1",), ("h1",)], "content_hash STRING")
    assert sorted(r["item_key"] for r in lookup.orphans(items, listings, "content_hash").collect()) == ["i3"]
    assert sorted(r["item_key"] for r in lookup.cascade_delete(items, deleted, "content_hash").collect()) == ["i2", "i3"]
    nulled = {r["item_key"]: r["content_hash"] for r in lookup.set_null(items, deleted, "content_hash").collect()}
    assert nulled == {"i1": None, "i2": "h2", "i3": "h9", "i4": None}

    batch = spark.createDataFrame([("h1", 1), ("h7", 9), ("h7", 3)], "content_hash STRING, at INT")
    assert [tuple(r) for r in lookup.insert_if_absent(listings, batch, "content_hash", ["at"]).collect()] == [("h7", 3)]


def test_estimated_seeders_and_detail(spark):
    base = spark.createDataFrame([("s", 80), ("s", 90)], "provider STRING, base INT")
    rows = spark.createDataFrame([("s", "2160p", None), ("s", "HD", 0), ("?", "1080p", None), ("s", "HD", 7)], "provider STRING, tier STRING, seeders INT")
    got = sorted((r["provider"], r["tier"], r["seeders"]) for r in lookup.with_estimated_seeders(rows, base).collect())
    assert got == [("?", "1080p", 39), ("s", "2160p", 120), ("s", "HD", 7), ("s", "HD", 88)]

    items = spark.createDataFrame([("p", "t", 2, "u2"), ("p", "t", 1, "u1"), ("p", "x", 1, "u3")], "source STRING, raw_title STRING, position INT, detail_url STRING")
    details = spark.createDataFrame([("u1", "m1"), ("u1", "m9"), ("u2", "m2"), ("u3", "")], "detail_url STRING, link STRING")
    listings = spark.createDataFrame([("p", "t"), ("p", "x"), ("q", "t")], "source STRING, raw_title STRING")
    assert [r["link"] for r in lookup.attach_detail(listings, items, details).collect()] == ["m1"]


def test_stats(spark):
    tiers = spark.createDataFrame([("HD",), ("HD",), ("other",)], "tier STRING")
    assert {r["tier"]: r["listings"] for r in stats.count_per_tier(tiers).collect()} == {"2160p": 0, "1080p": 0, "720p": 0, "HD": 2}
    rate = spark.createDataFrame([(0, 0), (1, 4)], "k INT, t INT").select(stats.success_rate(F.col("k"), F.col("t"))).collect()
    assert [r[0] for r in rate] == [0.0, 25.0]
    empty = spark.createDataFrame([], "l STRING")
    assert stats.link_completeness(empty, F.col("l"), F.col("l") == "x").first()["mean_length"] is None

    probes = spark.createDataFrame([("b", False, 1.0), ("a", False, 2.0)], "s STRING, ok BOOLEAN, t DOUBLE")
    health = stats.source_health(probes, "s", F.col("ok"), F.col("t"), ["b", "a"])
    assert [(r["source"], r["chosen"]) for r in health.orderBy("rank").collect()] == [("b", True), ("a", False)]

    items = spark.createDataFrame([("g", "a.mkv", 10), ("g", "b.mkv", 10), ("g", "sample.mkv", 99), ("g", "big.txt", 500), ("g", "c.1080p.mkv", 8), ("g", "c.1080p.3gp", 9)], "g STRING, path STRING, bytes BIGINT")
    assert stats.main_item(items, ["g"], "path", "bytes").first()["path"] == "a.mkv"
    best = stats.main_item(items, ["g"], "path", "bytes", weighted=True).first()
    assert (best["path"], best["weight"]) == ("c.1080p.mkv", 12.0)

    rows = spark.createDataFrame([("w", i, "t") for i in range(50)], "w STRING, k INT, t STRING")
    nested = stats.nested_by_work(rows, "w", ["k"], ["t"], parts=4)
    assert stats.nested_by_work(rows, "w", ["k"], ["t"], parts=1).count() == 1
    assert nested.count() == 4 and nested.select(F.sum(F.size("entries"))).first()[0] == 50
    assert sorted(r["k"] for r in stats.flattened(nested, "w").collect()) == list(range(50))


def test_curated_search_order(spark):
    listings = spark.createDataFrame(
        [("tt1:1:1", "Fox 720p", "m:?1", 5, "k1", 1), ("tt1", "Fox 2160p", "m:?2", 1, "k2", 2), ("tt1", "Fox 1080p", "http", 9, "k3", 3), ("tt1:2:1", "Fox 720p new", "m:?1", 7, "k4", 4)],
        "composite_id STRING, raw_title STRING, link STRING, seeders INT, row_key STRING, at INT",
    )
    catalogue = curated.curate(listings, "m:?", ["at"])
    requests = spark.createDataFrame([("r", "tt1", "x"), ("s", None, "NEW")], "request_id STRING, work_id STRING, wanted STRING")
    got = [(r["request_id"], r["row_key"]) for r in curated.search(requests, catalogue).collect()]
    assert got == [("r", "k2"), ("r", "k4"), ("s", "k4")]
