"""Results that are kept up to date while rows arrive, and tables read by a few keys."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from titleloom.operators import lookup, rank
from titleloom.sources import points
from titleloom.streaming import health, leaders, requests
from titleloom.streaming.bounded import run_in_steps

T0 = datetime(2024, 1, 1)
SCORED = "query_id STRING, tier STRING, row_key STRING, confidence DOUBLE, relevance_score BIGINT, seeders BIGINT, size_bytes BIGINT, title STRING"


@pytest.fixture
def narrow(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_changes_of_the_best_give_the_best(spark, tmp_path, narrow):
    """Ties, nulls, a hot group and tiers that are not ranked."""
    rng = random.Random(5)
    rows = [
        (rng.choice(["hot", "hot", "a", None]), rng.choice(["2160p", "HD", "none"]), f"r{i:04d}", rng.choice([0.8, 0.95, 1.0]), rng.choice([1, 2, None]),
         rng.choice([0, 5, 2**60, 2**60 + 1]), rng.choice([None, 0, 7]), rng.choice(["x", None]))
        for i in range(600)
    ]
    parts = [spark.createDataFrame(rows[i:i + 200], SCORED) for i in (0, 200, 400)]
    columns = ["query_id", "tier", "rank", "row_key", "confidence", "relevance_score", "seeders", "size_bytes", "title"]
    whole, state = str(tmp_path / "whole"), str(tmp_path / "whole-state")
    run_in_steps(
        spark, parts,
        lambda arriving: leaders.best_changes(arriving, ["title"]).writeStream.format("parquet").option("checkpointLocation", state).option("path", whole),
        "scored",
    )
    changes = spark.read.parquet(whole)
    want = rank.best_per_tier(spark.createDataFrame(rows, SCORED)).select(columns)
    got = rank.best_per_tier(leaders.replayed(changes)).select(columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert changes.where("change = -1").count() > 0
    assert leaders.replayed(changes).groupBy("query_id", "tier").count().agg(F.max("count")).first()[0] <= 3


def test_a_request_is_answered_once_a_span(spark, tmp_path):
    rng = random.Random(8)
    rows = [(T0 + timedelta(seconds=rng.randint(0, 40_000)), rng.choice(["a", "b", "hot", "hot", "hot", None]), i) for i in range(900)]
    rows.sort(key=lambda r: r[0] + timedelta(seconds=rng.uniform(0, 3500)))  # up to the delay off
    schema = "ts TIMESTAMP, key STRING, i INT"
    parts = [spark.createDataFrame(rows[i:i + 180], schema) for i in range(0, 900, 180)]
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    start = lambda s: requests.once(s, "key", "ts", 3600, 3600).writeStream.format("parquet").option("checkpointLocation", state).option("path", out)
    run_in_steps(spark, parts, start, "asked")
    got = spark.read.parquet(out).select("key", "span_start").collect()
    want = spark.createDataFrame(rows, schema).select("key", requests.span_start("ts", 3600).alias("span_start")).distinct().collect()
    assert sorted(map(str, got)) == sorted(map(str, want))
    with pytest.raises(ValueError):
        requests.once(parts[0], "key", "ts", 3600, 60)


def test_last_update_of_each_window_equals_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [(T0 + timedelta(seconds=rng.randint(0, 90_000)), rng.choice(["a", "b", "c", None]), rng.choice([None, 0.5, 2.0, 3.0])) for _ in range(500)]
    rows.append((T0 + timedelta(days=3), "b", 0.1))  # a window of its own where nobody is healthy
    rows.append((T0 + timedelta(days=3), "z", None))
    rows.sort(key=lambda r: r[0] + timedelta(seconds=rng.uniform(0, 1700)))
    schema = "ts TIMESTAMP, source STRING, value DOUBLE"
    parts = [spark.createDataFrame(rows[i:i + 130], schema) for i in range(0, len(rows), 130)]
    path, state = str(tmp_path / "health"), str(tmp_path / "state")
    ok, order = F.col("value") >= 1, ["b", "a"]
    run_in_steps(spark, parts, lambda s: health.update_stream(s, path, state, "source", ok, F.col("value"), "ts", "2 hours", "1 hour", "1800 seconds"), "probes")
    got = health.chosen(health.latest(spark, path), order)
    want = health.chosen(health.per_window(spark.createDataFrame(rows, schema), "source", ok, F.col("value"), "ts", "2 hours", "1 hour"), order)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))
    alone = want.where(F.col("window_start") == F.lit(T0 + timedelta(days=3))).orderBy("rank").collect()
    assert [(r.source, r.healthy, r.chosen, r.probes, r.failures) for r in alone] == [("b", False, True, 1, 1), ("z", False, False, 1, 1)]
    assert len(parts) < spark.read.parquet(path).select("batch").distinct().count() + 1


def bytes_read(spark):
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).inputBytes() for i in range(stages.size()))


def test_a_few_keys_read_a_small_part(spark, tmp_path):
    """A hundred keys of two million read under a tenth of the table, and more keys than the limit find the same rows."""
    import os

    digest = lambda c: F.md5(F.col(c).cast("string"))
    rows = spark.range(0, 2_000_000, 1, 8).select(digest("id").alias("key"), F.sha2(F.col("id").cast("string"), 512).alias("value"))
    path = str(tmp_path / "points")
    table = spark.table(points.write_points(rows, "points", "key", 8, path=path))
    size = sum(os.path.getsize(f"{path}/{f}") for f in os.listdir(path))
    keys = [(r.k,) for r in spark.range(0, 2_000_000, 20_000).select(digest("id").alias("k")).collect()]
    wanted = spark.createDataFrame([*keys, *keys[:5], (None,), ("absent",)], "key STRING")
    before = bytes_read(spark)
    found = points.fetch_points(table, wanted, "key").collect()
    assert len(found) == 100 and {(r.key,) for r in found} == set(keys)
    assert 0 < bytes_read(spark) - before < size / 10
    joined = points.fetch_points(table, wanted, "key", key_limit=50)
    assert sorted(joined.collect()) == sorted(found)
    assert points.fetch_points(table, wanted.where("key IS NULL"), "key").collect() == []


def test_inserts_by_key_equal_the_join(spark):
    schema = "key STRING, at INT, v STRING"
    old = spark.createDataFrame([(f"k{i}", i, "old") for i in range(50)] + [(None, 0, "old")], schema)
    batch = spark.createDataFrame([(f"k{i}", i, "new") for i in range(40, 60)] + [("k55", 1, "first"), (None, 3, "none"), (None, 2, "least")], schema)
    table = points.write_points(old, "inserts", "key", 4)
    for limit in (100, 5):
        points.insert_points(spark, table, batch.where("key IS NOT NULL"), "key", ["at"], 4, key_limit=limit)
    want = old.unionAll(lookup.insert_if_absent(old, batch.where("key IS NOT NULL"), "key", ["at"]))
    assert sorted(map(str, spark.table(table).collect())) == sorted(map(str, want.collect()))
    assert len(spark.table(table).where("key = 'k55'").collect()) == 1


def test_listings_are_cut_by_title_over_all_batches_of_a_task(spark, monkeypatch):
    """Nulls, ties and big numbers; a task that holds little passes on more, never less."""
    rng = random.Random(4)
    schema = "row_key STRING, title STRING, tier STRING, seeders BIGINT, size_bytes BIGINT"
    rows = [
        (rng.choice([None, f"r{i:05d}"]), rng.choice(["a", "b", "c", None]), rng.choice(["HD", "720p"]), rng.choice([0, 3, None, 2**60, 2**60 + 1]), rng.choice([None, 1, 2**60 + 3]))
        for i in range(30_000)
    ]
    listings = spark.createDataFrame(rows, schema).coalesce(1)
    order = [F.col("seeders").desc(), F.col("size_bytes").desc(), F.col("row_key").asc()]
    want = sorted(map(str, rank.top_k(listings, ["title", "tier"], order, 3).drop("rank").collect()))
    assert sorted(map(str, leaders.best_of_titles(listings).collect())) == want  # the task has several batches
    monkeypatch.setattr(leaders, "HELD_ROWS", 20)
    more = leaders.best_of_titles(listings)
    assert sorted(map(str, rank.top_k(more, ["title", "tier"], order, 3).drop("rank").collect())) == want
    assert leaders.best_of_titles(listings.limit(0)).collect() == []
