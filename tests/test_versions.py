"""Versioned table, availability as of a request, bounded streams, sources that fail."""

import random
from datetime import datetime, timedelta

import pytest

from tests.conftest import SF_DIR
from titleloom.queries.base import table
from titleloom.operators import link, lookup, spans
from titleloom.queries.joins import clean_titles
from titleloom.sources import keyed, payloads
from titleloom.streaming import availability, standing, versions
from titleloom.streaming.bounded import run_to_end

T0 = datetime(2024, 1, 1)
SCHEMA = "k STRING, at BIGINT, v STRING, deleted BOOLEAN"


def plain(batches):
    """key -> (value, first arrival) after the batches, one row at a time."""
    held = {}
    for batch in batches:
        for k, at, v, gone in sorted(batch, key=lambda r: r[1]):
            if gone:
                held.pop(k, None)
            else:
                held[k] = (v, held[k][1] if k in held else at)
    return held


def state(spark, path, version=None):
    return {r["k"]: (r["v"], r["first_arrival"]["at"]) for r in versions.read(spark, path, ["k"], version).collect()}


def batches_of(seed, n=6):
    rng = random.Random(seed)
    at = iter(rng.sample(range(10_000), 600))
    return [[(rng.choice([None, "a", "b", "c", "d", "e"]), next(at), f"{i}-{j}", rng.choice([True, False, False, None])) for j in range(rng.randint(1, 25))] for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_every_version_equals_its_batches(spark, tmp_path, seed):
    path, batches = str(tmp_path / "table"), batches_of(seed)
    at = {}
    for i, rows in enumerate(batches):
        at[versions.commit(spark.createDataFrame(rows, SCHEMA), path, ["k"], ["at"])] = i + 1
        if i in (2, 4):
            before = versions.read(spark, path, ["k"])  # a reader that is open while the table is folded
            at[versions.compact(spark, path, ["k"])] = i + 1
            assert len(versions.manifest(spark, path)["folders"]) == 1
            assert {r["k"]: r["v"] for r in before.collect()} == {k: v for k, (v, _) in plain(batches[: i + 1]).items()}
    assert versions.versions(spark, path) == list(range(1, 9))
    for version, n in at.items():
        assert state(spark, path, version) == plain(batches[:n])
    assert versions.vacuum(spark, path, keep=2) and versions.versions(spark, path) == [7, 8]
    assert state(spark, path) == plain(batches) and state(spark, path, 7) == plain(batches[:5])


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    path, (one, two, *_) = str(tmp_path / "table"), batches_of(5)
    for rows, number in ((one, 0), (one, 0), (two, 1), (one, 0), (two, 1)):
        versions.commit(spark.createDataFrame(rows, SCHEMA), path, ["k"], ["at"], stream="s", number=number)
    assert versions.versions(spark, path) == [1, 2] and state(spark, path) == plain([one, two])


def test_two_writers_take_different_versions(spark, tmp_path, monkeypatch):
    path, (one, two, three, *_) = str(tmp_path / "table"), batches_of(7)
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    versions.commit(frame(one), path, ["k"], ["at"])
    publish, raced = versions.publish, []

    def race(*args):
        if not raced:  # another writer is first between reading the manifest and writing the next
            raced.append(True)
            versions.commit(frame(two), path, ["k"], ["at"])
        return publish(*args)

    monkeypatch.setattr(versions, "publish", race)
    assert versions.commit(frame(three), path, ["k"], ["at"]) == 3
    assert state(spark, path) == plain([one, two, three]) and state(spark, path, 2) == plain([one, two])
    # a commit that comes while the table is folded stays behind the folded part
    raced.clear()
    versions.compact(spark, path, ["k"])
    assert len(versions.manifest(spark, path)["folders"]) == 2 and state(spark, path) == plain([one, two, three, two])
    with pytest.raises(versions.Conflict):
        publish(spark, path, {"version": 2, "folders": [], "streams": {}})
    with pytest.raises(ValueError):
        versions.read(spark, str(tmp_path / "none"), ["k"])


def test_stream_of_upserts_and_removals(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "table")
    batches = [[r for r in b if r[0]] for b in batches_of(9, 4)]
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        versions.upsert_stream(stream, path, str(tmp_path / "state"), ["k"], ["at"]).trigger(availableNow=True).start().awaitTermination()
    for i in range(len(batches)):
        assert state(spark, path, i + 1) == plain(batches[: i + 1])


def as_of(asked, told, horizon):
    out = {}
    for request, key, at in asked:
        seen = [(t, s, st) for k, t, s, st in told if k == key and at - timedelta(seconds=horizon) < t <= at]
        out[request] = max(seen)[2] if seen else None
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_availability_as_of_the_request(spark, tmp_path, seed):
    """Batch and stream equal the definition; the stream gets both sides shuffled within the delay."""
    rng = random.Random(seed)
    moment = lambda: T0 + timedelta(seconds=rng.randint(0, 6000))
    key = lambda: rng.choice(["hot", "hot", "a", "b", "none"])
    asked = [(i, key(), moment()) for i in range(150)]
    told = [(k, moment(), i, rng.choice(["downloaded", "dead"])) for i, k in enumerate(key() for _ in range(80)) if k != "none"]
    told += [(k, at, 1000 + i, "downloaded") for i, (_, k, at) in enumerate(asked[:10]) if k != "none"]  # at the same instant
    kinds = ("request_id BIGINT, key STRING, at TIMESTAMP", "key STRING, changed_at TIMESTAMP, seq BIGINT, status STRING")
    wanted = {r: (s, s == "downloaded") for r, s in as_of(asked, told, 900).items()}
    frames = [spark.createDataFrame(rows, kind) for rows, kind in zip((asked, told), kinds, strict=True)]
    assert {r.request_id: (r.status, r.available) for r in availability.as_of(*frames, 900).collect()} == wanted
    streams = []
    for side, (rows, kind, place) in enumerate(((asked, kinds[0], 2), (told, kinds[1], 1))):
        rows = sorted(rows, key=lambda r: r[place] + timedelta(minutes=rng.uniform(0, 25)))
        step = len(rows) // 3 + 1
        for i in range(3):
            spark.createDataFrame(rows[i * step : (i + 1) * step], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / f"side{side}"))
        streams.append(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / f"side{side}")))
    end = T0 + timedelta(days=3)
    ends = [[(-1, "", end)], [("", end, -1, "dead")]]
    found = run_to_end(spark, streams, ends, lambda a, t: availability.as_of_stream(a, t, 900, "30 minutes"), "as-of")
    assert {r.request_id: (r.status, r.available) for r in found.collect()} == wanted
    assert found.count() == len(asked)


@pytest.fixture
def no_broadcast(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for name in names:
        spark.conf.set(name, "-1")
    yield
    for name in names:
        spark.conf.unset(name)


def exchanges(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    return sum(("Exchange" in line) and ("ReusedExchange" not in line) for line in plan.splitlines()), plan


def test_joins_of_keyed_tables_move_nothing(spark, tmp_path, no_broadcast):
    items, listings = table(spark, SF_DIR, "v_item"), table(spark, SF_DIR, "v_store")
    path = str(tmp_path / "items")
    left = keyed.write_keyed(items, "items", ["content_hash"], 4, path)
    right = spark.table(keyed.write_keyed(listings, "listings", ["content_hash"], 4))
    again = keyed.register(spark, "items_again", path, items.schema, ["content_hash"], 4)
    assert len(list((tmp_path / "items").glob("*.parquet"))) == 4
    for stored in (spark.table(left), again):
        for df, plain in (
            (stored.join(right, "content_hash").select("item_key", "row_key"), items.join(listings, "content_hash").select("item_key", "row_key")),
            (lookup.orphans(stored, right.where("seeders > 30"), "content_hash").select("item_key"), lookup.orphans(items, listings.where("seeders > 30"), "content_hash").select("item_key")),
        ):
            n, plan = exchanges(df)
            assert n == 0, plan
            assert sorted(map(tuple, df.collect())) == sorted(map(tuple, plain.collect()))
    spark.sql("DROP TABLE items_again")


def test_a_batch_does_not_move_the_standing_queries(spark, tmp_path, no_broadcast):
    queries, titles = table(spark, SF_DIR, "v_query"), clean_titles(spark, SF_DIR)
    stored = standing.store_queries(queries, 4)
    arrived = str(tmp_path / "titles")
    titles.limit(200).write.parquet(arrived)
    n, plan = exchanges(standing.match(spark, spark.read.parquet(arrived), stored))
    # the batch is dealt to its blocks, the stored side lies there
    assert n == 1 and "SortMergeJoin" in plan, plan
    half = lambda k: standing.match(spark, titles.where(f"pmod(xxhash64(title), 2) = {k}"), stored)
    both = half(0).unionAll(half(1)).select("query_id", "title", "match_type")
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, link.link_titles(queries, titles).select("query_id", "title", "match_type").collect()))


def test_a_source_that_fails_costs_its_own_rows(spark, tmp_path):
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("provider", T.StringType()), T.StructField("title", T.StringType()), T.StructField("seeders", T.LongType())])
    good = spark.range(10).select(F.lit("a").alias("provider"), F.concat(F.lit("t"), "id").alias("title"), F.lit("x").alias("more"))
    (tmp_path / "bad.parquet").write_text("no parquet at all")

    def raises():
        raise RuntimeError("no route\nto host")

    sources = {
        "good": lambda: good, "missing": lambda: spark.read.parquet(str(tmp_path / "none")), "corrupt": lambda: spark.read.schema(schema).parquet(str(tmp_path / "bad.parquet")),
        "late": lambda: good.select("provider", F.when(F.col("title") == "t7", F.raise_error(F.lit("reset"))).otherwise(F.col("title")).alias("title")), "raises": raises,
    }
    rows, report = payloads.gather_sources(spark, sources, schema)
    assert rows.columns == schema.fieldNames() and sorted(r.title for r in rows.collect()) == [f"t{i}" for i in range(10)]
    held = {r.source: r for r in report.collect()}
    assert {n: (r.ok, r.rows) for n, r in held.items()} == {"good": (True, 10), "missing": (False, 0), "corrupt": (False, 0), "late": (False, 0), "raises": (False, 0)}
    assert held["raises"].error == "no route" and held["late"].error and held["good"].error is None
    none, report = payloads.gather_sources(spark, {"raises": raises}, schema)
    assert none.collect() == [] and report.count() == 1


def test_spans_from_stored_days(spark, tmp_path):
    from pyspark.sql import functions as F

    rng, path = random.Random(3), str(tmp_path / "days")
    rows = [(T0 + timedelta(hours=rng.randint(0, 24 * 20)), rng.choice("ab"), rng.choice([None, *map(str, range(4000))])) for _ in range(9000)]
    for part in (rows[:3000], rows[3000:]):
        frame = spark.createDataFrame(part, "ts TIMESTAMP, kind STRING, key STRING")
        spans.append(spans.summarise(frame, F.col("ts"), ["kind"], "key"), path)
    found = spans.of_span(spark, path, F.lit("all"), ["kind"], "2024-01-05", "2024-01-12")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan  # other days are not read
    for r in found.collect():
        own = [k for t, kind, k in rows if kind == r.kind and datetime(2024, 1, 5) <= t < datetime(2024, 1, 12)]
        exact = len(set(own) - {None})
        assert r.rows == len(own) and abs(r["distinct"] - exact) <= 0.03 * exact
