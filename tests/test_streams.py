"""Streams over several micro-batches equal their batch forms."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from titleloom.queries.streams import STATE_STORE
from titleloom.streaming import jobs, sessions, ttl, upsert

T0 = datetime(2024, 1, 1)


@pytest.fixture
def run(spark, tmp_path):
    """run(rows, schema, order, build): write rows as files in time order, stream them one by one."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")

    def go(rows, schema, build, files=3):
        source = str(tmp_path / "in")
        step = (len(rows) + files - 1) // files
        for i in range(files):
            spark.createDataFrame(rows[i * step:(i + 1) * step], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        out = build(stream)
        writer = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state"))
        query = writer.trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()
        go.held = query.lastProgress["stateOperators"][0]["numRowsTotal"]
        return spark.read.schema(out.schema).parquet(str(tmp_path / "out"))

    yield go
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_ttl_stream_equals_batch(spark, run):
    rng = random.Random(4)
    rows = sorted(
        (T0 + timedelta(seconds=rng.randint(0, 40_000)), i, rng.choice(["hot", "hot", "a", "b"]), rng.choice(["set", "get", "get", "delete"]), str(i))
        for i in range(300)
    ) + [(T0 + timedelta(days=9), 999, "end", "delete", None)]
    schema = "at TIMESTAMP, seq BIGINT, key STRING, op STRING, value STRING"
    got = run(rows, schema, lambda s: ttl.read_stream(s, 3600, "1 hour"))
    want = ttl.reads(spark.createDataFrame(rows, schema), 3600)
    cols = ["key", "seq", "value"]
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))


def late(rows, minutes, rng):
    """Rows in an order that is up to so many minutes off."""
    return sorted(rows, key=lambda r: r[0] + timedelta(minutes=rng.uniform(0, minutes)))


@pytest.mark.parametrize("seed", [1, 2])
def test_ttl_stream_takes_late_rows(spark, run, seed):
    rng = random.Random(seed)
    rows = [
        (T0 + timedelta(seconds=rng.randint(0, 40_000)), i, rng.choice(["hot", "hot", "a", "b"]), rng.choice(["set", "get", "get", "delete"]), str(i))
        for i in range(300)
    ]
    rows = late(rows, 50, rng) + [(T0 + timedelta(days=9), 999, "end", "delete", None)]
    schema = "at TIMESTAMP, seq BIGINT, key STRING, op STRING, value STRING"
    got = run(rows, schema, lambda s: ttl.read_stream(s, 3600, "1 hour"), files=6)
    want = ttl.reads(spark.createDataFrame(rows, schema), 3600)
    cols = ["key", "at", "seq", "value"]
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))
    assert run.held <= 2  # the last row and its timer


@pytest.mark.parametrize("seed", [1, 2])
def test_job_stream_takes_late_rows(spark, run, seed):
    rng = random.Random(seed)
    rows, n = [], 0
    for job in range(40):
        start = rng.randint(0, 300)
        for step in range(5):
            status = rng.choice(["queued", "downloading", "downloaded", "dead"]) if step else "queued"
            rows.append((T0 + timedelta(minutes=start + step * rng.randint(1, 20)), n, f"j{job}", status))
            n += 1
    rows = late(rows, 50, rng) + [(T0 + timedelta(days=9), 999, "last", "downloaded")]
    schema = "ts TIMESTAMP, event_id BIGINT, job_id STRING, status STRING"
    got = run(rows, schema, lambda s: jobs.outcome_stream(s, 30, "1 hour", forget_minutes=24 * 60), files=6)
    want = jobs.outcomes(spark.createDataFrame(rows, schema)).where("job_id <> 'last'")
    cols = ["job_id", "outcome", "status", "finished_at", "started_at"]
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))
    assert run.held <= 2


def test_job_stream_equals_batch(spark, run):
    rng = random.Random(9)
    rows = []
    for job in range(30):
        start = rng.randint(0, 300)
        for step in range(4):
            status = rng.choice(["queued", "downloading", "downloaded", "dead"]) if step else "queued"
            rows.append((T0 + timedelta(minutes=start + step * rng.randint(1, 20)), f"j{job}", status))
    # one late job moves the watermark past every limit
    rows = [(t, i, j, s) for i, (t, j, s) in enumerate(sorted(rows))] + [(T0 + timedelta(days=3), 999, "last", "downloaded"), (T0 + timedelta(days=4), 1000, "end", "queued")]
    schema = "ts TIMESTAMP, event_id BIGINT, job_id STRING, status STRING"
    got = run(rows, schema, lambda s: jobs.outcome_stream(s, 30, "2 hours"))
    want = jobs.outcomes(spark.createDataFrame(rows, schema)).where("job_id <> 'end'")
    cols = ["job_id", "outcome", "status", "finished_at", "started_at"]
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))


def test_session_stream_equals_batch(spark, run):
    rng = random.Random(6)
    rows = sorted((T0 + timedelta(minutes=rng.randint(0, 3000)), i, rng.choice("aab")) for i in range(200))
    rows.append((T0 + timedelta(days=9), 999, "end"))
    schema = "ts TIMESTAMP, i BIGINT, k STRING"
    got = run(rows, schema, lambda s: sessions.session_stream(s, "k", "ts", "45 minutes", "1 hour"))
    want = sessions.idle_sessions(spark.createDataFrame(rows, schema), "k", "ts", ["i"], 45 * 60).where("k <> 'end'")
    cols = ["k", "started_at", "last_used", "requests"]
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))


def test_upsert_stream_is_idempotent_and_compacts(spark, tmp_path):
    rng = random.Random(8)
    rows = [(f"k{rng.randint(0, 20)}", i, f"v{i}") for i in range(200)]
    schema = "k STRING, at BIGINT, v STRING"
    source, table, state = (str(tmp_path / n) for n in ("in", "table", "state"))
    for part in (rows[100:], rows[:100]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    want = {}
    for k, at, v in rows:
        want[k] = (v, want.get(k, (None, at))[1])

    def read(path):
        return {r["k"]: (r["v"], r["first_arrival"]["at"]) for r in upsert.current(spark, path, ["k"], ["at"]).collect()}

    # a second run with a lost checkpoint reads the same files again
    for attempt in (state, state + "2"):
        writer = upsert.upsert_stream(stream, table, attempt, ["k"], ["at"])
        writer.trigger(availableNow=True).start().awaitTermination()
        assert read(table) == want
    # a new checkpoint with other files adds to the table
    other = str(tmp_path / "other")
    spark.createDataFrame([("new", 7, "v"), ("k1", 10_000, "newest")], schema).coalesce(1).write.parquet(other)
    more = spark.readStream.schema(schema).parquet(other)
    upsert.upsert_stream(more, table, state + "3", ["k"], ["at"]).trigger(availableNow=True).start().awaitTermination()
    want |= {"new": ("v", 7), "k1": ("newest", want["k1"][1])}
    assert read(table) == want
    upsert.compact(spark, table, ["k"], ["at"])
    assert read(table) == want and len(list((tmp_path / "table").glob("delta=*"))) == 1
    spark.createDataFrame([("k2", 20_000, "later")], schema).coalesce(1).write.mode("append").parquet(other)
    upsert.upsert_stream(more, table, state + "3", ["k"], ["at"]).trigger(availableNow=True).start().awaitTermination()
    assert read(table) == want | {"k2": ("later", want["k2"][1])}
