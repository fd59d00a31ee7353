"""State over time: batch forms with oracles, streams driven to completion."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from titleloom.functions import attributes as A
from titleloom.operators import rank
from titleloom.plans import search
from titleloom.queries.base import query, table
from titleloom.queries.joins import LINKED, clean_titles
from titleloom.queries.ranks import BEST_SQL, _BASE, _upsert_sql
from titleloom.streaming import availability, health, jobs, leaders, requests, sessions, standing, ttl, upsert, versions
from titleloom.streaming.bounded import STATE_STORE, STORE_SETTING, run_in_steps, run_to_end
from titleloom.workspace import new_folder, open_writers

GAP_SECONDS = 6 * 3600


def change_log(events):
    """Purchases set, errors delete, all other events read."""
    op = F.when(F.col("event_type") == "purchase", "set").when(F.col("event_type") == "error", "delete").otherwise("get")
    return events.select(
        F.col("user_id").cast("string").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("seq"),
        op.alias("op"), F.col("value").cast("string").alias("value"),
    )


_LOG = "e AS (SELECT user_id, event_id, ts, value, CASE event_type WHEN 'purchase' THEN 'set' WHEN 'error' THEN 'delete' ELSE 'get' END AS op FROM events)"
_READS = f"""WITH {_LOG},
s AS (SELECT r.event_id, r.user_id, r.ts, max_by(w.event_id, struct_pack(a := w.ts, b := w.event_id)) AS seen FROM e r LEFT JOIN e w ON w.user_id=r.user_id AND w.op<>'get' AND (w.ts<r.ts OR (w.ts=r.ts AND w.event_id<r.event_id)) WHERE r.op='get' GROUP BY ALL)
SELECT s.event_id AS seq, CAST(s.user_id AS VARCHAR) AS key, CASE WHEN w.op='set' AND s.ts-w.ts <= INTERVAL 6 HOURS THEN w.value END AS value"""


@query(
    "x1_ttl_reads",
    _READS + ", CASE WHEN w.op='set' AND s.ts-w.ts <= INTERVAL 6 HOURS THEN epoch_us(s.ts)-epoch_us(w.ts) END AS age_micros FROM s LEFT JOIN e w ON w.event_id=s.seen",
)
def x1(spark, sf):
    found = ttl.reads(change_log(table(spark, sf, "events")), GAP_SECONDS)
    return found.select("seq", "key", F.col("value").cast("double").alias("value"), "age_micros")


@query(
    "x1_ttl_live",
    f"""WITH {_LOG}, l AS (SELECT user_id, max_by(event_id, struct_pack(a := ts, b := event_id)) AS id FROM e WHERE op<>'get' GROUP BY user_id)
SELECT CAST(e.user_id AS VARCHAR) AS key, e.value FROM l JOIN e ON e.event_id=l.id WHERE op='set' AND (SELECT max(ts) FROM e)-e.ts <= INTERVAL 6 HOURS""",
)
def x1_live(spark, sf):
    events = table(spark, sf, "events")
    now = events.agg(F.max("ts").alias("now")).scalar()
    return ttl.live(change_log(events), now, GAP_SECONDS).select("key", F.col("value").cast("double").alias("value"))


_SESSIONS = """WITH f AS (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER w IS NULL OR ts-lag(ts) OVER w > INTERVAL 6 HOURS THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, CAST(sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM f),
g AS (SELECT user_id, session, CAST(min(ts) AS VARCHAR) AS started_at, CAST(max(ts) AS VARCHAR) AS last_used, count(*) AS requests FROM n GROUP BY user_id, session)"""


@query("x2_idle_sessions", _SESSIONS + " SELECT * FROM g")
def x2(spark, sf):
    out = sessions.idle_sessions(table(spark, sf, "events"), "user_id", "ts", ["event_id"], GAP_SECONDS)
    return out.select(
        "user_id", "session", F.col("started_at").cast("string").alias("started_at"),
        F.col("last_used").cast("string").alias("last_used"), "requests",
    )


@query(
    "x4_job_outcomes",
    """WITH s AS (SELECT job_id, min(ts) AS started_at FROM v_job GROUP BY job_id),
t AS (SELECT job_id, min(ts) AS ts, min_by(status, struct_pack(a := ts, b := event_id)) AS status FROM v_job WHERE status IN ('downloaded','magnet_error','virus','dead','error') GROUP BY job_id)
SELECT s.job_id, CASE WHEN t.ts IS NULL OR t.ts-s.started_at >= INTERVAL 720 MINUTES THEN 'stalled' WHEN status='downloaded' THEN 'success' ELSE 'failure' END AS outcome,
 CASE WHEN t.ts-s.started_at < INTERVAL 720 MINUTES THEN CAST(t.ts AS VARCHAR) END AS finished_at, CASE WHEN t.ts-s.started_at < INTERVAL 720 MINUTES THEN status END AS status
FROM s LEFT JOIN t USING (job_id)""",
)
def x4(spark, sf):
    out = jobs.outcomes(table(spark, sf, "v_job"), limit_minutes=720)
    return out.select("job_id", "outcome", F.col("finished_at").cast("string").alias("finished_at"), "status")


# --- streams over the same tables, run until their input is used up --------


def event_stream(spark, sf, name="events"):
    """The table as a stream of one file, with an instant instead of a wall-clock time."""
    path = f"{sf}/{name}.parquet"
    # the glob lets the stream take a single file as well as a folder
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows


def drain(spark, stream, name):
    """Run a stream to the end of its input and read what it wrote."""
    out, state = new_folder(spark, name), new_folder(spark, f"{name}-state")
    before = spark.conf.get(STORE_SETTING, None)
    spark.conf.set(STORE_SETTING, STATE_STORE)
    try:
        run = stream.writeStream.format("parquet").option("checkpointLocation", state).outputMode("append")
        run.trigger(availableNow=True).start(out).awaitTermination()
    finally:
        spark.conf.unset(STORE_SETTING) if before is None else spark.conf.set(STORE_SETTING, before)
    return spark.read.schema(stream.schema).parquet(out)


def after_end(spark, sf):
    """An instant that is later than all events by more than any limit here."""
    last = table(spark, sf, "events").agg(F.max("ts")).first()[0]
    return (last or datetime(2000, 1, 1)) + timedelta(days=30)


@query("x1_ttl_reads_stream", _READS + " FROM s LEFT JOIN e w ON w.event_id=s.seen")
def x1_stream(spark, sf):
    log = change_log(event_stream(spark, sf))
    end = [("", after_end(spark, sf), -1, "delete", None)]
    found = run_to_end(spark, [log], [end], lambda rows: ttl.read_stream(rows, GAP_SECONDS), "ttl")
    return found.select("seq", "key", F.col("value").cast("double").alias("value"))


@query(
    "x2_session_stream",
    _SESSIONS + " SELECT user_id, started_at, last_used, requests FROM g WHERE CAST(last_used AS TIMESTAMP) + INTERVAL 6 HOURS <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)",
)
def x2_stream(spark, sf):
    closed = sessions.session_stream(event_stream(spark, sf), "user_id", "ts", "6 hours", "1 hour")
    return drain(spark, closed, "sessions").select(
        "user_id", F.col("started_at").cast("string").alias("started_at"), F.col("last_used").cast("string").alias("last_used"), "requests"
    )


@query("x3_upsert_stream", _upsert_sql("work_id, link"))
def x3(spark, sf):
    """Listings arrive as files; the table equals the batch upsert of all rows."""
    landing, target, state = (new_folder(spark, n) for n in ("landing", "upserted", "upserted-state"))
    keys, arrival, buckets = ["work_id", "link"], ["arrived_at", "row_key"], int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = table(spark, sf, "v_listing").select(
        A.base_id(F.col("composite_id")).alias("work_id"), "link", "row_key", "raw_title", "arrived_at"
    )
    third = F.pmod(F.xxhash64("row_key"), F.lit(3)).alias("third")  # three folders land one after the other
    with open_writers(spark):
        rows.select("*", third).write.option("compression", "zstd").partitionBy("third").parquet(landing)
    files = max(1, len(spark.read.parquet(landing).inputFiles()) // 3)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{landing}/third=*")
    writer = upsert.upsert_stream(stream, target, state, keys, arrival, buckets)
    writer.trigger(availableNow=True).start().awaitTermination()
    now = upsert.current(spark, target, keys, arrival, buckets)
    return now.select(*keys, "row_key", "raw_title", F.col("first_arrival.row_key").alias("first_row"))


@query(
    "x4_job_outcome_stream",
    """WITH s AS (SELECT job_id, min(ts) AS started_at FROM v_job GROUP BY job_id),
t AS (SELECT job_id, min(ts) AS ts, min_by(status, struct_pack(a := ts, b := event_id)) AS status FROM v_job WHERE status IN ('downloaded','magnet_error','virus','dead','error') GROUP BY job_id)
SELECT CAST(s.job_id AS VARCHAR) AS job_id, CASE WHEN t.ts IS NULL OR t.ts-s.started_at >= INTERVAL 720 MINUTES THEN 'stalled' WHEN status='downloaded' THEN 'success' ELSE 'failure' END AS outcome,
 CASE WHEN t.ts-s.started_at < INTERVAL 720 MINUTES THEN status END AS status
FROM s LEFT JOIN t USING (job_id)""",
)
def x4_stream(spark, sf):
    status = F.expr(
        "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'downloading' WHEN 'click' THEN 'uploading' WHEN 'purchase' THEN 'downloaded' ELSE 'dead' END"
    )
    rows = event_stream(spark, sf).select(F.col("user_id").cast("string").alias("job_id"), "ts", "event_id", status.alias("status"))
    end = [("", after_end(spark, sf), -1, "queued")]  # waits for its own limit, so it has no outcome
    build = lambda r: jobs.outcome_stream(r, 720, forget_minutes=10 * 366 * 24 * 60)
    return run_to_end(spark, [rows], [end], build, "jobs").select("job_id", "outcome", "status")


_BATCHES = f"""WITH r AS (SELECT {_BASE} AS work_id, row_key, raw_title, arrived_at, listing_id % 3 + 1 AS batch, seeders IS NULL AS gone FROM v_listing),
n AS (SELECT version, work_id, row_key, raw_title, gone, row_number() OVER (PARTITION BY version, work_id ORDER BY batch, arrived_at, row_key) AS i FROM r JOIN (VALUES (1), (2), (3)) v(version) ON batch <= version),
d AS (SELECT version, work_id, coalesce(max(i) FILTER (gone), 0) AS wiped, max(i) AS last FROM n GROUP BY version, work_id)
SELECT d.version, d.work_id, l.row_key, l.raw_title, f.row_key AS first_row FROM d JOIN n l ON l.version = d.version AND l.work_id = d.work_id AND l.i = d.last
 JOIN n f ON f.version = d.version AND f.work_id = d.work_id AND f.i = d.wiped + 1 WHERE d.last > d.wiped"""


@query("x3_versioned_table", _BATCHES)
def x3_versions(spark, sf):
    """Listings and removals (rows without seeders) arrive in three batches, with a compaction before the last; then all three states are read."""
    landing, target, state = (new_folder(spark, n) for n in ("landing", "versions", "versions-state"))
    keys, arrival = ["work_id"], ["arrived_at", "row_key"]
    rows = table(spark, sf, "v_listing").select(
        A.base_id(F.col("composite_id")).alias("work_id"), "row_key", "raw_title", "arrived_at", F.col("seeders").isNull().alias("deleted"),
        (F.col("listing_id") % 3 + 1).alias("batch"),
    )
    rows.write.partitionBy("batch").parquet(landing)
    shape = rows.drop("batch").schema
    held = {}
    for batch in (1, 2, 3):
        if batch == 3:
            versions.compact(spark, target, keys)
        arrived = spark.readStream.schema(shape).parquet(f"{landing}/batch={batch}")
        versions.upsert_stream(arrived, target, f"{state}{batch}", keys, arrival).trigger(availableNow=True).start().awaitTermination()
        held[batch] = versions.versions(spark, target)[-1]
    states = [versions.read(spark, target, keys, v).select(F.lit(b).alias("version"), *keys, "row_key", "raw_title", F.col("first_arrival.row_key").alias("first_row")) for b, v in held.items()]
    return states[0].unionAll(states[1]).unionAll(states[2])


_AS_OF = """WITH r AS (SELECT event_id, user_id, ts FROM events WHERE event_type IN ('view', 'click')),
c AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'purchase' THEN 'downloaded' WHEN 'signup' THEN 'queued' ELSE 'dead' END AS status FROM events WHERE event_type NOT IN ('view', 'click')),
l AS (SELECT r.event_id, max_by(c.status, struct_pack(a := c.ts, b := c.event_id)) AS status FROM r JOIN c ON c.user_id = r.user_id AND c.ts <= r.ts AND c.ts > r.ts - INTERVAL 6 HOURS GROUP BY r.event_id)
SELECT r.event_id AS request_id, CAST(r.user_id AS VARCHAR) AS key, l.status, coalesce(l.status = 'downloaded', false) AS available FROM r LEFT JOIN l USING (event_id)"""


def _asked_and_told(events):
    """Views and clicks ask, other events change the status."""
    asks = F.col("event_type").isin("view", "click")
    key = F.col("user_id").cast("string").alias("key")
    status = F.when(F.col("event_type") == "purchase", "downloaded").when(F.col("event_type") == "signup", "queued").otherwise("dead")
    asked = events.where(asks).select(F.col("event_id").alias("request_id"), key, F.col("ts").alias("at"))
    told = events.where(~asks).select(key, F.col("ts").alias("changed_at"), F.col("event_id").alias("seq"), status.alias("status"))
    return asked, told


@query("j8_availability_as_of", _AS_OF)
def j8_as_of(spark, sf):
    asked, told = _asked_and_told(table(spark, sf, "events"))
    return availability.as_of(asked, told, GAP_SECONDS).select("request_id", "key", "status", "available")


@query("j8_availability_stream", _AS_OF)
def j8_stream(spark, sf):
    asked, told = _asked_and_told(event_stream(spark, sf))
    last = after_end(spark, sf)
    # the end's own request still waits when the input ends
    ends = [[(-1, "", last)], [("", last, -1, "dead")]]
    build = lambda a, t: availability.as_of_stream(a, t, GAP_SECONDS)
    return run_to_end(spark, [asked, told], ends, build, "as-of").select("request_id", "key", "status", "available")


@query("j1_standing_stream", LINKED)
def j1_standing(spark, sf):
    """Titles arrive file by file and meet the stored queries; all batches together link what one batch job links."""
    landing, buckets = new_folder(spark, "landing"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    clean_titles(spark, sf).write.parquet(landing)
    files = max(1, len(spark.read.parquet(landing).inputFiles()) // 3)
    arriving = spark.readStream.schema("title STRING").option("maxFilesPerTrigger", files).parquet(landing)
    stored = standing.store_queries(table(spark, sf, "v_query"), buckets)
    pairs = drain(spark, standing.match(spark, arriving, stored), "linked")
    return pairs.select("query_id", "title", "match_type", F.round("confidence", 6).alias("confidence"))


@query("w1_best_stream", BEST_SQL)
def w1_stream(spark, sf):
    """Listings arrive in three parts and meet the stored queries; the changes of the best three, replayed, give what one batch job gives."""
    listings = search.searchable(table(spark, sf, "v_listing")).drop("link")
    parts = [listings.where(F.pmod(F.xxhash64("row_key"), F.lit(3)) == i) for i in range(3)]
    stored = standing.store_queries(table(spark, sf, "v_query"), int(spark.conf.get("spark.sql.shuffle.partitions")))
    out, state = new_folder(spark, "best"), new_folder(spark, "best-state")
    shapes = []

    def start(arriving):
        pairs = standing.match(spark, leaders.best_of_titles(arriving), stored, keep=["row_key", "tier", "seeders", "size_bytes"])
        score = A.relevance_score(F.col("tier"), F.col("confidence"), F.col("title"), F.col("seeders"))
        changes = leaders.best_changes(pairs.withColumn("relevance_score", score), ["title", "match_type"])
        shapes.append(changes.schema)
        return changes.writeStream.format("parquet").option("checkpointLocation", state).option("path", out).outputMode("append")

    run_in_steps(spark, parts, start, "listings")
    best = rank.best_per_tier(leaders.replayed(spark.read.schema(shapes[-1]).parquet(out)))
    return best.select(
        "query_id", "tier", "rank", "row_key", "title", "match_type", F.round("confidence", 6).alias("confidence"),
        "relevance_score", "seeders", "size_bytes", "tier_order",
    )


LATE_SECONDS = 1800


def by_arrival(events, steps=3):
    """The events in parts of equal time, each row up to half an hour late."""
    arrival = F.unix_seconds(F.col("ts").cast("timestamp")) + F.pmod(F.xxhash64("event_id"), F.lit(LATE_SECONDS))
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("_arrival", arrival)
    first, last = rows.agg(F.min("_arrival"), F.max("_arrival")).first()
    step = F.floor((F.col("_arrival") - F.lit(first)) * steps / F.lit((last or 0) - (first or 0) + 1))
    part = F.coalesce(step, F.lit(0))
    return [rows.where(part == i).drop("_arrival") for i in range(steps)]


@query(
    "t19_requests_once_stream",
    """SELECT DISTINCT CASE WHEN event_type='signup' THEN concat('app://', user_id) ELSE
 array_to_string(list_filter([event_type, nullif(CAST(user_id AS VARCHAR),''), json_extract_string(props,'$.k')], lambda x: x IS NOT NULL AND x<>''), '|') END AS request_key,
 CAST(CAST(date_trunc('hour', ts) AS TIMESTAMP) AS VARCHAR) AS span_start FROM events""",
)
def t19_stream(spark, sf):
    """Requests that come again within the hour are answered once, whatever the order of their arrival."""
    url = F.when(F.col("event_type") == "signup", F.concat(F.lit("app://"), F.col("user_id").cast("string")))
    key = A.request_key([F.col("event_type"), F.col("user_id"), F.get_json_object("props", "$.k")], url).alias("request_key")
    out, state = new_folder(spark, "once"), new_folder(spark, "once-state")

    def start(arriving):
        found = requests.once(arriving.select(key, "ts"), "request_key", "ts", 3600, 3600).select("request_key", "span_start")
        return found.writeStream.format("parquet").option("checkpointLocation", state).option("path", out).outputMode("append")

    run_in_steps(spark, by_arrival(table(spark, sf, "events")), start, "requests")
    found = spark.read.schema("request_key STRING, span_start TIMESTAMP").parquet(out)
    return found.select("request_key", F.col("span_start").cast("string").alias("span_start"))


_HEALTH = """WITH p AS (SELECT s.w AS w, event_type AS source, count(*) AS probes, count(*) FILTER (event_type='error' OR value<1) AS failures, round(avg(value) FILTER (event_type<>'error' AND value>=1), 6) AS mean_time
 FROM (SELECT event_type, value, unnest([time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') - INTERVAL 6 HOURS]) AS w FROM events) s GROUP BY 1, 2)
SELECT CAST(w AS VARCHAR) AS window_start, source, probes, failures, mean_time, mean_time IS NOT NULL AS healthy, rank, rank=1 AS chosen
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY w ORDER BY mean_time IS NULL, mean_time, source) AS INT) AS rank FROM p) x"""
PROBE_ORDER = ["click", "purchase", "signup", "view"]


def _probe():
    return (F.col("event_type") != "error") & (F.col("value") >= 1), F.col("value")


def _ranked_health(windows):
    return health.chosen(windows, PROBE_ORDER).select(
        F.col("window_start").cast("string").alias("window_start"), "source", "probes", "failures", "mean_time", "healthy", "rank", "chosen"
    )


@query("a7_health_by_window", _HEALTH)
def a7_windows(spark, sf):
    ok, time = _probe()
    return _ranked_health(health.per_window(table(spark, sf, "events"), "event_type", ok, time, "ts", "12 hours", "6 hours"))


@query("a7_health_stream", _HEALTH)
def a7_stream(spark, sf):
    """Probes arrive in three parts; the last update of each window equals the batch form."""
    ok, time = _probe()
    path, state = new_folder(spark, "health"), new_folder(spark, "health-state")
    start = lambda rows: health.update_stream(rows, path, state, "event_type", ok, time, "ts", "12 hours", "6 hours", f"{LATE_SECONDS} seconds")
    run_in_steps(spark, by_arrival(table(spark, sf, "events")), start, "probes")
    return _ranked_health(health.latest(spark, path))
