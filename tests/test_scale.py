"""What the plans and files of large jobs must hold, so that their cost grows no faster than the input."""

import contextlib
import io
import re

from pyspark.sql import functions as F

from titleloom.functions import attributes as A
from titleloom.functions import text as X
from titleloom.operators import lookup, quality, rank
from titleloom.plans import curated
from titleloom.sources import catalogue, keyed, payloads
from titleloom.streaming import upsert
from titleloom.workspace import WRITERS, open_writers, stored


def plan_of(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain()
    return text.getvalue()


@contextlib.contextmanager
def no_broadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def test_integrity_checks_deal_the_items_once(spark):
    from tests.conftest import SF_DIR
    from titleloom.queries import QUERIES

    with no_broadcast(spark):
        checks = QUERIES["j9_integrity"](spark, SF_DIR)
        checks.collect()
        plan = checks._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    dealt = [x for x in final.splitlines() if re.search(r" Exchange hashpartitioning\(content_hash", x)]
    assert len(dealt) + len(re.findall("ReusedExchange", final)) >= 5 and final.count("ReusedExchange") >= 2


def test_wanted_last_finds_the_same_items_and_moves_them_once_less(spark):
    items = spark.createDataFrame([(k, e, f"i{n}", f"h{n % 7}") for n, (k, e) in enumerate([("a", 1), ("a", 1), ("b", 2), (None, 1), ("c", None)] * 4)],
                                  "work STRING, episode INT, item_key STRING, content_hash STRING")
    listings = spark.createDataFrame([(f"h{n}", n if n % 3 else None, f"r{n}") for n in range(6)], "content_hash STRING, seeders INT, row_key STRING")
    wanted = items.where("work <> 'b' OR work IS NULL")
    with no_broadcast(spark):
        first, last = (lookup.items_of_work(wanted, items, listings, ["work", "episode"], limit=3, tie=["item_key"], wanted_last=w) for w in (False, True))
        cols = sorted(first.columns)
        assert sorted(map(str, last.select(cols).collect())) == sorted(map(str, first.select(cols).collect())) != []
        moves = [len(re.findall(r"Exchange hashpartitioning", plan_of(d))) for d in (first, last)]
    assert moves == [5, 4]


def test_good_rows_compute_their_columns_once(spark):
    columns = ["composite_id", "raw_title", "link", "seeders", "row_key"]
    rows = spark.createDataFrame(
        [("tt1:2:3", "A 1080p", "cat:?a", 3, "r1"), ("tt2", "B 480p", "cat:?b", 3, "r2"), ("tt3", None, "cat:?c", 3, "r3"),
         (None, "D 4k", "cat:?d", 3, "r4"), ("tt5", "E 4k", "cat:?e", None, "r5"), ("tt6", "F 2160P", "cat:?f", 1, "r6")],
        "composite_id STRING, raw_title STRING, link STRING, seeders INT, row_key STRING",
    )
    kept = curated.curate(rows.select(*columns), "cat:?", ["row_key"])
    assert plan_of(kept).count("4K|2160p") == 1
    assert sorted((r.work_id, r.tier, r.row_key) for r in kept.collect()) == [("tt1", "1080p", "r1"), ("tt6", "4K", "r6")]
    odd = rows.withColumn("a.b", F.lit(1)).withColumn("failures", F.array().cast("array<string>")).withColumn("first_failure", F.lit(None))
    assert quality.good(odd).columns == [*rows.columns, "a.b"] and quality.good(odd).count() == 6


def test_tiers_of_gathered_listings_are_computed_once(spark):
    payload = '{"results":[{"title":"X Full HD","magnet_link":"m"},{"title":"Y 4K","magnet_link":"n","seed_count":7}],"count":2}'
    rows = spark.createDataFrame([(payload, "p", 40), ("broken", "q", None)], "payload STRING, provider STRING, base INT")
    found = payloads.from_search_payload(rows, "payload", F.lit("2002-01-01"))
    assert plan_of(found).count("hd.rip") == 1
    assert sorted((r.title, r.tier, r.seeders) for r in found.collect()) == [("X Full HD", "HD", 44), ("Y 4K", "2160p", 7)]


def test_shortcuts_of_title_columns_change_no_value(values):
    titles = ["a b", "a  b", " a", "a\tb", "a b", "a  b", "é  x", "a\rb", "a\x0bb", "", None, "a\u0085b"]
    plain = F.regexp_replace(X.narrow_space(F.col("x")), r"\s{2,}|[\t\n\x0B\f\r]", " ")
    assert values(X.single_space(F.col("x")), titles) == values(plain, titles)
    sizes = ["12.5 GB", "5gb and 3 MB", "7 KB", "1.2.3 M", "9 x 4 mib", "", None, "3.g"]
    pattern = r"(?i)(\d+\.?\d*)\s*(GB|MB|G|M)"
    number = F.nullif(F.regexp_extract("x", pattern, 1), F.lit("")).try_cast("double")
    unit = F.upper(F.substring(F.regexp_extract("x", pattern, 2), 1, 1))
    whole = F.coalesce(F.when(unit == "G", number * 1024.0**3).when(unit == "M", number * 1024.0**2), F.lit(1.5 * 1024**3))
    assert values(A.size_bytes(F.col("x")), sizes) == values(whole, sizes)


def test_partitioned_writes_keep_files_open_instead_of_sorting(spark, tmp_path):
    rows = spark.createDataFrame([("x", "movie", 1), ("y", "series", 2), ("z", None, 3)], "title STRING, type STRING, n INT")
    before = spark.conf.get(WRITERS, None)
    with open_writers(spark, 2):
        assert spark.conf.get(WRITERS) == "2"
    assert spark.conf.get(WRITERS, None) == before
    seen = []
    conf = type(spark.conf)
    put = conf.set
    conf.set = lambda self, key, value: (seen.append(key), put(self, key, value))[1]
    try:
        catalogue.append_catalogue(rows, str(tmp_path / "appended"))
        catalogue.write_table(rows, str(tmp_path / "table"), rows.schema, ["type"])
    finally:
        conf.set = put
    assert seen.count(WRITERS) >= 2 and spark.conf.get(WRITERS, None) == before
    for name in ("appended", "table"):
        assert sorted(r.n for r in spark.read.parquet(str(tmp_path / name)).collect()) == [1, 2, 3]
        files = list((tmp_path / name).rglob("*.parquet"))
        assert files and all(f.name.endswith(".zstd.parquet") for f in files)


def test_written_tables_are_packed(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k STRING, n INT")
    keyed.write_keyed(rows, "packed", ["k"], 2, path=str(tmp_path / "keyed"))
    files = list((tmp_path / "keyed").rglob("*.parquet"))
    assert files and all("zstd" in f.name for f in files)
    assert all(".zstd." in f for f in stored(rows, "rows").inputFiles())


def test_requests_are_written_so_that_their_size_is_known(spark, monkeypatch):
    written = []
    monkeypatch.setattr(curated, "stored", lambda df, name: (written.append(name), stored(df, name))[1])
    requests = spark.range(3).select(F.col("id").cast("string").alias("request_id"), F.concat(F.lit("tt"), "id").alias("work_id"), F.concat(F.lit("name "), "id").alias("wanted"))
    listings = spark.range(20_000).select(F.concat(F.lit("tt"), F.col("id") % 50).alias("work_id"), F.concat(F.lit("Name "), F.col("id") % 10).alias("raw_title"),
                                          F.lit("4K").alias("tier"), F.col("id").cast("int").alias("seeders"), F.col("id").cast("string").alias("row_key"))
    kept = curated.search_places(requests, listings, collation="UTF8_BINARY")
    assert "requests" in written
    assert kept.count() == 3 * 400 and sorted(r.via for r in kept.select("via").distinct().collect()) == ["id"]
def test_bucketed_upserts_move_no_row_when_read(spark, tmp_path):
    schema, source, table = "k STRING, at BIGINT, v STRING", str(tmp_path / "in"), str(tmp_path / "table")
    for part in ([("a", 1, "first"), ("b", 2, None), (None, 1, "no key")], [("a", 3, "last"), (None, 0, "older")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    want = {"a": ("last", 1), "b": (None, 2), None: ("no key", 0)}

    def read():
        now = upsert.current(spark, table, ["k"], ["at"], 8)
        assert "Exchange" not in plan_of(now)
        return {r["k"]: (r["v"], r["first_arrival"]["at"]) for r in now.collect()}

    for attempt in ("1", "2"):  # the second has lost its checkpoint and reads the same files again
        upsert.upsert_stream(stream, table, str(tmp_path / attempt), ["k"], ["at"], 8).trigger(availableNow=True).start().awaitTermination()
        assert read() == want
    upsert.compact(spark, table, ["k"], ["at"], 8)
    assert read() == want and len(list((tmp_path / "table").glob("delta=*"))) == 1


def test_a_bucketed_delta_replaces_itself(spark, tmp_path):
    folder = str(tmp_path / "delta=s-0")
    for values in (["old", "gone"], ["new"]):
        rows = spark.createDataFrame([(str(i), i, v) for i, v in enumerate(values)], "k STRING, at BIGINT, v STRING")
        upsert._write_delta(rows.repartition(8, "k"), folder, ["k"], 8)
    assert [r.v for r in spark.read.parquet(folder).collect()] == ["new"]


def test_the_last_row_carries_its_arrival_once(spark):
    rows = spark.createDataFrame([("a", 1, "x", "old"), ("a", 1, "y", None), ("a", None, "z", "undated"), (None, 2, "w", "no key")], "k STRING, at INT, id STRING, v STRING")
    now = rank.keyed_upsert(rows, ["k"], ["at", "id"])
    assert now.columns == ["k", "at", "id", "v", "first_arrival"] and "max_by" not in plan_of(now)
    assert sorted(map(str, ((r.k, r.at, r.id, r.v, tuple(r.first_arrival)) for r in now.collect()))) == sorted(
        map(str, [("a", 1, "y", None, (None, "z")), (None, 2, "w", "no key", (2, "w"))])
    )
    maps = rows.withColumn("m", F.array(F.struct(F.create_map("id", "v").alias("m"))))  # maps have no order
    assert sorted(r.m[0].m.popitem()[0] for r in rank.keyed_upsert(maps, ["k"], ["at", "id"]).collect()) == ["w", "y"]
