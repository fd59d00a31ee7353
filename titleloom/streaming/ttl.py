"""Latest value per key with a time to live."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titleloom import rules

# A change log row: key, at (timestamp), seq (order within one instant),
# op (set | get | delete), value (string, for set).


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def reads(log: DataFrame, ttl_seconds: int = rules.CACHE_TTL_SECONDS) -> DataFrame:
    """Every get with the value it sees; null once age exceeds the ttl (batch).

    A write that is still valid lies in the read's own ttl-wide bucket or in
    the one before. So each (key, bucket) is ordered alone and only its last
    write moves on by one bucket; a hot key spreads over its buckets.
    """
    ttl = ttl_seconds * 1_000_000
    keyed = log.withColumn("_at", _micros(F.col("at"))).withColumn("_bucket", F.floor(F.col("_at") / ttl))
    write = F.when(F.col("op") != "get", F.struct("_at", "op", "value"))
    last = (
        keyed.where(F.col("op") != "get")
        .groupBy("key", "_bucket")
        .agg(F.max_by(F.struct("_at", "op", "value"), F.struct("_at", "seq")).alias("_before"))
        .select("key", (F.col("_bucket") + 1).alias("_bucket"), "_before")
    )
    inner = Window.partitionBy("key", "_bucket").orderBy("_at", "seq").rowsBetween(Window.unboundedPreceding, 0)
    seen = keyed.join(last, ["key", "_bucket"], "left").withColumn(
        "_seen", F.coalesce(F.last(write, ignorenulls=True).over(inner), F.col("_before"))
    )
    age = F.col("_at") - F.col("_seen._at")
    valid = (F.col("_seen.op") == "set") & (age <= ttl)
    return seen.where(F.col("op") == "get").select(
        "key", "at", "seq", F.when(valid, F.col("_seen.value")).alias("value"), F.when(valid, age).alias("age_micros")
    )


def live(log: DataFrame, as_of: Column, ttl_seconds: int = rules.CACHE_TTL_SECONDS) -> DataFrame:
    """Keys that hold a valid value at as_of, with that value (batch)."""
    last = (
        log.where(F.col("op") != "get")
        .groupBy("key")
        .agg(F.max_by(F.struct("at", "op", "value"), F.struct("at", "seq")).alias("w"))
    )
    age = _micros(as_of) - _micros(F.col("w.at"))
    return last.where((F.col("w.op") == "set") & (age <= ttl_seconds * 1_000_000)).select(
        "key", F.col("w.at").alias("at"), F.col("w.value").alias("value")
    )


def stats(log: DataFrame, as_of: Column, ttl_seconds: int = rules.CACHE_TTL_SECONDS) -> DataFrame:
    """One row: keys ever written and not deleted last, and those still valid at as_of (batch)."""
    keys = log.where(F.col("op") != "get").groupBy("key").agg(F.max_by("op", F.struct("at", "seq")).alias("op"))
    held = keys.agg(F.count_if(F.col("op") == "set").alias("held"))
    return held.crossJoin(F.broadcast(live(log, as_of, ttl_seconds).agg(F.count(F.lit(1)).alias("valid"))))  # one row each


def cleared(log: DataFrame, at: Column, seq: Column) -> DataFrame:
    """Rows to append to the log that delete every key it holds."""
    keys = log.where(F.col("op") == "set").select("key").distinct()
    return keys.select("key", at.alias("at"), seq.alias("seq"), F.lit("delete").alias("op"), F.lit(None).cast("string").alias("value"))


READ_SCHEMA = "key STRING, at_us BIGINT, seq BIGINT, value STRING"


def read_stream(log: DataFrame, ttl_seconds: int = rules.CACHE_TTL_SECONDS, delay: str = "10 minutes") -> DataFrame:
    """Streaming twin of reads, also for rows that come late: key, at, seq, value.

    Rows wait until the watermark has passed them and are then applied in (at,
    seq) order, so a read sees what the batch form sees. A key holds its waiting
    rows and one value, which goes when its time to live is over. Rows older than
    the watermark are dropped by Spark. Needs the RocksDB state store.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    ttl = ttl_seconds * 1_000_000
    columns = ["key", "at_us", "seq", "value"]

    class TtlState(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.waiting = handle.getListState("waiting", "at BIGINT, seq BIGINT, op STRING, value STRING")
            self.entry = handle.getValueState("entry", "at BIGINT, value STRING")

        def handleInputRows(self, key, rows, timerValues) -> Iterator:
            import pandas as pd

            first = None
            for pdf in rows:
                self.waiting.appendList(list(pdf[["at_us", "seq", "op", "value"]].itertuples(index=False, name=None)))
                least = int(pdf["at_us"].min())
                first = least if first is None else min(first, least)
            self.handle.registerTimer(first // 1000 + 1)
            yield pd.DataFrame([], columns=columns)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
            import numpy as np
            import pandas as pd

            passed = timerValues.getCurrentWatermarkInMs() * 1000
            waiting = pd.DataFrame(list(self.waiting.get()) if self.waiting.exists() else [], columns=["at", "seq", "op", "value"])
            ready = waiting[waiting["at"] <= passed].sort_values(["at", "seq"])
            rest = waiting[waiting["at"] > passed]
            if len(rest):
                self.waiting.put(list(rest.itertuples(index=False, name=None)))
                self.handle.registerTimer(int(rest["at"].min()) // 1000 + 1)
            elif len(waiting):
                self.waiting.clear()
            held = self.entry.get() if self.entry.exists() else None
            if held is not None:
                ready = pd.concat([pd.DataFrame([(held[0], -1, "set", held[1])], columns=ready.columns), ready])
            op, at = ready["op"].to_numpy(), ready["at"].to_numpy(np.int64)
            value = ready["value"].to_numpy(object)
            write, get = op != "get", op == "get"
            last = np.maximum.accumulate(np.where(write, np.arange(len(op)), -1)) if len(op) else np.zeros(0, np.int64)
            seen = last[get]
            valid = (seen >= 0) & (op[seen] == "set") & (at[get] - at[seen] <= ttl) if len(seen) else np.zeros(0, bool)
            out = pd.DataFrame({"key": key[0], "at_us": at[get], "seq": ready["seq"].to_numpy(np.int64)[get], "value": np.where(valid, value[seen] if len(seen) else None, None)}, columns=columns)
            now = int(last[-1]) if len(last) else -1
            if now >= 0 and op[now] == "set" and at[now] + ttl >= passed:
                self.entry.update((int(at[now]), value[now]))
                self.handle.registerTimer(int(at[now] + ttl) // 1000 + 1)
            elif held is not None:
                self.entry.clear()
            yield out

        def close(self) -> None:
            pass

    rows = log.withWatermark("at", delay).select("key", "at", "seq", "op", "value", F.unix_micros("at").alias("at_us"))
    found = rows.groupBy("key").transformWithStateInPandas(TtlState(), READ_SCHEMA, "Append", "EventTime")
    return found.select("key", F.timestamp_micros("at_us").alias("at"), "seq", "value")
