"""Tracking jobs to success, failure or a stall."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titleloom import rules


def outcomes(
    timeline: DataFrame, key: str = "job_id", ts: str = "ts", tie: str = "event_id",
    limit_minutes: int = rules.JOB_LIMIT_MINUTES,
    success: str = rules.JOB_SUCCESS, failures: Sequence[str] = rules.JOB_FAILURES,
) -> DataFrame:
    """One row per job: started_at, outcome, finished_at, status (batch).

    The first terminal status within the limit decides; without one the job is
    stalled. One aggregation with map-side combine.
    """
    terminal = F.col("status").isin(success, *failures)
    first = F.min(F.when(terminal, F.struct(F.col(ts).alias("ts"), F.col(tie).alias("tie"), F.col("status"))))
    jobs = timeline.groupBy(key).agg(F.min(ts).alias("started_at"), first.alias("t"))
    spent = F.unix_micros(F.col("t.ts").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    in_time = F.coalesce(spent < limit_minutes * 60_000_000, F.lit(False))
    outcome = F.when(~in_time, "stalled").when(F.col("t.status") == success, "success").otherwise("failure")
    return jobs.select(
        key, "started_at", outcome.alias("outcome"),
        F.when(in_time, F.col("t.ts")).alias("finished_at"), F.when(in_time, F.col("t.status")).alias("status"),
    )


OUTCOME_SCHEMA = "job_id STRING, started_us BIGINT, outcome STRING, finished_us BIGINT, status STRING"
FORGET_MINUTES = 30 * 24 * 60


def outcome_stream(
    timeline: DataFrame, limit_minutes: int = rules.JOB_LIMIT_MINUTES, delay: str = "10 minutes",
    success: str = rules.JOB_SUCCESS, failures: Sequence[str] = rules.JOB_FAILURES, forget_minutes: int = FORGET_MINUTES,
) -> DataFrame:
    """Streaming twin of outcomes, also for rows that come late; emits each job once.

    timeline: job_id (string), ts, event_id, status. A job is decided when the
    watermark has passed its first terminal status or its limit, so no earlier
    row can come. State is one small row per job; it goes when a decided job
    was silent for forget_minutes (a row that comes later starts the job anew).
    Needs the RocksDB state store.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    limit, forget = limit_minutes * 60_000_000, forget_minutes * 60_000_000
    columns = ["job_id", "started_us", "outcome", "finished_us", "status"]
    terminal = (success, *failures)

    class JobState(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.job = handle.getValueState("job", "started BIGINT, at BIGINT, tie BIGINT, status STRING, done BOOLEAN, last BIGINT")

        def wait(self, job) -> None:
            """Timer for the next thing that may happen to the job."""
            started, at, _, _, done, last = job
            next_ = last + forget if done else min(started + limit, started + limit if at is None else at)
            self.handle.registerTimer(next_ // 1000 + 1)

        def handleInputRows(self, key, rows, timerValues) -> Iterator:
            # plain values: a frame's sort and filter cost a job of some rows a millisecond each
            seen, ends = [], []
            for pdf in rows:
                at = pdf["us"].tolist()
                seen += [us for us in at if us == us]  # without nulls
                ends += [e for e in zip(at, pdf["event_id"].tolist(), pdf["status"].tolist(), strict=True) if e[2] in terminal]
            started, last = int(min(seen)), int(max(seen))
            end = None
            if ends:
                us, id_, status = min(ends, key=lambda e: (e[0] != e[0], e[0], e[1] != e[1], e[1]))  # nulls last
                end = (int(us), int(id_), status)
            if self.job.exists():
                held = self.job.get()
                started, last = min(started, held[0]), max(last, held[5])
                if held[4]:
                    started, end = held[0], tuple(held[1:4])
                elif held[1] is not None:
                    end = min(end, tuple(held[1:4])) if end else tuple(held[1:4])
                done = held[4]
            else:
                done = False
            job = (started, *(end or (None, None, None)), done, last)
            self.job.update(job)
            self.wait(job)
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
            import pandas as pd

            out = []
            if self.job.exists():
                started, at, tie, status, done, last = self.job.get()
                passed = timerValues.getCurrentWatermarkInMs() * 1000
                if done and last + forget <= passed:
                    self.job.clear()
                elif not done:
                    in_time = at is not None and at - started < limit
                    if in_time and at <= passed:
                        out.append((key[0], started, "success" if status == success else "failure", at, status))
                    elif not in_time and started + limit <= passed:
                        out.append((key[0], started, "stalled", None, None))
                    if out and last + forget <= passed:
                        self.job.clear()
                    else:
                        job = (started, at, tie, status, bool(out), last)
                        self.job.update(job)
                        self.wait(job)
            if out:
                yield pd.DataFrame(out, columns=columns).astype({"started_us": "Int64", "finished_us": "Int64"})

        def close(self) -> None:
            pass

    rows = timeline.withWatermark("ts", delay).select("job_id", "ts", F.col("event_id").cast("bigint").alias("event_id"), "status", F.unix_micros("ts").alias("us"))
    found = rows.groupBy("job_id").transformWithStateInPandas(JobState(), OUTCOME_SCHEMA, "Append", "EventTime")
    return found.select(
        "job_id", F.timestamp_micros("started_us").alias("started_at"), "outcome", F.timestamp_micros("finished_us").alias("finished_at"), "status"
    )
