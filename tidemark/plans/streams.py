"""Streams over the whole events table as it is now, in micro-batches out of order: windows, sessions and the stage tracker,
each run to the end of its input. Their SQL is that of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans import publishing
from tidemark.sources.shared import scratch
from tidemark.streaming import events


def _run(spark, sf: str, name: str, build) -> DataFrame:
    """A stream of four micro-batches, the latest quarter of time first, run to its end. build: of the stream and how late rows are."""
    path = scratch(spark, name)
    rows, late = events.backwards(spark, sf, f"{path}/input")
    return events.run_to_end(rows, lambda e: build(e, late), path)


def stream_windows(spark, sf: str) -> DataFrame:
    w = _run(spark, sf, "stream-windows", lambda e, late: events.tumbling(e, "1 day", late))
    return w.select(F.unix_seconds("start").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


def stream_sessions(spark, sf: str) -> DataFrame:
    s = _run(spark, sf, "stream-sessions", lambda e, late: events.sessions(e, "12 hours", late))
    return s.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


def stream_stages(spark, sf: str) -> DataFrame:
    """The last state of each stage that the stream gives (a run's states come each time that updates are applied)."""
    updates = lambda e: e.select(F.col("user_id").alias("run"), "at", F.col("event_id").alias("tie"), F.col("event_type").alias("stage"), F.col("value").alias("progress"))
    states = _run(spark, sf, "stream-stages", lambda e, late: events.stage_tracker(updates(e), late))
    latest = states.groupBy("run", "stage").agg(F.max_by(F.struct("status", "progress"), "batch").alias("s"))
    return latest.select("run", "stage", "s.status", F.round("s.progress", 6).alias("progress"))


QUERIES = {f.__name__: f for f in (stream_windows, stream_sessions, stream_stages)}
ORACLE = {
    "stream_windows": "SELECT epoch(date_trunc('day', ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL",
    "stream_sessions": """SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts) + INTERVAL 12 HOUR) AS "end", count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (
        SELECT *, coalesce((ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 12 HOUR)::INT, 0) AS new FROM events)) GROUP BY user_id, k""",
    "stream_stages": publishing.ORACLE["stage_state"],
}
