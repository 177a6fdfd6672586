"""Structured Streaming forms: windows with a watermark, sessions, and the stage tracker as keyed state with timers; rows may
come out of order by as much as the watermark allows, and the end of an input closes what is open."""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole events table, with the columns of event_stream; watermarks do nothing on it."""
    rows = spark.read.schema(EVENTS).parquet(f"{sf_dir}/events*.parquet")
    return rows.withColumn("at", F.col("ts").cast("timestamp"))


def event_stream(spark: SparkSession, sf_dir: str, files_at_once: int = 64) -> DataFrame:
    """The events table as a file stream, with an event time that watermarks take."""
    return _stream(spark, f"{sf_dir}/events*.parquet", files_at_once)


def _stream(spark: SparkSession, path: str, files_at_once: int) -> DataFrame:
    rows = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_at_once).parquet(path)
    return rows.withColumn("at", F.col("ts").cast("timestamp"))


def backwards(spark: SparkSession, sf_dir: str, path: str, slices: int = 4) -> tuple[DataFrame, str]:
    """The events table written under path as ``slices`` ranges of time, the latest first, and read as a stream of a slice a
    micro-batch: rows come as far out of order as they can. Also how late the latest of them are, for watermarks."""
    rows = event_table(spark, sf_dir)
    first, last, n = rows.agg(F.unix_micros(F.min("at")), F.unix_micros(F.max("at")), F.count("*")).first()
    first, last = first or 0, last or 0
    files = rows.rdd.getNumPartitions()
    width = (last - first) // slices + 1
    for k in reversed(range(slices)):
        inside = F.floor((F.unix_micros("at") - first) / width) == k
        rows.where(inside if k else F.coalesce(inside, F.lit(True))).select(*[c.split()[0] for c in EVENTS.split(", ")]).repartition(files).write.mode("append").parquet(path)
    return _stream(spark, path, files), f"{(last - first) // 1_000_000 + 1} seconds"


def tumbling(events: DataFrame, length: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Counts and sums of windows by type; on a stream, rows later than the watermark are dropped."""
    w = F.window("at", length)
    return events.withWatermark("at", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of a user's events without a pause."""
    w = F.session_window("at", gap)
    return events.withWatermark("at", late).groupBy(w, "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def track(current: str | None, stages: dict[str, list], stage: str, progress: float, failed: bool = False) -> str | None:
    """One update of a run's stages (name: [status, progress]), in the order they started; gives the stage that now runs.
    A failing update marks a stage that has started."""
    own = stages.get(stage)
    if failed:
        if own is not None:
            own[0] = "failed"
        return current
    if own is None:
        if current is not None and stages[current][0] == "in_progress":
            stages[current] = ["completed", 100.0]
        stages[stage] = ["in_progress", 0.0]
        return stage
    own[1] = min(100.0, max(0.0, progress))
    if progress >= 100:
        own[0] = "completed"
    return current


STAGE_STATE = "names array<string>, status array<string>, progress array<double>, current string, batch long, at array<long>, tie array<long>, stage array<string>, done array<double>"


def stage_tracker(updates: DataFrame, late: str = "1 hour") -> DataFrame:
    """Stage states of runs from updates in any order: run, at (event time), tie (orders updates of one time), stage, progress.

    Updates wait in the run's state until the watermark, ``late`` behind the newest one seen, has passed them; then they are
    applied by time. A timer on the oldest one that waits wakes a run that gets no more rows. Each time that updates are
    applied, the run's stages are given with ``batch``, the run's own count of these times. What comes later than the
    watermark is dropped; updates without a time are left out, and those without a run are one run, of null.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, status, progress, current, batch, *waiting = state.get if state.exists else ([], [], [], None, -1, [], [], [], [])
        rows = list(zip(*waiting, strict=True))
        if not state.hasTimedOut:
            for f in frames:
                rows += zip(f["seq"].tolist(), f["tie"].tolist(), f["stage"].tolist(), f["progress"].tolist(), strict=True)
        rows.sort(key=lambda r: r[:2])
        passed = state.getCurrentWatermarkMs() * 1000
        due = bisect.bisect_right(rows, passed, key=lambda r: r[0])
        stages = {n: [s, p] for n, s, p in zip(names, status, progress, strict=True)}
        for _, _, stage, done in rows[:due]:
            current = track(current, stages, stage, done)
        rest, batch = rows[due:], batch + (due > 0)
        columns = [list(c) for c in zip(*rest, strict=True)] if rest else [[], [], [], []]
        state.update((list(stages), [v[0] for v in stages.values()], [v[1] for v in stages.values()], current, batch, *columns))
        if rest:
            state.setTimeoutTimestamp(max(rest[0][0] // 1000 + 1, passed // 1000 + 1))
        if due:
            yield pd.DataFrame({"run": key[0], "batch": batch, "stage": list(stages), "status": [v[0] for v in stages.values()], "progress": [v[1] for v in stages.values()]})

    # no other filter: it would go under the watermark and take away the row that ends an input
    timed = updates.withWatermark("at", late).where("at IS NOT NULL").select("run", "at", F.unix_micros("at").alias("seq"), F.coalesce("tie", F.lit(0).cast("long")).alias("tie"), "stage", F.coalesce("progress", F.lit(0.0)).alias("progress"))
    return timed.groupBy("run").applyInPandasWithState(step, "run long, batch long, stage string, status string, progress double", STAGE_STATE, "append", GroupStateTimeout.EventTimeTimeout)


#: Event time of the row that ends an input; no other row is as late (about the last that pandas can hold).
END = "2261-01-01 00:00:00"


def run_to_end(events: DataFrame, build: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """All that a stream gives when its input, as it is now, has ended: what the watermark has not reached is flushed too.

    events: a stream with an event time ``at``; build: makes the windows, sessions or states of it, in append mode. Beside the
    stream an empty folder is read. When all is read, one row is put there, with ``END`` as its time and nulls else; it moves
    the watermark behind every other row, and the same query, begun again where it stopped, closes all windows and timers. Its
    own window stays open and is never given. A query that is broken off goes on from its checkpoint when called again with
    the same path."""
    spark = events.sparkSession
    ends = f"{path}/ends"
    spark.createDataFrame([], events.schema).coalesce(1).write.mode("ignore").parquet(ends)
    both = events.unionByName(spark.readStream.schema(events.schema).parquet(ends))
    out = build(both)

    def run() -> None:
        out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/_state").trigger(availableNow=True).start(f"{path}/rows").awaitTermination()

    run()
    if spark.read.schema(events.schema).parquet(ends).isEmpty():
        nulls = [F.lit(END).cast("timestamp").alias(c) if c == "at" else F.lit(None).cast(t).alias(c) for c, t in events.dtypes]
        spark.range(1).select(*nulls).write.mode("append").parquet(ends)
    run()
    return spark.read.schema(out.schema).parquet(f"{path}/rows")


def run_once(df: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """All that is there now, written to a table under path and read back; windows that the watermark has not passed stay out."""
    query = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}/_state").trigger(availableNow=True).start(f"{path}/rows")
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")


def on_progress(df: DataFrame, path: str, tell: Callable[[int, int], None]) -> None:
    """Runs a stream over what is there now and tells the number and rows of each micro-batch as it ends; the rows go to a
    table under path, a folder for each batch, so a batch that is repeated replaces its own."""

    def batch(rows: DataFrame, k: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={k}")
        tell(k, rows.sparkSession.read.parquet(f"{path}/rows/batch={k}").count())

    df.writeStream.foreachBatch(batch).option("checkpointLocation", f"{path}/_state").trigger(availableNow=True).start().awaitTermination()
