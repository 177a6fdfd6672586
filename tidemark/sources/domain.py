"""Interval tables derived from the shared test tables: segments, frames, clips, energy segments and scene cuts.

Times are doubles in the video's own unit; segment times are kept in whole milliseconds until the end, so that no running
sum of fractions decides a comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, seg_id, start, end, text: the non-blank lines of each document, timed by their length."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id"), F.posexplode(F.split("text", "\n")).alias("seg_id", "text"))
    timed = lines.where(F.trim("text") != "").select("video_id", F.col("seg_id").cast("long").alias("seg_id"), "text", F.expr("length(trim(text)) * 1000 div 15").alias("dur"), F.expr("((video_id * 31 + seg_id * 7) % 10) * 100 + 50").alias("gap"))
    before = Window.partitionBy("video_id").orderBy("seg_id").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("dur") + F.col("gap")).over(before), F.lit(0))
    return timed.withColumn("ms", start).select("video_id", "seg_id", (F.col("ms") / 1000.0).alias("start"), ((F.col("ms") + F.col("dur")) / 1000.0).alias("end"), "text")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, frame, t (hours), value, event_id, event_type; energy is value normalised within its video."""
    e = table(spark, sf_dir, "events")
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)") / F.lit(3600000000.0)
    rows = e.select(F.col("user_id").alias("video_id"), "event_id", "event_type", "value", t.alias("t"))
    order = Window.partitionBy("video_id").orderBy("t", "event_id")
    whole = Window.partitionBy("video_id")
    low, high = F.min("value").over(whole), F.max("value").over(whole)
    energy = F.when(high - low < 1e-10, 0.0).otherwise((F.col("value") - low) / (high - low))
    return rows.withColumn("frame", (F.row_number().over(order) - 1).cast("long")).withColumn("energy", energy)


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, id, start, end, interest_score: candidate clips of 12 hours either side of a purchase."""
    f = frames(spark, sf_dir).where("event_type = 'purchase'")
    return f.select("video_id", F.col("event_id").alias("id"), (F.col("t") - 12).alias("start"), (F.col("t") + 12).alias("end"), ((F.col("event_id") % 11 * 5 + 40) / 100.0).alias("interest_score"))


def energy_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, seg, start, end, energy_score: 6 hours either side of other events of energy 0.5 or more."""
    f = frames(spark, sf_dir).where("event_type <> 'purchase' AND energy >= 0.5")
    return f.select("video_id", F.col("event_id").alias("seg"), (F.col("t") - 6).alias("start"), (F.col("t") + 6).alias("end"), F.col("energy").alias("energy_score"))


def cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, cut, time: scene cuts."""
    return frames(spark, sf_dir).where("event_type = 'error'").select("video_id", F.col("event_id").alias("cut"), F.col("t").alias("time"))


def talk_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips over segments: one for each, from 1.3 s after its start, of 12 to 51 s."""
    s = segments(spark, sf_dir)
    return s.select("video_id", F.col("seg_id").alias("id"), (F.col("start") + 1.3).alias("start"), (F.col("start") + 1.3 + 12 + F.col("seg_id") % 14 * 3).alias("end"))


#: The same tables in SQL, as common table expressions.
SQL = """
segments AS (SELECT video_id, seg_id, ms / 1000.0::DOUBLE AS start, (ms + dur) / 1000.0::DOUBLE AS "end", text FROM (
    SELECT *, coalesce(sum(dur + gap) OVER (PARTITION BY video_id ORDER BY seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ms FROM (
        SELECT doc_id AS video_id, i AS seg_id, line AS text, length(trim(line)) * 1000 // 15 AS dur, ((doc_id * 31 + i * 7) % 10) * 100 + 50 AS gap
        FROM (SELECT doc_id, unnest(range(0, len(lines))) AS i, unnest(lines) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)) WHERE trim(line) <> ''))),
frames AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY t, event_id) - 1 AS frame,
    CASE WHEN max(value) OVER v - min(value) OVER v < 1e-10 THEN 0.0::DOUBLE ELSE (value - min(value) OVER v) / (max(value) OVER v - min(value) OVER v) END AS energy
    FROM (SELECT user_id AS video_id, event_id, event_type, value, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3600000000.0::DOUBLE AS t FROM events) WINDOW v AS (PARTITION BY video_id)),
clips AS (SELECT video_id, event_id AS id, t - 12 AS start, t + 12 AS "end", (event_id % 11 * 5 + 40) / 100.0::DOUBLE AS interest_score FROM frames WHERE event_type = 'purchase'),
energy_segments AS (SELECT video_id, event_id AS seg, t - 6 AS start, t + 6 AS "end", energy AS energy_score FROM frames WHERE event_type <> 'purchase' AND energy >= 0.5),
cuts AS (SELECT video_id, event_id AS cut, t AS time FROM frames WHERE event_type = 'error'),
talk_clips AS (SELECT video_id, seg_id AS id, start + 1.3::DOUBLE AS start, start + 1.3::DOUBLE + 12 + seg_id % 14 * 3 AS "end" FROM segments)
"""
