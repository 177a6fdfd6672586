"""Hybrid and multi-signal scores, rankings and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.intervals import hybrid_score, ratio_of_first, rounded, weighted
from tidemark.operators.joins import overlap_join

BIN = 24.0


def overlap_pairs(clips: DataFrame, energy: DataFrame, least: float = 0.1, width: float = BIN) -> DataFrame:
    """video_id, id, seg, energy_score, overlap_ratio (of the clip's length) above ``least``."""
    right = energy.select("video_id", "seg", F.col("start").alias("r_start"), F.col("end").alias("r_end"), "energy_score")
    pairs = overlap_join(clips, right, width).withColumn("overlap_ratio", ratio_of_first(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end")))
    return pairs.where(F.col("overlap_ratio") > least).select("video_id", "id", "seg", "energy_score", "overlap_ratio")


def hybrid(clips: DataFrame, energy: DataFrame, weight: float = 0.3) -> DataFrame:
    """clips with the energy boost of their overlapping segments and the hybrid score."""
    sums = overlap_pairs(clips, energy).groupBy("video_id", "id").agg(F.max("energy_score").alias("max_energy"), F.avg("energy_score").alias("avg_energy"), F.sum("overlap_ratio").alias("overlap_ratio"), F.count("*").alias("overlapping_segments"))
    out = clips.join(sums, ["video_id", "id"], "left").na.fill({"max_energy": 0.0, "avg_energy": 0.0, "overlap_ratio": 0.0, "overlapping_segments": 0})
    boost = 0.5 * F.col("max_energy") + 0.3 * F.col("avg_energy") + 0.2 * F.least("overlap_ratio", F.lit(1.0))
    out = out.withColumn("energy_boost", F.when(F.col("overlapping_segments") > 0, boost).otherwise(0.0))
    return out.withColumn("hybrid_score", hybrid_score(F.col("interest_score"), F.col("energy_boost"), weight)).withColumn("has_high_energy", F.col("energy_boost") > 0.5)


def top(df: DataFrame, score: str, n: int, key: str = "video_id", tie: str = "id") -> DataFrame:
    """The n best rows of each video with their rank; ties in input order."""
    order = Window.partitionBy(key).orderBy(F.col(score).desc(), F.col(tie))
    return df.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n)


def rank_changes(df: DataFrame, before: str = "interest_score", after: str = "hybrid_score", more_than: int = 2) -> DataFrame:
    """video_id, id, both ranks and whether they differ by more than ``more_than``."""
    rank = lambda c: F.row_number().over(Window.partitionBy("video_id").orderBy(F.col(c).desc(), "id")).cast("long")
    out = df.select("video_id", "id", rank(before).alias("ai_rank"), rank(after).alias("hybrid_rank"))
    return out.withColumn("changed", F.abs(F.col("ai_rank") - F.col("hybrid_rank")) > more_than)


def _mean(x: Column) -> Column:
    """Mean to three places, half-up, summed as decimals: the same in whatever order rows come. Values that no such decimal
    holds (infinities, NaN) are averaged as they are."""
    exact = F.round(F.avg(x.try_cast("decimal(38,18)")), 3).cast("double")
    return F.coalesce(F.when(F.max(F.abs(x)) < 1e9, exact).otherwise(F.round(F.avg(x), 3)), F.lit(0.0))


def hybrid_stats(scored: DataFrame, energy: DataFrame) -> DataFrame:
    """Counts, averages to three places and ranking changes of each video. scored: as hybrid gives them."""
    avg = lambda c: _mean(F.col(c) if isinstance(c, str) else c)
    boosted = F.col("energy_boost") > 0
    own = scored.groupBy("video_id").agg(
        F.count("*").alias("total_ai_clips"), F.count("*").alias("total_hybrid_clips"), F.count_if("has_high_energy").alias("clips_with_high_energy"), F.count_if(boosted).alias("clips_with_energy_boost"),
        avg("interest_score").alias("avg_ai_score"), avg("hybrid_score").alias("avg_hybrid_score"), avg(F.when(boosted, F.col("energy_boost"))).alias("avg_energy_boost"), F.coalesce(F.round(F.max("hybrid_score"), 3), F.lit(0.0)).alias("max_hybrid_score"),
    )
    segments = energy.groupBy("video_id").agg(F.count("*").alias("total_energy_segments"))
    changes = rank_changes(scored).groupBy("video_id").agg(F.count_if("changed").alias("ranking_changes"))
    out = own.join(segments, "video_id", "left").join(changes, "video_id", "left")
    return out.na.fill({"total_energy_segments": 0, "ranking_changes": 0})


def ranked_scores(df: DataFrame, score: str = "combined", tie: str = "id") -> DataFrame:
    """df with its score to two places and the rank by that rounded score, ties in input order."""
    out = df.withColumn(score, rounded(F.col(score), 2))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("video_id").orderBy(F.col(score).desc(), tie)).cast("long"))


def multi_signal(clips: DataFrame, energy: DataFrame, cuts: DataFrame, weights: tuple[float, float, float] = (0.5, 0.3, 0.2)) -> DataFrame:
    """clips with ai, audio and visual scores and their weighted sum; 0.5 where a video has no such signal at all."""
    right = energy.select("video_id", F.col("start").alias("r_start"), F.col("end").alias("r_end"), "energy_score")
    audio = overlap_join(clips.select("video_id", "id", "start", "end"), right, BIN).groupBy("video_id", "id").agg(F.avg("energy_score").alias("audio"))
    point = cuts.select("video_id", F.col("time").alias("r_start"), F.col("time").alias("r_end"))
    seen = overlap_join(clips.select("video_id", "id", "start", "end"), point, BIN, inclusive=True).groupBy("video_id", "id").agg(F.count("*").alias("n"))
    some = cuts.select("video_id", F.lit(True).alias("cut_video")).distinct()
    out = clips.join(audio, ["video_id", "id"], "left").join(seen, ["video_id", "id"], "left").join(some, "video_id", "left")
    n = F.coalesce("n", F.lit(0))
    visual = F.when(F.col("cut_video").isNull(), 0.5).when(n == 0, 0.3).when(n <= 2, 0.6).otherwise(0.9)
    out = out.withColumn("audio_score", F.coalesce("audio", F.lit(0.5))).withColumn("visual_score", visual).withColumn("ai_score", F.coalesce("interest_score", F.lit(0.5)))
    return out.withColumn("combined", weighted(list(weights), [F.col("ai_score"), F.col("audio_score"), F.col("visual_score")])).drop("audio", "n", "cut_video")
