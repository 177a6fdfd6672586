"""Whole runs: analysis, alignment and rendering plans of every video at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import title as as_title
from tidemark.functions.text import unquote
from tidemark.operators import folds, model, platforms, scoring, talk
from tidemark.operators.editorial import Scorer
from tidemark.sources.shared import materialize


def align_all(clips: DataFrame, segments: DataFrame, cuts: DataFrame | None = None, least: float | None = None, most: float | None = None, retitle: Scorer | None = None, bounds: DataFrame | None = None) -> DataFrame:
    """talk.align with flags and titles: ``on_cut`` where the boundary that a clip's start was moved to has a scene cut less
    than a second away (cuts: video_id, cut, cut_time); with a scorer ``retitle`` an aligned clip's title is made of its new
    text, without quotes around it and cut, and the old one kept beside (it stays where there is no text or no answer)."""
    bounds = talk.boundaries(segments) if bounds is None else bounds
    a = talk.align(clips, bounds, least_length=least, most_length=most)
    if cuts is None:
        a = a.withColumn("on_cut", F.lit(False))
    else:
        flags = talk.double_boundaries(bounds, cuts).where("double_boundary").select(F.col("video_id").alias("_v"), F.col("time").alias("_t"), F.lit(True).alias("_d"))
        a = a.join(flags, (F.col("video_id") == F.col("_v")) & (F.col("start") == F.col("_t")), "left").withColumn("on_cut", F.coalesce("_d", F.lit(False))).drop("_v", "_t", "_d")
    if retitle is None:
        return a
    a = materialize(a, "aligned-clips")  # read three times below; working it out each time costs its shuffles each time
    moved = a.where("professionally_aligned").select("video_id", "id", "start", "end")
    asked = talk.text_in(moved, segments).where("text <> ''").withColumnRenamed("text", "prompt")
    said = retitle(asked).select("video_id", "id", unquote(F.trim("response")).alias("_said")).where("_said <> ''").select("video_id", "id", as_title(F.col("_said")).alias("_said"))  # cut before the join: an answer may be as long as its text
    a = a.join(said, ["video_id", "id"], "left").withColumn("original_title", F.col("title"))
    return a.withColumn("title", F.coalesce("_said", "title")).drop("_said")


def analysed(segments: DataFrame, energy: DataFrame, n: int, ask: Scorer, least: float | None, most: float | None, budget: int, weight: float = 0.3) -> DataFrame:
    """The 2n best clips of each video by hybrid score, out of twice as many that the model was asked for."""
    wanted = n * model.OVER_RUN
    found = model.detect_clips(segments, ask, wanted * model.OVER_ANALYSIS, least, most, budget)
    scored = scoring.hybrid(found.withColumnRenamed("rank", "found"), energy, weight)
    return scoring.top(scored, "hybrid_score", wanted, tie="found")


def full_run(segments: DataFrame, energy: DataFrame, cuts: DataFrame | None, seconds: DataFrame, n: int, sizes: Column, ask: Scorer | None = None, least: float | None = None, most: float | None = None, budget: int = model.MOST_TOKENS, bounds: DataFrame | None = None, retitle: Scorer | None = None, **how) -> tuple[DataFrame, DataFrame]:
    """Analysis, alignment, the first n (by the rank before alignment), rendering plan and metadata.

    What the model found, and the aligned clips, are written once. Returns the render results and the metadata of those that could be cut. seconds: video_id, video_seconds.
    """
    best = materialize(analysed(segments, energy, n, ask or model.stand_in("clips"), least, most, budget), "analysed")
    aligned = align_all(best, segments, cuts, least, most, retitle or model.stand_in("title"), bounds).where(F.col("rank") <= n)
    clips = materialize(aligned, "aligned").withColumn("index", F.col("rank").cast("int")).join(seconds, "video_id").withColumn("input", F.concat(F.lit("video_"), F.col("video_id").cast("string"), F.lit(".mp4")))
    results = platforms.render(clips, sizes, **how)
    return results, platforms.clip_metadata(clips, results)


def scored_run(segments: DataFrame, energy: DataFrame, cuts: DataFrame, n: int, ask: Scorer | None = None, least: float = 30.0, most: float = 90.0, budget: int = model.MOST_TOKENS, weights: tuple[float, float, float] = (1.0, 0.0, 0.0)) -> DataFrame:
    """The older run: model clips, weighted scores to two places, clips of the right length that do not overlap, and the
    names of their files."""
    found = materialize(model.detect_clips(segments, ask or model.stand_in("clips"), n, least, most, budget), "detected").withColumnRenamed("rank", "found")
    scored = scoring.multi_signal(found, energy, cuts, weights)
    ranked = scoring.ranked_scores(scored, "combined", "found")
    fit = ranked.where((F.col("end") - F.col("start")).between(least, most)).withColumn("name", F.col("id")).withColumn("id", F.col("rank"))
    kept = scoring.top(folds.suppress(fit, 0.3, "combined").drop("rank"), "combined", n)
    file = lambda kind: F.concat(F.lit("clips/clip_"), F.col("name"), F.lit(f"_{kind}"))
    return kept.select("video_id", "rank", F.col("name").alias("id"), "start", "end", "title", "combined", F.struct(file("raw.mp4").alias("raw"), file("subtitled.mp4").alias("subtitled"), file("thumbnail.jpg").alias("thumbnail")).alias("files"))
