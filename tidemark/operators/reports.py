"""Text reports as rows (video_id, at, line): numbered lines of each video's report, in order of ``at``.

A report has a head, a body with some lines an item, and a foot. Items are few (a report is read by people), but there may
be any number of videos; lines are made by row, and only a video's statistics are aggregated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.intervals import rounded
from tidemark.functions.text import mm_ss

RULE, DASHES = "=" * 70, "-" * 60
#: Symbols of check results.
SYMBOLS = {"pass": "✓", "fail": "✗", "warn": "⚠", "info": "ℹ"}


def _signed(x: Column) -> Column:
    return F.format_string("%+.1f", x)


def _lines(rows: DataFrame, section: int, order: Column, lines: list[Column], *keys: str) -> DataFrame:
    """Lines of rows, one after another; null ones are left out."""
    picked = F.filter(F.transform(F.array(*lines), lambda x, i: F.struct(F.lit(section).alias("section"), order.cast("double").alias("item"), i.alias("part"), x.alias("line"))), lambda s: s["line"].isNotNull())
    return rows.select("video_id", F.explode(picked).alias("l")).select("video_id", "l.*")


def _numbered(*parts: DataFrame) -> DataFrame:
    rows = reduce(DataFrame.unionByName, parts)
    order = Window.partitionBy("video_id").orderBy("section", "item", "part")
    return rows.select("video_id", F.row_number().over(order).cast("long").alias("at"), "line")


def scene_report(cuts: DataFrame, threshold: float = 0.4, least: float = 2.0, timed: bool = False) -> DataFrame:
    """Scene changes of each video; ``timed`` also says how long each scene lasts. cuts: video_id, n (from 1), time, score,
    next_time."""
    text = lambda s: F.lit(s)
    total = cuts.groupBy("video_id").agg(F.count("*").alias("total"))
    head = [text(RULE), text("Scene Detection Report"), text(RULE), F.concat(text("Video: "), F.col("video_id").cast("string")), text(f"Threshold: {threshold}"), text(f"Min scene duration: {least}s"), F.format_string("Total scenes detected: %d", "total"), text("")]
    clock = F.format_string("%02d:%05.2f", F.floor(F.col("time") / 60).cast("int"), F.col("time") - F.floor(F.col("time") / 60) * 60)
    lasts = F.when(F.col("next_time").isNotNull(), F.format_string("%3ds", (F.col("next_time") - F.col("time")).cast("int"))).otherwise("End ")
    body = F.format_string("Scene %3d: %s - %s (score: %.3f)", "n", clock, lasts, "score") if timed else F.format_string("  %3d. %s", "n", mm_ss(F.col("time")))
    return _numbered(_lines(total, 0, F.lit(0), head), _lines(cuts, 1, F.col("n"), [body]), _lines(total, 2, F.lit(0), [text(RULE)]))


def alignment_report(aligned: DataFrame, top: int = 10) -> DataFrame:
    """What alignment did to the first clips of each video, and a summary of all. aligned: video_id, n (from 1), title and
    the columns of talk.align."""
    text = lambda s: F.lit(s)
    span = lambda a, b: F.concat(mm_ss(F.col(a)), text(" → "), mm_ss(F.col(b)), F.format_string(" (%.1fs)", F.col(b) - F.col(a)))
    moved = (F.col("start_adjustment") != 0) | (F.col("end_adjustment") != 0)
    kinds = F.array_join(F.array_compact(F.array(F.concat(text("start="), F.col("start_boundary_type")), F.concat(text("end="), F.col("end_boundary_type")))), ", ")
    lines = [
        F.format_string("Clip %d: %s", "n", F.substring("title", 1, 60)),
        F.concat(text("  Original:  "), span("original_start", "original_end")),
        F.concat(text("  Aligned:   "), span("start", "end")),
        F.when(moved, F.concat(text("  Adjustment: Start "), _signed(F.col("start_adjustment")), text("s, End "), _signed(F.col("end_adjustment")), text("s"))).otherwise("  Adjustment: None (already aligned)"),
        F.when(kinds != "", F.concat(text("  Boundaries: "), kinds)),
        F.when(F.col("professionally_aligned"), "  Quality:    ✓ Sentence aligned").otherwise("  Quality:    ⚠ No boundaries nearby"),
        text(""),
    ]
    n = aligned.groupBy("video_id").agg(F.count("*").alias("total"), F.count_if("professionally_aligned").alias("good"), F.avg(F.abs("start_adjustment")).alias("a"), F.avg(F.abs("end_adjustment")).alias("b"))
    foot = [text(RULE), text("Summary:"), F.format_string("  Total clips:          %d", "total"), F.format_string("  Professionally aligned: %d (%.0f%%)", "good", F.col("good") / F.col("total") * 100), F.format_string("  Avg start adjustment: %.2fs", "a"), F.format_string("  Avg end adjustment:   %.2fs", "b"), text(RULE)]
    head = [text(RULE), text("Professional Editing Report"), text(RULE), text("")]
    return _numbered(_lines(n, 0, F.lit(0), head), _lines(aligned.where(F.col("n") <= top), 1, F.col("n"), lines), _lines(n, 2, F.lit(0), foot))


def summary_report(clips: DataFrame) -> DataFrame:
    """All clips of each video with length, score and file. clips: video_id, n, title, duration, combined, file."""
    text = lambda s: F.lit(s)
    total = clips.groupBy("video_id").agg(F.count("*").alias("total"))
    head = [text("=" * 60), text("PROCESSING SUMMARY"), text("=" * 60), text(""), F.format_string("Total Clips Generated: %d", "total"), text("")]
    lines = [F.format_string("%d. %s", "n", F.coalesce("title", text("Untitled"))), F.format_string("   Duration: %.1fs", "duration"), F.format_string("   Score: %.2f", "combined"), F.concat(text("   Files: "), F.coalesce("file", text("N/A"))), text("")]
    return _numbered(_lines(total, 0, F.lit(0), head), _lines(clips, 1, F.col("n"), lines))


def hybrid_report(clips: DataFrame, stats: DataFrame, top: int = 10) -> DataFrame:
    """Statistics and the best clips of each video. clips: video_id, rank, title, start, end, interest_score and the columns
    of scoring.hybrid; stats: the columns of scoring.hybrid_stats."""
    text = lambda s: F.lit(s)
    head = [
        text(RULE), text("HYBRID ANALYSIS SUMMARY"), text(RULE), text(""), text("Analysis Stats:"),
        F.format_string("   AI Content Clips:      %d", "total_ai_clips"), F.format_string("   Energy Segments:       %d", "total_energy_segments"), F.format_string("   Clips with High Energy: %d/%d", "clips_with_high_energy", "total_hybrid_clips"), F.format_string("   Clips with Energy Boost: %d/%d", "clips_with_energy_boost", "total_hybrid_clips"),
        text(""), text("Score Improvements:"), F.format_string("   Avg AI Score:          %.3f", "avg_ai_score"), F.format_string("   Avg Hybrid Score:      %.3f", "avg_hybrid_score"), F.format_string("   Avg Energy Boost:      %.3f", "avg_energy_boost"), F.format_string("   Max Hybrid Score:      %.3f", "max_hybrid_score"),
        F.format_string("   Ranking Changes:       %d clips", "ranking_changes"), text(""), text(RULE), F.format_string("TOP %d CLIPS (Hybrid Ranked)", "shown"), text(RULE), text(""),
    ]
    gain = (F.col("hybrid_score") - F.col("interest_score")) / F.col("interest_score") * 100
    lines = [
        F.concat(F.when(F.col("has_high_energy"), "⚡").otherwise("  "), F.format_string(" #%d - %s", "rank", F.substring("title", 1, 55))),
        F.concat(text("      Time: "), mm_ss(F.col("start")), text(" → "), mm_ss(F.col("end")), F.format_string(" (%.0fs)", F.col("end") - F.col("start"))),
        F.format_string("      AI Score:     %.3f", rounded(F.col("interest_score"), 3)),
        F.format_string("      Hybrid Score: %.3f (+%.1f%%)", rounded(F.col("hybrid_score"), 3), rounded(gain, 1)),
        F.when(F.col("overlapping_segments") > 0, F.format_string("      Energy: %.3f peak, %.1f%% overlap, %d segments", rounded(F.col("max_energy"), 3), rounded(F.col("overlap_ratio") * 100, 1), F.col("overlapping_segments"))).otherwise("      Energy: No high-energy overlap"),
        text(""),
    ]
    shown = clips.groupBy("video_id").agg(F.count("*").alias("shown"))
    return _numbered(_lines(stats.join(shown, "video_id"), 0, F.lit(0), head), _lines(clips.where(F.col("rank") <= top), 1, F.col("rank"), lines))


def diagnostics_report(checks: DataFrame) -> DataFrame:
    """Checks by category with their symbols. checks: video_id (the run), category, n, name, status, message, solution."""
    text = lambda s: F.lit(s)
    symbol = F.try_element_at(F.create_map(*[F.lit(v) for kv in SYMBOLS.items() for v in kv]), F.col("status"))
    first = checks.groupBy("video_id", "category").agg(F.min("n").alias("first"), F.max("n").alias("last"))
    runs = checks.select("video_id").distinct()
    lines = [F.concat(symbol, text(" "), F.col("name"), text(": "), F.col("message")), F.concat(text("  Solution: "), F.col("solution"))]
    return _numbered(
        _lines(runs, 0, F.lit(0), [text("DIAGNOSTICS REPORT"), text("=" * 60), text("")]),
        _lines(first, 1, F.col("first") - 0.5, [F.col("category"), text(DASHES)]),
        _lines(checks, 1, F.col("n"), lines),
        _lines(first, 1, F.col("last") + 0.25, [text("")]),
    )


def write_reports(lines: DataFrame, path: str) -> None:
    """One text row a video, its lines joined."""
    rows = F.array_sort(F.collect_list(F.struct("at", "line")))
    lines.groupBy("video_id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("value")).select("value").write.mode("overwrite").text(path, lineSep="\n\f\n")
