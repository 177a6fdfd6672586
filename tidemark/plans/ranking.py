"""Queries: hybrid ranking, scores, statistics, de-duplication, scene cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import folds, joins, scoring
from tidemark.sources import domain as d


def _hybrid(spark, sf):
    return scoring.hybrid(d.clips(spark, sf), d.energy_segments(spark, sf))


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


def hybrid_topk(spark, sf: str) -> DataFrame:
    best = scoring.top(_hybrid(spark, sf), "hybrid_score", 5)
    return best.select("video_id", "id", "rank", *r6("hybrid_score", "energy_boost", "max_energy", "avg_energy", "overlap_ratio"), "overlapping_segments", "has_high_energy")


def hybrid_stats(spark, sf: str) -> DataFrame:
    h = _hybrid(spark, sf)
    avg = lambda c: F.coalesce(F.round(F.avg(c), 3), F.lit(0.0))
    return h.agg(
        F.count("*").alias("total_clips"), F.count_if("has_high_energy").alias("clips_with_high_energy"), F.count_if(F.col("energy_boost") > 0).alias("clips_with_energy_boost"),
        avg("interest_score").alias("avg_ai_score"), avg("hybrid_score").alias("avg_hybrid_score"), avg(F.when(F.col("energy_boost") > 0, F.col("energy_boost"))).alias("avg_energy_boost"),
        F.coalesce(F.round(F.max("hybrid_score"), 3), F.lit(0.0)).alias("max_hybrid_score"),
    )


def rank_changes(spark, sf: str) -> DataFrame:
    return scoring.rank_changes(_hybrid(spark, sf))


def overlap_pairs(spark, sf: str) -> DataFrame:
    return scoring.overlap_pairs(d.clips(spark, sf), d.energy_segments(spark, sf)).select("video_id", "id", "seg", *r6("energy_score", "overlap_ratio"))


def multi_signal_score(spark, sf: str) -> DataFrame:
    m = scoring.multi_signal(d.clips(spark, sf), d.energy_segments(spark, sf), d.cuts(spark, sf))
    return m.select("video_id", "id", *r6("ai_score", "audio_score", "visual_score", "combined"))


def _scored(spark, sf):
    """Clips of differing lengths with a score."""
    c = d.clips(spark, sf)
    return c.select("video_id", "id", "start", (F.col("start") + 20 + F.col("id") % 7 * 12).alias("end"), F.col("interest_score").alias("score"))


def select_top_clips(spark, sf: str) -> DataFrame:
    fit = _scored(spark, sf).where((F.col("end") - F.col("start")).between(30, 90))
    return scoring.top(folds.suppress(fit, 0.3), "score", 3).select("video_id", "id", "rank", *r6("start", "end", "score"))


def _merged(spark, sf, threshold):
    c = _scored(spark, sf).withColumnRenamed("score", "interest_score")
    kept = scoring.top(folds.merge_duplicates(c, threshold), "interest_score", 1 << 30)
    return kept.select("video_id", "id", F.format_string("clip_%03d", "rank").alias("clip"), *r6("start", "end", "interest_score"))


def clip_merge_dedup_07(spark, sf: str) -> DataFrame:
    return _merged(spark, sf, 0.7)


def moment_merge_dedup_05(spark, sf: str) -> DataFrame:
    return _merged(spark, sf, 0.5)


def min_gap_cuts(spark, sf: str) -> DataFrame:
    return folds.minimum_gap(d.cuts(spark, sf), 48.0).select("video_id", "cut", *r6("time"))


def scene_stats(spark, sf: str) -> DataFrame:
    gap = F.lead("time").over(Window.partitionBy("video_id").orderBy("time", "cut")) - F.col("time")
    c = d.cuts(spark, sf).withColumn("gap", gap)
    return c.groupBy("video_id").agg(F.count("*").alias("scene_count"), F.round(F.coalesce(F.avg("gap"), F.lit(0.0)), 6).alias("avg_scene_duration"))


def cuts_in_range(spark, sf: str) -> DataFrame:
    return d.cuts(spark, sf).where(F.col("time").between(100, 300)).select("video_id", "cut", *r6("time"))


def nearest_cut(spark, sf: str) -> DataFrame:
    """The scene cut nearest to each clip's start within 24; of two as near, the earlier."""
    c = d.clips(spark, sf)
    before = joins.asof(c, d.cuts(spark, sf), "start", "time", ["cut"], "b", within=24.0)
    both = joins.asof(before, d.cuts(spark, sf), "start", "time", ["cut"], "a", forward=True, within=24.0)
    first = F.col("b_time").isNotNull() & (F.col("a_time").isNull() | (F.col("start") - F.col("b_time") <= F.col("a_time") - F.col("start")))
    near = both.withColumn("time", F.when(first, F.col("b_time")).otherwise(F.col("a_time")))
    return near.where("time IS NOT NULL").select("video_id", "id", *r6("time"))


QUERIES = {f.__name__: f for f in (hybrid_topk, hybrid_stats, rank_changes, overlap_pairs, multi_signal_score, select_top_clips, clip_merge_dedup_07, moment_merge_dedup_05, min_gap_cuts, scene_stats, cuts_in_range, nearest_cut)}

_PAIRS = f"""WITH RECURSIVE {d.SQL.strip()},
pairs AS (SELECT c.video_id, c.id, e.seg, e.energy_score, (least(c."end", e."end") - greatest(c.start, e.start)) / (c."end" - c.start) AS overlap_ratio
          FROM clips c JOIN energy_segments e ON c.video_id = e.video_id AND e.start < c."end" AND c.start < e."end"),
big AS (SELECT * FROM pairs WHERE overlap_ratio > 0.1::DOUBLE),
sums AS (SELECT video_id, id, max(energy_score) AS m, avg(energy_score) AS a, sum(overlap_ratio) AS r, count(*) AS n FROM big GROUP BY ALL),
boosted AS (SELECT c.*, coalesce(m, 0) AS max_energy, coalesce(a, 0) AS avg_energy, coalesce(r, 0) AS overlap_ratio, coalesce(n, 0) AS overlapping_segments,
            coalesce(0.5::DOUBLE * m + 0.3::DOUBLE * a + 0.2::DOUBLE * least(r, 1), 0) AS energy_boost FROM clips c LEFT JOIN sums USING (video_id, id)),
hybrid AS (SELECT *, least(interest_score * (1 + 0.3::DOUBLE * energy_boost), 1) AS hybrid_score, energy_boost > 0.5 AS has_high_energy FROM boosted),
scored AS (SELECT video_id, id, start, start + 20 + id % 7 * 12 AS "end", interest_score AS score FROM clips)"""


def _fold(threshold: str, source: str = "scored", p: str = "") -> str:
    """The fold as a recursion over (interval i, later interval j); {p}kept has what stays."""
    over = f"CASE WHEN list_contains(skip, i) OR j > n OR (NOT list_contains(skip, j) AND (s[j] > e[i] OR (r > {threshold}::DOUBLE AND sc[j] > sc[i])))"
    return f"""{p}o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start, id) AS p, count(*) OVER (PARTITION BY video_id) AS n FROM {source}),
{p}arr AS (SELECT video_id, any_value(n) AS n, list(start ORDER BY p) AS s, list("end" ORDER BY p) AS e, list(score ORDER BY p) AS sc FROM {p}o GROUP BY video_id),
{p}f AS (SELECT video_id, 1 AS i, 2 AS j, []::BIGINT[] AS skip FROM {p}arr
  UNION ALL
  SELECT f.video_id, {over} THEN i + 1 ELSE i END, {over} THEN i + 2 ELSE j + 1 END,
    CASE WHEN list_contains(skip, i) OR j > n OR list_contains(skip, j) OR s[j] > e[i] OR r <= {threshold}::DOUBLE THEN skip WHEN sc[j] > sc[i] THEN list_append(skip, i) ELSE list_append(skip, j) END
  FROM (SELECT f.*, a.n, a.s, a.e, a.sc, CASE WHEN j > a.n THEN 0 ELSE greatest(least(a.e[i], a.e[j]) - greatest(a.s[i], a.s[j]), 0) / least(a.e[i] - a.s[i], a.e[j] - a.s[j]) END AS r FROM {p}f f JOIN {p}arr a USING (video_id)) f
  WHERE i <= n),
{p}last AS (SELECT f.video_id, skip FROM {p}f f JOIN {p}arr a USING (video_id) WHERE i = n + 1),
{p}kept AS (SELECT o.* EXCLUDE (p, n) FROM {p}o o JOIN {p}last USING (video_id) WHERE NOT list_contains(skip, p))"""


def _dedup(threshold: str) -> str:
    return f"""{_PAIRS}, {_fold(threshold)}
SELECT video_id, id, printf('clip_%03d', row_number() OVER (PARTITION BY video_id ORDER BY score DESC, id)) AS clip, round(start, 6) AS start, round("end", 6) AS "end", round(score, 6) AS interest_score FROM kept"""


ORACLE = {
    "hybrid_topk": _PAIRS + """ SELECT video_id, id, rank, round(hybrid_score, 6) AS hybrid_score, round(energy_boost, 6) AS energy_boost, round(max_energy, 6) AS max_energy, round(avg_energy, 6) AS avg_energy, round(overlap_ratio, 6) AS overlap_ratio, overlapping_segments, has_high_energy
        FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY hybrid_score DESC, id) AS rank FROM hybrid) WHERE rank <= 5""",
    "hybrid_stats": _PAIRS + """ SELECT count(*) AS total_clips, count_if(has_high_energy)::BIGINT AS clips_with_high_energy, count_if(energy_boost > 0)::BIGINT AS clips_with_energy_boost, coalesce(round(avg(interest_score), 3), 0) AS avg_ai_score, coalesce(round(avg(hybrid_score), 3), 0) AS avg_hybrid_score,
        coalesce(round(avg(energy_boost) FILTER (energy_boost > 0), 3), 0) AS avg_energy_boost, coalesce(round(max(hybrid_score), 3), 0) AS max_hybrid_score FROM hybrid""",
    "rank_changes": _PAIRS + """ SELECT *, abs(ai_rank - hybrid_rank) > 2 AS changed FROM (SELECT video_id, id, row_number() OVER (PARTITION BY video_id ORDER BY interest_score DESC, id) AS ai_rank, row_number() OVER (PARTITION BY video_id ORDER BY hybrid_score DESC, id) AS hybrid_rank FROM hybrid)""",
    "overlap_pairs": _PAIRS + " SELECT video_id, id, seg, round(energy_score, 6) AS energy_score, round(overlap_ratio, 6) AS overlap_ratio FROM big",
    "multi_signal_score": _PAIRS + """, au AS (SELECT video_id, id, avg(energy_score) AS a FROM pairs GROUP BY ALL), vi AS (SELECT c.video_id, c.id, count(*) AS n FROM clips c JOIN cuts u ON c.video_id = u.video_id AND u.time BETWEEN c.start AND c."end" GROUP BY ALL),
        x AS (SELECT c.video_id, c.id, interest_score AS ai, coalesce(a, 0.5::DOUBLE) AS au, CASE WHEN c.video_id NOT IN (SELECT video_id FROM cuts) THEN 0.5::DOUBLE WHEN n IS NULL THEN 0.3::DOUBLE WHEN n <= 2 THEN 0.6::DOUBLE ELSE 0.9::DOUBLE END AS vi FROM clips c LEFT JOIN au USING (video_id, id) LEFT JOIN vi USING (video_id, id))
        SELECT video_id, id, round(ai, 6) AS ai_score, round(au, 6) AS audio_score, round(vi, 6) AS visual_score, round(ai * 0.5::DOUBLE + au * 0.3::DOUBLE + vi * 0.2::DOUBLE, 6) AS combined FROM x""",
    "select_top_clips": _PAIRS + """,
        o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, id) AS p FROM scored WHERE "end" - start BETWEEN 30 AND 90),
        f AS (SELECT video_id, p, [{'s': start, 'e': "end"}] AS kept, true AS took FROM o WHERE p = 1
          UNION ALL SELECT o.video_id, o.p, CASE WHEN hit THEN kept ELSE list_append(kept, {'s': start, 'e': "end"}) END, NOT hit FROM (
            SELECT o.*, f.kept, len(list_filter(f.kept, lambda k: greatest(least(k.e, o."end") - greatest(k.s, o.start), 0) / least(k.e - k.s, o."end" - o.start) > 0.3::DOUBLE)) > 0 AS hit FROM f JOIN o ON o.video_id = f.video_id AND o.p = f.p + 1) o)
        SELECT video_id, id, rank, round(start, 6) AS start, round("end", 6) AS "end", round(score, 6) AS score FROM (SELECT o.*, row_number() OVER (PARTITION BY o.video_id ORDER BY o.score DESC, o.id) AS rank FROM o JOIN f ON o.video_id = f.video_id AND o.p = f.p WHERE took) WHERE rank <= 3""",
    "clip_merge_dedup_07": _dedup("0.7"),
    "moment_merge_dedup_05": _dedup("0.5"),
    "min_gap_cuts": _PAIRS + """, o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY time, cut) AS p FROM cuts),
        f AS (SELECT video_id, p, time AS at, true AS took FROM o WHERE p = 1 UNION ALL SELECT o.video_id, o.p, CASE WHEN o.time - f.at >= 48 THEN o.time ELSE f.at END, o.time - f.at >= 48 FROM f JOIN o ON o.video_id = f.video_id AND o.p = f.p + 1)
        SELECT video_id, cut, round(time, 6) AS time FROM o JOIN f USING (video_id, p) WHERE took""",
    "scene_stats": _PAIRS + " SELECT video_id, count(*) AS scene_count, round(coalesce(avg(gap), 0), 6) AS avg_scene_duration FROM (SELECT *, lead(time) OVER (PARTITION BY video_id ORDER BY time, cut) - time AS gap FROM cuts) GROUP BY video_id",
    "cuts_in_range": _PAIRS + " SELECT video_id, cut, round(time, 6) AS time FROM cuts WHERE time BETWEEN 100 AND 300",
    "nearest_cut": _PAIRS + """ SELECT video_id, id, round(time, 6) AS time FROM (SELECT c.video_id, c.id, u.time, row_number() OVER (PARTITION BY c.video_id, c.id ORDER BY abs(u.time - c.start), u.time) AS k FROM clips c JOIN cuts u ON u.video_id = c.video_id AND abs(u.time - c.start) <= 24) WHERE k = 1""",
}
