"""Queries over transcripts: boundaries, alignment, texts, chunks, sessions, file names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as t
from tidemark.operators import chunks, joins, talk
from tidemark.plans.ranking import r6
from tidemark.sources import domain as d
from tidemark.sources.shared import materialize


def sentence_boundaries(spark, sf: str) -> DataFrame:
    return talk.boundaries(d.segments(spark, sf)).select("video_id", "seg_id", *r6("time"), "type", "confidence")


def _bounds(spark, sf):
    """The boundaries, written once: several lookups read them."""
    return materialize(talk.boundaries(d.segments(spark, sf)), "boundaries")


def _near(spark, sf, at, forward):
    b = joins.asof(d.talk_clips(spark, sf), talk.boundaries(d.segments(spark, sf)), at, "time", ["type"], "b", forward=forward, within=10.0)
    return b.select("video_id", "id", F.round("b_time", 6).alias("time"), F.col("b_type").alias("type"))


def boundary_before(spark, sf: str) -> DataFrame:
    return _near(spark, sf, "start", False)


def boundary_after(spark, sf: str) -> DataFrame:
    return _near(spark, sf, "end", True)


def _aligned(spark, sf):
    return talk.align(d.talk_clips(spark, sf), _bounds(spark, sf), least_length=20.0, most_length=40.0)


def align_clips(spark, sf: str) -> DataFrame:
    return _aligned(spark, sf).select("video_id", "id", *r6("start", "end", "start_adjustment", "end_adjustment"), "start_aligned", "end_aligned", "start_boundary_type", "end_boundary_type")


def align_stats(spark, sf: str) -> DataFrame:
    s = talk.align_stats(_aligned(spark, sf))
    return s.select("total_clips", "professionally_aligned", *[F.round(c, 6).alias(c) for c in ("alignment_rate", "avg_start_adjustment", "avg_end_adjustment", "max_start_adjustment", "max_end_adjustment")], "zero_adjustment_count")


def double_boundary(spark, sf: str) -> DataFrame:
    s = d.segments(spark, sf)
    cuts = s.select("video_id", F.col("seg_id").alias("cut"), (F.col("start") + 0.4 + F.col("seg_id") % 5).alias("cut_time"))
    return talk.double_boundaries(_bounds(spark, sf), cuts).select("video_id", "seg_id", *r6("time"), "type", "double_boundary")


def clip_text(spark, sf: str) -> DataFrame:
    return talk.text_in(d.talk_clips(spark, sf), d.segments(spark, sf))


def context_window(spark, sf: str) -> DataFrame:
    return talk.context_window(d.talk_clips(spark, sf), d.segments(spark, sf))


def transcript_lines(spark, sf: str) -> DataFrame:
    return talk.transcript(d.segments(spark, sf))


def token_chunks(spark, sf: str) -> DataFrame:
    return chunks.token_chunks(talk.line_tokens(d.segments(spark, sf)), 300)


def fixed_chunks(spark, sf: str) -> DataFrame:
    return talk.fixed_chunks(d.segments(spark, sf), 60.0).select("video_id", "seg_id", "chunk", "place", *r6("offset"))


def speech_sessions(spark, sf: str) -> DataFrame:
    return talk.sessions(d.segments(spark, sf)).select("video_id", F.col("session").cast("long").alias("session"), *r6("start", "end"), "n")


def clip_filenames(spark, sf: str) -> DataFrame:
    s = d.segments(spark, sf)
    return s.select("video_id", "seg_id", t.clip_name((F.col("seg_id") + 1).cast("int"), F.when(F.col("seg_id") % 6 != 5, F.col("text")), F.col("start"), F.col("end")).alias("name"))


def titles_hashtags(spark, sf: str) -> DataFrame:
    s = d.segments(spark, sf)
    name = t.slug(F.col("text"))
    return s.select("video_id", "seg_id", t.title(F.trim("text")).alias("title"), F.array_join(t.hashtags(F.concat(F.lit("#"), F.trim("text"))), ",").alias("tags"), t.title_case(name).alias("heading"), t.unquote(F.concat(F.lit('"'), F.col("text"), F.lit('"'))).alias("bare"))


QUERIES = {f.__name__: f for f in (sentence_boundaries, boundary_before, boundary_after, align_clips, align_stats, double_boundary, clip_text, context_window, transcript_lines, token_chunks, fixed_chunks, speech_sessions, clip_filenames, titles_hashtags)}

_WORDS = ", ".join(f"'{w}'" for w in t.TRANSITIONS)
_END = "(regexp_matches(trim(text), '[.!?]$') OR (regexp_matches(trim(text), '[\"'']$') AND length(trim(text)) > 1))"
_TIME = "printf('%02d:%02d', floor(start / 60)::INT, floor(start % 60)::INT)"
_B = f"""WITH RECURSIVE {d.SQL.strip()},
nx AS (SELECT *, lead(start) OVER o AS next_start, lead(text) OVER o AS next_text FROM segments WINDOW o AS (PARTITION BY video_id ORDER BY seg_id)),
raw AS (SELECT video_id, "end" AS time, 'sentence_end' AS type, 0.9::DOUBLE AS confidence, seg_id, 0 AS place FROM nx WHERE {_END}
  UNION ALL SELECT video_id, "end", 'pause', 0.7, seg_id, 1 FROM nx WHERE next_start - "end" >= 0.5
  UNION ALL SELECT video_id, next_start, 'topic_transition', 0.85, seg_id, 2 FROM nx WHERE {_END} AND regexp_replace(regexp_extract(lower(trim(next_text)), '^(\\S+)', 1), '^[.,!?;:]+|[.,!?;:]+$', '', 'g') IN ({_WORDS})),
bounds AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, time ORDER BY confidence DESC, seg_id, place) AS k FROM raw) WHERE k = 1)"""


def _aligned_sql(source: str, least: int, most: int) -> str:
    """The stages of alignment of a table with start and end; ``aligned`` has them all."""
    return f"""a1 AS (SELECT c.*, CASE WHEN c.start - b.time <= 10 THEN b.time END AS sb, CASE WHEN c.start - b.time <= 10 THEN b.type END AS st FROM {source} c ASOF LEFT JOIN bounds b ON c.video_id = b.video_id AND c.start >= b.time),
a2 AS (SELECT c.*, CASE WHEN b.time - c."end" <= 10 THEN b.time END AS eb, CASE WHEN b.time - c."end" <= 10 THEN b.type END AS et FROM a1 c ASOF LEFT JOIN bounds b ON c.video_id = b.video_id AND c."end" <= b.time),
a3 AS (SELECT *, coalesce(sb, start) AS s1, CASE WHEN coalesce(eb, "end") <= coalesce(sb, start) THEN "end" ELSE coalesce(eb, "end") END AS e2 FROM a2),
a4 AS (SELECT *, CASE WHEN bad THEN start ELSE s1 END AS s3, CASE WHEN bad THEN "end" ELSE e2 END AS e3 FROM (SELECT *, "end" - start > 0 AND e2 - s1 < ("end" - start) * 0.2::DOUBLE AS bad FROM a3)),
a5 AS (SELECT c.*, CASE WHEN b.time - c.x <= 5 THEN b.time END AS xb FROM (SELECT *, s3 + {least} AS x, s3 + {most} AS y FROM a4) c ASOF LEFT JOIN bounds b ON c.video_id = b.video_id AND c.x <= b.time),
a6 AS (SELECT c.*, CASE WHEN c.y - b.time <= 5 THEN b.time END AS tb FROM a5 c ASOF LEFT JOIN bounds b ON c.video_id = b.video_id AND c.y >= b.time),
a7 AS (SELECT *, CASE WHEN e3 - s3 > {most} AND tb IS NOT NULL THEN tb WHEN e3 - s3 < {least} AND xb IS NOT NULL THEN xb ELSE e3 END AS e4 FROM a6),
aligned AS (SELECT *, CASE WHEN e4 - s3 < 8 THEN start ELSE s3 END AS s5, CASE WHEN e4 - s3 < 8 THEN "end" ELSE e4 END AS e5 FROM a7)"""


_ALIGN = _B + ",\n" + _aligned_sql("talk_clips", 20, 40)
_SLUG = lambda x: f"(SELECT CASE WHEN v = '' THEN 'untitled' ELSE v END FROM (SELECT CASE WHEN length(u) > 50 THEN regexp_replace(u[1:50], '-[^-]*$', '') ELSE u END AS v FROM (SELECT regexp_replace(regexp_replace(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s-]', '', 'g'), '[-\\s]+', '-', 'g'), '^-+|-+$', '', 'g') AS u)))"
_NAME = lambda x: f"printf('%02dm%02ds', floor({x} / 60)::INT, floor({x} % 60)::INT)"
_JOINED = "string_agg(trim(s.text), ' ' ORDER BY s.seg_id)"
ORACLE = {
    "sentence_boundaries": _B + " SELECT video_id, seg_id, round(time, 6) AS time, type, confidence FROM bounds",
    "boundary_before": _ALIGN + " SELECT video_id, id, round(sb, 6) AS time, st AS type FROM a1",
    "boundary_after": _ALIGN + " SELECT video_id, id, round(eb, 6) AS time, et AS type FROM a2",
    "align_clips": _ALIGN + """ SELECT video_id, id, round(s5, 6) AS start, round(e5, 6) AS "end", round(s5 - start, 6) AS start_adjustment, round(e5 - "end", 6) AS end_adjustment, sb IS NOT NULL AS start_aligned, eb IS NOT NULL AS end_aligned, st AS start_boundary_type, et AS end_boundary_type FROM aligned""",
    "align_stats": _ALIGN + """ SELECT count(*) AS total_clips, count_if(sb IS NOT NULL OR eb IS NOT NULL)::BIGINT AS professionally_aligned, round(avg((sb IS NOT NULL OR eb IS NOT NULL)::INT), 6) AS alignment_rate, round(avg(abs(s5 - start)), 6) AS avg_start_adjustment, round(avg(abs(e5 - "end")), 6) AS avg_end_adjustment,
        round(max(abs(s5 - start)), 6) AS max_start_adjustment, round(max(abs(e5 - "end")), 6) AS max_end_adjustment, count_if(s5 = start AND e5 = "end")::BIGINT AS zero_adjustment_count FROM aligned""",
    "double_boundary": _B + " SELECT video_id, seg_id, round(time, 6) AS time, type, EXISTS (SELECT 1 FROM segments s WHERE s.video_id = b.video_id AND abs(s.start + 0.4::DOUBLE + s.seg_id % 5 - b.time) < 1) AS double_boundary FROM bounds b",
    "clip_text": _B + f""" SELECT c.video_id, c.id, {_JOINED} AS text FROM talk_clips c JOIN segments s ON s.video_id = c.video_id AND s.start < c."end" AND s."end" > c.start GROUP BY ALL""",
    "context_window": _B + f""" SELECT c.video_id, c.id, {_JOINED} AS text FROM talk_clips c JOIN segments s ON s.video_id = c.video_id AND s.start >= (c.start + c."end") / 2 - 60 AND s."end" <= (c.start + c."end") / 2 + 60 GROUP BY ALL""",
    "transcript_lines": _B + f" SELECT video_id, string_agg('[' || {_TIME} || '] ' || trim(text), chr(10) ORDER BY seg_id) AS transcript FROM segments GROUP BY video_id",
    "token_chunks": _B + f""", k AS (SELECT video_id, list(tok ORDER BY seg_id) AS ts, count(*) AS n FROM (SELECT *, length('[' || {_TIME} || '] ' || text || chr(10)) // 4 AS tok FROM segments) GROUP BY video_id),
        f AS (SELECT video_id, 1::BIGINT AS i, 1::BIGINT AS first, 0::HUGEINT AS used, 0::BIGINT AS chunk FROM k
          UNION ALL SELECT f.video_id, i + 1, CASE WHEN hit THEN i - carry ELSE first END, CASE WHEN hit THEN coalesce(list_sum(ts[i - carry:i - 1]), 0) ELSE used END + ts[i], chunk + hit::INT
          FROM (SELECT f.*, k.ts, k.n, used + k.ts[i] > 300 AND i > first AS hit, floor((i - first) * 0.1::DOUBLE)::BIGINT AS carry FROM f JOIN k USING (video_id)) f WHERE i <= n)
        SELECT video_id, chunk, min(first) AS first, max(i) - 1 AS last FROM f WHERE i > 1 GROUP BY ALL""",
    "fixed_chunks": _B + " SELECT video_id, seg_id, floor(start / 60)::BIGINT AS chunk, row_number() OVER (PARTITION BY video_id, floor(start / 60) ORDER BY seg_id) - 1 AS place, round(start - floor(start / 60) * 60, 6) AS offset FROM segments",
    "speech_sessions": _B + """ SELECT video_id, session, round(min(start), 6) AS start, round(max("end"), 6) AS "end", count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY video_id ORDER BY seg_id)::BIGINT AS session FROM (SELECT *, coalesce((start - lag("end") OVER (PARTITION BY video_id ORDER BY seg_id) >= 0.5)::INT, 0) AS new FROM segments)) GROUP BY ALL""",
    "clip_filenames": _B + f""" SELECT video_id, seg_id, CASE WHEN seg_id % 6 = 5 THEN 'clip' ELSE {_SLUG("text")} END || '_' || printf('%03d', seg_id + 1) || '_' || {_NAME("start")} || '-' || {_NAME('"end"')} AS name FROM segments""",
    "titles_hashtags": _B + f""" SELECT video_id, seg_id, CASE WHEN length(trim(text)) > 60 THEN left(trim(text), 57) || '...' ELSE trim(text) END AS title,
        array_to_string(list_transform(list_filter(regexp_split_to_array('#' || trim(text), '\\s+'), lambda w: w <> '')[1:5], lambda w: regexp_replace(w, '^#+', '')), ',') AS tags,
        array_to_string(list_transform(regexp_split_to_array({_SLUG("text")}, '[-_]'), lambda w: replace(upper(w[1:1]), 'ẞ', 'SS') || lower(w[2:])), ' ') AS heading, text AS bare FROM segments""",
}
