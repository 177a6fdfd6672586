"""Queries: model responses, quality gate, costs, platforms, display, errors, stage states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import display as x
from tidemark.operators import editorial, platforms
from tidemark.plans.ranking import r6
from tidemark.sources import domain as d

_RESPONSE = """concat('[{"start_time": ', event_id % 50, ', "end_time": ', event_id % 50 + event_id % 37, ', "title": "t', event_id, '"}, {"start_time": 5, "end_time": 30}, {"start_time": 1, "end_time": ', event_id % 90, ', "title": "u", "interest_score": 0.', event_id % 9 + 1, ', "content_type": "story"}]')"""
_MOMENTS = """concat('[{"rough_start": ', event_id % 50, ', "rough_end": "', event_id % 70, '", "core_idea": "c", "why_interesting": "w", "interest_score": 0.', event_id % 9 + 1, '}, {"rough_start": "soon", "rough_end": 3, "core_idea": "c", "why_interesting": "w", "interest_score": 1}, {"rough_start": 1}]')"""


def clip_validate(spark, sf: str) -> DataFrame:
    e = d.table(spark, sf, "events").select("event_id", F.expr(_RESPONSE).alias("response"))
    return editorial.parse_clips(e, least=10.0, most=80.0)


def moment_parse(spark, sf: str) -> DataFrame:
    return editorial.parse_moments(d.table(spark, sf, "events").select("event_id", F.expr(_MOMENTS).alias("response")))


def _thoughts(spark, sf):
    """Two looks at a thought for each labelled document, by its id."""
    i = F.col("doc_id")
    rows = d.table(spark, sf, "labels").join(d.table(spark, sf, "documents").select("doc_id", F.length("text").alias("n")), "doc_id")
    start, end = F.lit(100.0), 120.0 + i % 50
    s1, e1 = start + i % 41 - 20, end + i % 23 - 11
    return rows.select(
        i.alias("id"), (i % 20).alias("video_id"), ((i * 29 + F.col("n")) % 100 / 100.0).alias("interest_score"), start.alias("expanded_start"), end.alias("expanded_end"), s1.alias("start_1"), e1.alias("end_1"), ((i * 37 + F.col("quality")) % 100 / 100.0).alias("score_1"), F.when(i % 3 == 0, "needs_context").alias("reason_1"),
        (s1 + i % 5 - 2).alias("start_2"), (e1 + i % 7 - 3).alias("end_2"), (i * 53 % 100 / 100.0).alias("score_2"), F.when(i % 2 == 0, "needs_context").alias("reason_2"),
    )


def verdict_gate(spark, sf: str) -> DataFrame:
    return editorial.gate(_thoughts(spark, sf), 15.0, 75.0).select("id", "verdict", "rejection_reason", *r6("refined_start", "refined_end", "standalone_score"))


def gate_stats(spark, sf: str) -> DataFrame:
    s = editorial.gate_stats(editorial.gate(_thoughts(spark, sf), 15.0, 75.0))
    return s.select("passed", "revised", "rejected", "no_changes_needed", *r6("pass_rate", "boundary_quality_rate"))


def editorial_topk(spark, sf: str) -> DataFrame:
    same = lambda df: df
    top = editorial.editorial(_thoughts(spark, sf), same, same, same, same, 3, 15.0, 75.0)
    return top.select("video_id", "id", "rank", *r6("weighted"))


def cost_rollup(spark, sf: str) -> DataFrame:
    doc = d.table(spark, sf, "documents")
    usage = doc.select((F.col("doc_id") % 4 + 1).cast("int").alias("layer"), F.floor(F.length("text") / 4).alias("tokens_in"), (F.col("doc_id") % 500).alias("tokens_out"))
    return editorial.costs(usage).select("layer", "calls", "tokens_in", "tokens_out", *r6("dollars"))


def _videos(spark, sf):
    """Videos of many shapes, one for each customer."""
    i = F.col("c_custkey")
    return d.table(spark, sf, "customer").select(i.alias("video"), (i % 7 * 240 + 480).cast("int").alias("src_w"), (i % 5 * 300 + 480).cast("int").alias("src_h"), F.when(i % 2 == 0, 30.0).otherwise(25.0).alias("src_fps"), (i % 900).cast("double").alias("seconds"), (i * 1000003 % 700000000).alias("size"))


def platform_plan(spark, sf: str) -> DataFrame:
    return platforms.plan(_videos(spark, sf)).select("video", "platform", "action", "vf", F.array_join("args", " ").alias("args"), "too_long")


def platform_smart(spark, sf: str) -> DataFrame:
    return platforms.plan(_videos(spark, sf), "smart").select("video", "platform", "vf")


def platform_preview(spark, sf: str) -> DataFrame:
    p = platforms.plan(_videos(spark, sf))
    return p.select("video", "platform", "action", F.round("crop_percentage", 1).alias("crop_percentage"), F.col("warning").isNotNull().alias("too_large"))


def platform_errors(spark, sf: str) -> DataFrame:
    """A batch of which some videos have no dimensions: they have error rows."""
    v = _videos(spark, sf).withColumn("src_w", F.when(F.col("video") % 4 != 0, F.col("src_w"))).withColumn("src_h", F.when(F.col("video") % 9 == 0, 0).otherwise(F.col("src_h")))
    p = platforms.plan(v)
    return p.select("video", "platform", "error", "action", "vf", F.col("args").isNotNull().alias("planned"))


def error_lines(spark, sf: str) -> DataFrame:
    """The line of a process's output that says what went wrong, video endings, rates and costs."""
    k = F.col("event_id")
    out = F.element_at(F.array(*map(F.lit, ("start\nValueError: bad\ndone", "a\n\n  last line  \n", "x\nKeyException: k", "\n \n"))), (k % 4 + 1).cast("int"))
    path = F.element_at(F.array(*map(F.lit, ("/a/b.MP4", "c.mkv", "d.txt", "no ending", "e.mp4.part"))), (k % 5 + 1).cast("int"))
    e = d.table(spark, sf, "events")
    return e.select("event_id", x.error_line(out).alias("line"), x.is_video(path).alias("video"), x.rate(k % 50 + 1, F.lit(4.0)).alias("rate"), x.cost(k % 1000 / 4.0).alias("cost"), x.percentage(k % 100 / 100.0, 0).alias("share"), x.bullets(F.array(F.lit("a"), (k % 3).cast("string"))).alias("bullets"))


def display_forms(spark, sf: str) -> DataFrame:
    o = d.table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") * 7919 % 90000).alias("k"))
    s = F.col("k") / 8.0
    return o.select("o_orderkey", x.duration(s).alias("duration"), x.clock(s).alias("clock"), x.time_range(s, s + 100).alias("span"), x.file_size(F.col("k") * 1000).alias("size"), x.thousands(F.col("k")).alias("thousands"), x.progress_bar(F.col("k") % 11 / 10.0).alias("bar"))


_MESSAGES = ("connect ECONNREFUSED 1.2.3.4", "Request timed out", "EACCES: permission denied", "HTTP 503", "rate limit: try again in 12.5s", "ENOENT: no such file", "401 Unauthorized", "boom", "Rate limit. Please try again in 3s")


def _errors(spark, sf):
    pick = F.element_at(F.array(*map(F.lit, _MESSAGES)), (F.col("event_id") % len(_MESSAGES) + 1).cast("int"))
    return d.table(spark, sf, "events").select("event_id", pick.alias("message"))


def error_classify(spark, sf: str) -> DataFrame:
    return _errors(spark, sf).select("event_id", x.is_transient(F.col("message")).alias("transient"), x.friendly(F.col("message")).alias("friendly"))


def retry_wait(spark, sf: str) -> DataFrame:
    e = _errors(spark, sf)
    return e.select("event_id", x.retry_wait(F.col("message"), F.col("event_id") % 5).alias("wait"), x.backoff(F.lit(1.0), F.lit(2.0), F.col("event_id") % 4 + 1).alias("backoff"))


def stage_state(spark, sf: str) -> DataFrame:
    e = d.frames(spark, sf).select(F.col("video_id").alias("run"), F.col("t").alias("at"), F.col("event_id").alias("seq"), F.col("event_type").alias("stage"), F.col("value").alias("progress"))
    return editorial.stage_states(e).select("run", "stage", "status", *r6("progress"))


QUERIES = {f.__name__: f for f in (clip_validate, moment_parse, verdict_gate, gate_stats, editorial_topk, cost_rollup, platform_plan, platform_smart, platform_preview, platform_errors, error_lines, display_forms, error_classify, retry_wait, stage_state)}

_LOOKS = """WITH th AS (SELECT i AS id, i % 20 AS video_id, (i * 29 + n) % 100 / 100.0::DOUBLE AS interest, 100.0::DOUBLE AS s0, 120.0::DOUBLE + i % 50 AS e0, 100.0::DOUBLE + i % 41 - 20 AS s1, 120.0::DOUBLE + i % 50 + i % 23 - 11 AS e1, (i * 37 + quality) % 100 / 100.0::DOUBLE AS c1, CASE WHEN i % 3 = 0 THEN 'needs_context' END AS r1, i * 53 % 100 / 100.0::DOUBLE AS c2, CASE WHEN i % 2 = 0 THEN 'needs_context' END AS r2
  FROM (SELECT l.doc_id AS i, quality, length(text) AS n FROM labels l JOIN documents USING (doc_id))),
t2 AS (SELECT *, s1 + id % 5 - 2 AS s2, e1 + id % 7 - 3 AS e2 FROM th)"""
#: The gate over two looks (t2: s0, e0, s1, e1, c1, r1, s2, e2, c2, r2), for clips of 15 to 75 seconds.
_GATE = """way AS (SELECT *, CASE WHEN e1 - s1 < 15 OR e1 - s1 > 75 THEN 1 WHEN c1 >= 0.7 THEN 2 WHEN c1 < 0.4 THEN 3 WHEN abs(s0 - s1) > 15 OR abs(e0 - e1) > 15 THEN 4 WHEN e2 - s2 < 15 OR e2 - s2 > 75 THEN 5 WHEN c2 >= 0.7 THEN 6 WHEN c2 >= 0.4 THEN 7 ELSE 8 END AS w FROM t2),
gated AS (SELECT *, CASE WHEN w IN (2, 6) THEN 'PASS' WHEN w = 7 THEN 'REVISE' ELSE 'REJECT' END AS verdict, CASE WHEN w IN (1, 5) THEN 'duration_constraint' WHEN w = 3 THEN r1 WHEN w = 4 THEN coalesce(r1, 'structural_issue') WHEN w = 8 THEN r2 END AS reason,
  CASE WHEN w IN (1, 3, 4) THEN s0 WHEN w IN (2, 5, 8) THEN s1 ELSE s2 END AS s, CASE WHEN w IN (1, 3, 4) THEN e0 WHEN w IN (2, 5, 8) THEN e1 ELSE e2 END AS e, CASE WHEN w <= 4 THEN c1 ELSE c2 END AS c FROM way)"""
_THOUGHTS = _LOOKS + ",\n" + _GATE
_P = "(VALUES " + ", ".join(f"('{p[0]}', '{p[1]}', {p[2]}, {p[3]}, {p[5] if p[5] is not None else 'NULL'}, {p[6]}, '{p[7]}', '{p[8]}')" for p in platforms.PLATFORMS) + ") p(platform, name, w, h, longest, largest, rate, audio)"
_PLAN = f"""WITH v AS (SELECT c_custkey AS video, c_custkey % 7 * 240 + 480 AS sw, c_custkey % 5 * 300 + 480 AS sh, CASE WHEN c_custkey % 2 = 0 THEN 30 ELSE 25 END AS fps, c_custkey % 900 AS seconds, c_custkey * 1000003 % 700000000 AS size FROM customer),
j AS (SELECT *, sw::DOUBLE / sh AS sa, w::DOUBLE / h AS ta, trunc(sh * w / h)::BIGINT AS nw, trunc(sw * h / w)::BIGINT AS nh FROM v CROSS JOIN {_P}),
k AS (SELECT *, CASE WHEN abs(sa - ta) <= 0.01 THEN 'scale' WHEN sa > ta THEN 'crop_horizontal' ELSE 'crop_vertical' END AS action FROM j)"""
_VF = lambda ox, oy: f"CASE WHEN fps <> 30 THEN 'fps=30,' ELSE '' END || CASE action WHEN 'scale' THEN '' WHEN 'crop_horizontal' THEN 'crop=' || nw || ':' || sh || ':' || {ox} || ':0,' ELSE 'crop=' || sw || ':' || nh || ':0:' || {oy} || ',' END || 'scale=' || w || ':' || h"
_CENTER, _SMART = _VF("(sw - nw) // 2", "(sh - nh) // 2"), _VF("trunc((sw - nw) * 0.45::DOUBLE)::BIGINT", "trunc((sh - nh) * 0.35::DOUBLE)::BIGINT")
_CLOCK = lambda s: f"CASE WHEN {s} < 60 THEN floor({s} + 0.5)::BIGINT || 's' WHEN {s} >= 3600 THEN floor({s} / 3600)::BIGINT || ':' || lpad((floor({s} % 3600 / 60)::BIGINT)::VARCHAR, 2, '0') || ':' || lpad((floor({s} % 60 + 0.5)::BIGINT)::VARCHAR, 2, '0') ELSE floor({s} / 60)::BIGINT || ':' || lpad((floor({s} % 60 + 0.5)::BIGINT)::VARCHAR, 2, '0') END"
_LIST = ", ".join(f"'{m}'" for m in _MESSAGES)
_ERR = f"WITH e AS (SELECT event_id, ([{_LIST}])[event_id % {len(_MESSAGES)} + 1] AS message FROM events)"
_FRIENDLY = "CASE " + " ".join(f"WHEN regexp_matches(lower(message), '{'|'.join(p)}') THEN '{say}'" for p, say in x.FRIENDLY) + " ELSE message END"
ORACLE = {
    "clip_validate": f"""SELECT event_id, printf('clip_%03d', pos) AS id, s AS start_time, e AS end_time, e - s AS duration, title, '' AS reason, coalesce(score, 0.5) AS interest_score, coalesce(kind, 'general') AS content_type FROM (
        SELECT event_id, pos, (c->>'start_time')::DOUBLE AS s, (c->>'end_time')::DOUBLE AS e, c->>'title' AS title, (c->>'interest_score')::DOUBLE AS score, c->>'content_type' AS kind FROM (
          SELECT event_id, unnest(range(1, 4)) AS pos, unnest(from_json(r, '["JSON"]')) AS c FROM (SELECT event_id, {_RESPONSE} AS r FROM events))) WHERE title IS NOT NULL AND e - s >= 10 AND e - s <= 80""",
    "moment_parse": f"""SELECT event_id, pos, s AS rough_start, e AS rough_end, core_idea, why_interesting, score AS interest_score, 'general' AS content_type FROM (
        SELECT event_id, pos, try_cast(c->>'rough_start' AS DOUBLE) AS s, try_cast(c->>'rough_end' AS DOUBLE) AS e, c->>'core_idea' AS core_idea, c->>'why_interesting' AS why_interesting, try_cast(c->>'interest_score' AS DOUBLE) AS score FROM (
          SELECT event_id, unnest(range(0, 3)) AS pos, unnest(from_json(r, '["JSON"]')) AS c FROM (SELECT event_id, {_MOMENTS} AS r FROM events))) WHERE s IS NOT NULL AND e IS NOT NULL AND score IS NOT NULL AND core_idea IS NOT NULL AND why_interesting IS NOT NULL""",
    "verdict_gate": _THOUGHTS + " SELECT id, verdict, reason AS rejection_reason, round(s, 6) AS refined_start, round(e, 6) AS refined_end, round(c, 6) AS standalone_score FROM gated",
    "gate_stats": _THOUGHTS + """ SELECT count_if(verdict = 'PASS')::BIGINT AS passed, count_if(verdict = 'REVISE')::BIGINT AS revised, count_if(verdict = 'REJECT')::BIGINT AS rejected, count_if(verdict = 'PASS' AND s = s0 AND e = e0)::BIGINT AS no_changes_needed, round(count_if(verdict = 'PASS')::DOUBLE / count(*), 6) AS pass_rate,
        round(count_if(verdict = 'PASS' AND s = s0 AND e = e0)::DOUBLE / nullif(count_if(verdict <> 'REJECT'), 0), 6) AS boundary_quality_rate FROM gated""",
    "editorial_topk": _THOUGHTS + " SELECT video_id, id, rank, round(v, 6) AS weighted FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY v DESC, id) AS rank FROM (SELECT *, 0.6::DOUBLE * interest + 0.4::DOUBLE * c AS v FROM gated WHERE verdict = 'PASS')) WHERE rank <= 3",
    "cost_rollup": """SELECT layer, calls, i AS tokens_in, o AS tokens_out, round(i / 1000000.0::DOUBLE * CASE WHEN layer <= 2 THEN 2.5::DOUBLE ELSE 0.15::DOUBLE END + o / 1000000.0::DOUBLE * CASE WHEN layer <= 2 THEN 10.0::DOUBLE ELSE 0.6::DOUBLE END, 6) AS dollars
        FROM (SELECT (doc_id % 4 + 1)::INT AS layer, count(*) AS calls, sum(length(text) // 4)::BIGINT AS i, sum(doc_id % 500)::BIGINT AS o FROM documents GROUP BY 1)""",
    "platform_plan": _PLAN + f""" SELECT video, platform, action, {_CENTER} AS vf, '-vf ' || {_CENTER} || ' -c:v libx264 -preset medium -b:v ' || rate || ' -maxrate ' || rate || ' -bufsize ' || rtrim(rate, 'M')::INT * 2 || 'M -c:a aac -b:a ' || audio || ' -ar 48000 -movflags +faststart -y' AS args, coalesce(seconds > longest, false) AS too_long FROM k""",
    "platform_smart": _PLAN + f" SELECT video, platform, {_SMART} AS vf FROM k",
    "platform_preview": _PLAN + " SELECT video, platform, action, round(CASE action WHEN 'scale' THEN 0 WHEN 'crop_horizontal' THEN (1 - ta / sa) * 100 ELSE (1 - sa / ta) * 100 END, 1) AS crop_percentage, size > largest AS too_large FROM k",
    "platform_errors": _PLAN + f""", b AS (SELECT *, video % 4 = 0 OR video % 9 = 0 AS bad FROM k) SELECT video, platform, CASE WHEN bad THEN 'no video dimensions' END AS error, CASE WHEN NOT bad THEN action END AS action, CASE WHEN NOT bad THEN {_CENTER} END AS vf, NOT bad AS planned FROM b""",
    "error_lines": """SELECT event_id, (['ValueError: bad', 'last line', 'KeyException: k', NULL])[event_id % 4 + 1] AS line, event_id % 5 < 2 AS video, printf('%.1f/s', round(((event_id % 50 + 1) / 4.0::DOUBLE)::DECIMAL(18, 6), 1)::DOUBLE) AS rate, '$' || printf('%.2f', event_id % 1000 / 4.0::DOUBLE) AS cost, event_id % 100 || '%' AS share, '  • a' || chr(10) || '  • ' || event_id % 3 AS bullets FROM events""",
    "display_forms": f"""WITH o AS (SELECT o_orderkey, o_orderkey * 7919 % 90000 AS k FROM orders), s AS (SELECT *, k / 8.0::DOUBLE AS s, k / 8.0::DOUBLE + 100 AS e, k * 1000 AS b FROM o)
        SELECT o_orderkey, CASE WHEN s < 60 THEN floor(s + 0.5)::BIGINT || 's' ELSE CASE WHEN s >= 3600 THEN floor(s / 3600)::BIGINT || 'h ' ELSE '' END || floor(s % 3600 / 60)::BIGINT || 'm' || CASE WHEN floor(s % 60 + 0.5) > 0 THEN ' ' || floor(s % 60 + 0.5)::BIGINT || 's' ELSE '' END END AS duration,
        {_CLOCK('s')} AS clock, {_CLOCK('s')} || ' - ' || {_CLOCK('e')} AS span, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', floor(b / 1024.0::DOUBLE * 10 + 0.5) / 10) ELSE printf('%.1f MB', floor(b / 1048576.0::DOUBLE * 10 + 0.5) / 10) END AS size, format('{{:,}}', k) AS thousands,
        '[' || repeat('█', floor(k % 11 / 10.0::DOUBLE * 10 + 0.5)::BIGINT) || repeat('░', 10 - floor(k % 11 / 10.0::DOUBLE * 10 + 0.5)::BIGINT) || '] ' || k % 11 * 10 || '%' AS bar FROM s""",
    "error_classify": _ERR + f" SELECT event_id, regexp_matches(lower(message), '{'|'.join(x.TRANSIENT)}') AS transient, {_FRIENDLY} AS friendly FROM e",
    "retry_wait": _ERR + r" SELECT event_id, coalesce(try_cast(nullif(regexp_extract(message, 'try again in (\d+\.?\d*)s', 1), '') AS DOUBLE) + 1, 2.0::DOUBLE * pow(2, event_id % 5)) AS wait, pow(2.0::DOUBLE, event_id % 4) AS backoff FROM e",
    "stage_state": f"""WITH {d.SQL.strip()}, e AS (SELECT video_id AS run, event_type AS stage, value AS progress, row_number() OVER (PARTITION BY video_id, event_type ORDER BY t, event_id) AS k, row_number() OVER (PARTITION BY video_id ORDER BY t, event_id) AS o FROM frames),
        s AS (SELECT run, stage, min(o) AS started, max(o) FILTER (k > 1) AS lo, arg_max(least(greatest(progress, 0), 100), o) FILTER (k > 1) AS lp, min(o) FILTER (k > 1 AND progress >= 100) AS done FROM e GROUP BY ALL),
        n AS (SELECT *, lead(started) OVER (PARTITION BY run ORDER BY started) AS nx FROM s), c AS (SELECT *, nx IS NOT NULL AND (done IS NULL OR done > nx) AS closed FROM n)
        SELECT run, stage, CASE WHEN closed OR done IS NOT NULL THEN 'completed' ELSE 'in_progress' END AS status, round(CASE WHEN closed AND (lo IS NULL OR lo < nx) THEN 100 ELSE coalesce(lp, 0) END, 6) AS progress FROM c""",
}
