"""Queries over model answers (by the deterministic stand-ins) and whole runs: detection in chunks, the four layers,
alignment with flags, the full run and the older one."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import config, display
from tidemark.operators import editorial, ledger, model, pipelines, platforms, scoring
from tidemark.plans import talk as talk_plans
from tidemark.plans.publishing import _GATE, _PLAN, _VF, _videos
from tidemark.plans.ranking import _PAIRS, _fold, r6
from tidemark.sources import domain as d
from tidemark.sources.files import local_duration
from tidemark.sources.shared import materialize, scratch

#: Tokens of a chunk (small, so that most transcripts take several), clips and moments wanted, shortest and longest clip.
BUDGET, CLIPS, MOMENTS, SHORT, LONG = 300, 6, 8, 20.0, 50.0


def _clips(spark, sf):
    return model.detect_clips(d.segments(spark, sf), model.stand_in("clips"), CLIPS, SHORT, LONG, BUDGET)


def model_clips(spark, sf: str) -> DataFrame:
    return _clips(spark, sf).select("video_id", "rank", "id", *r6("start", "end", "interest_score"), "title", "reason", "content_type")


def model_moments(spark, sf: str) -> DataFrame:
    m = model.detect_moments(d.segments(spark, sf), model.stand_in("moments"), MOMENTS, BUDGET)
    return m.select("video_id", "id", *r6("rough_start", "rough_end", "interest_score"), "core_idea", "content_type")


def _thoughts(spark, sf):
    s = materialize(d.segments(spark, sf), "segments")
    moments = materialize(model.detect_moments(s, model.stand_in("moments"), MOMENTS, BUDGET), "moments")
    return materialize(model.expand(moments, s, model.stand_in("thought")), "thoughts")


def model_thoughts(spark, sf: str) -> DataFrame:
    return _thoughts(spark, sf).select("video_id", "id", *r6("expanded_start", "expanded_end", "confidence"), "thought_summary")


def thought_expansion(spark, sf: str) -> DataFrame:
    return model.expansion(_thoughts(spark, sf)).select("thoughts_analyzed", F.round("avg_expansion_ratio", 4).alias("avg_expansion_ratio"))


def model_looks(spark, sf: str) -> DataFrame:
    """The verdict on each thought after two looks."""
    g = editorial.gate(model.refine(_thoughts(spark, sf), d.segments(spark, sf), model.stand_in("look")), 15.0, 75.0)
    return g.select("video_id", "id", "verdict", "rejection_reason", *r6("refined_start", "refined_end", "standalone_score"))


def four_layer_run(spark, sf: str) -> DataFrame:
    best = model.four_layers(materialize(d.segments(spark, sf), "segments"), 3, 15.0, 75.0, budget=BUDGET)
    m = F.col("metadata")
    return best.select("video_id", "rank", "id", *r6("start", "end", "duration", "interest_score"), "title", "reason", F.array_join(m["hashtags"], " ").alias("hashtags"), F.round(m["thumbnail_time"], 6).alias("thumbnail_time"), F.round(m["layer2"]["confidence"], 6).alias("confidence"), m["layer3"]["verdict"].alias("verdict"))


def layer_usage(spark, sf: str) -> DataFrame:
    """Calls, tokens and dollars of the first two layers, and of both together."""
    s = d.segments(spark, sf)
    prompts = model.chunk_prompts(s, BUDGET)
    first = model.stand_in("moments")(prompts)
    clips = model.stand_in("clips")(prompts)
    cost = editorial.costs(model.usage(first, 1).unionByName(model.usage(clips, 2)))
    total = cost.rollup("layer").agg(*[F.sum(c).alias(c) for c in ("calls", "tokens_in", "tokens_out", "dollars")])
    return total.select(F.coalesce("layer", F.lit(0)).alias("layer"), "calls", "tokens_in", "tokens_out", *r6("dollars"))


def _cuts(spark, sf):
    return d.segments(spark, sf).select("video_id", F.col("seg_id").alias("cut"), (F.col("start") + 0.4 + F.col("seg_id") % 5).alias("cut_time"))


def aligned_flags(spark, sf: str) -> DataFrame:
    """Alignment of all clips with flags for scene cuts and titles made anew."""
    clips = d.talk_clips(spark, sf).withColumn("title", F.concat(F.lit("clip "), F.col("id").cast("string")))
    a = pipelines.align_all(clips, d.segments(spark, sf), _cuts(spark, sf), 20.0, 40.0, model.stand_in("title"), talk_plans._bounds(spark, sf))
    return a.select("video_id", "id", *r6("start", "end"), "professionally_aligned", "on_cut", "title", "original_title")


def _full(spark, sf):
    s = materialize(d.segments(spark, sf), "segments")
    sizes = F.round(F.col("length") * 1000).cast("long") * 125
    seconds = local_duration(s).withColumnRenamed("duration", "video_seconds")
    return pipelines.full_run(s, d.energy_segments(spark, sf), None, seconds, 2, sizes, None, SHORT, LONG, BUDGET, materialize(talk_plans.talk.boundaries(s), "boundaries"), padding=0.5)


def full_run(spark, sf: str) -> DataFrame:
    """Metadata of the clips of the whole run."""
    m = _full(spark, sf)[1]
    return m.select("video_id", "clip_id", "clip_number", "title", "description", "content_type", *r6("cut_start", "cut_end", "size_mb", "thumbnail_time"), "thumbnail", *[F.round(f"scores.{c}", 6).alias(c) for c in ("ai_score", "hybrid_score", "energy_score")])


def render_results(spark, sf: str) -> DataFrame:
    """Rows of a batch of which some clips lie behind their video's end."""
    v = local_duration(d.segments(spark, sf)).withColumnRenamed("duration", "video_seconds")
    clips = d.talk_clips(spark, sf).withColumn("start", F.col("start") + F.col("id") % 3 * 40).withColumn("end", F.col("end") + F.col("id") % 3 * 40)
    clips = clips.join(v, "video_id").withColumn("index", (F.col("id") + 1).cast("int")).withColumn("title", F.lit(None).cast("string")).withColumn("input", F.lit("in.mp4")).withColumn("audio_input", F.lit("in.wav"))
    r = platforms.render(clips, F.col("index") * 100003, padding=0.5, audio=True)
    return r.select("video_id", "index", "clip_id", "success", "error", F.array_join("args", " ").alias("args"), "size_mb")


def render_totals(spark, sf: str) -> DataFrame:
    k = F.col("l_partkey")
    rows = d.table(spark, sf, "lineitem").select((k % 7 != 0).alias("success"), F.when(k % 7 != 0, (k % 64) / 4.0).alias("size_mb"))
    return platforms.render_totals(rows)


def media_arguments(spark, sf: str) -> DataFrame:
    """Arguments for a picture and for the sound of each customer's video."""
    i = F.col("c_custkey")
    kind = F.element_at(F.array(*map(F.lit, ("mp3", "wav", "aac", "m4a", "flac", "ogg"))), (i % 6 + 1).cast("int"))
    c = d.table(spark, sf, "customer")
    joined = lambda a: F.array_join(a, " ")
    return c.select(i.alias("video"), joined(platforms.thumbnail_arguments(i / 8.0, F.lit("v.mp4"), F.lit("t.jpg"), width=640)).alias("thumbnail"), joined(platforms.audio_arguments(F.lit("v.mp4"), F.concat(F.lit("a."), kind), kind, rate=16000, mono=True)).alias("audio"))


def plan_warnings(spark, sf: str) -> DataFrame:
    """Size warnings, each once."""
    return platforms.warnings(platforms.plan(_videos(spark, sf)))


def platform_texts(spark, sf: str) -> DataFrame:
    """What the preview says of each video on each platform."""
    return platforms.plan(_videos(spark, sf), "top").select("video", "platform", "description", "vf")


def chosen_clips(spark, sf: str) -> DataFrame:
    """The clips that a list names by their place."""
    ranked = scoring.top(d.clips(spark, sf), "interest_score", 1 << 30).withColumnRenamed("rank", "index")
    return platforms.chosen(ranked, "1, 3,x,5").select("video_id", "index", "id")


def ranked_signals(spark, sf: str) -> DataFrame:
    """Multi-signal scores under weights of one's own, to two places, and the rank by them."""
    m = scoring.multi_signal(d.clips(spark, sf), d.energy_segments(spark, sf), d.cuts(spark, sf), (5.0, 3.0, 3.0))
    return scoring.ranked_scores(m).select("video_id", "id", "rank", "combined")


def scored_run(spark, sf: str) -> DataFrame:
    """The older run, with the names of its files."""
    s = materialize(d.segments(spark, sf), "segments")
    r = pipelines.scored_run(s, d.energy_segments(spark, sf), d.cuts(spark, sf), 4, least=SHORT, most=LONG, budget=BUDGET)
    return r.select("video_id", "rank", "id", *r6("start", "end", "combined"), "title", "files.*")


def option_checks(spark, sf: str) -> DataFrame:
    """Errors of options, titles of error codes, masked values, presets and colours, one row an order."""
    k = F.col("o_orderkey")
    o = d.table(spark, sf, "orders")
    text = lambda x: x.cast("string")
    pick = lambda n, *xs: F.element_at(F.array(*map(F.lit, xs)), (k % n + 1).cast("int"))
    errors = config.option_errors(num_clips=text(k % 130), min_duration=F.when(k % 5 != 0, text(k % 50)), max_duration=F.when(k % 7 != 0, text(k % 70)).otherwise("many"), padding=text(k % 14))
    key = F.when(k % 3 == 0, F.concat(F.lit("sk-"), F.repeat(F.lit("x"), (k % 60).cast("int")))).when(k % 3 == 1, "other")
    return o.select(
        "o_orderkey", F.array_join(errors, ",").alias("errors"), config.key_error(key).alias("key_error"), config.masked(key).alias("shown"), config.error_title(pick(4, "preflight", "processing", "system", "none"), pick(3, "TIMEOUT", "DISK_FULL", "INVALID_OPTION")).alias("title"),
        config.preset(pick(4, "short", "medium", "long", "own"))["high"].alias("longest"), config.colour(pick(5, "White", "black", "YELLOW", "red", "teal")).alias("colour"), display.padded(pick(2, "ab", "abcdefgh"), 5).alias("padded"), display.megabytes(k * 1000).alias("mb"), display.megabytes(k * 1000, True).alias("mb_decimal"),
    )


def run_progress(spark, sf: str) -> DataFrame:
    """Completed stages of each run as a part of all, and a summary of what failed."""
    e = d.frames(spark, sf).select(F.col("video_id").alias("run"), F.col("t").alias("at"), F.col("event_id").alias("seq"), F.col("event_type").alias("stage"), F.col("value").alias("progress"), (F.col("event_id") % 13 == 0).alias("failed"))
    states = editorial.stage_states(e)
    return editorial.run_progress(states).select("run", F.round("overall", 6).alias("overall"), "failed", "summary")


def _digest(prompt: str) -> str:
    """Stands in for a service."""
    return f"{hashlib.md5(prompt.encode()).hexdigest()}:{len(prompt)}"


def recorded_answers(spark, sf: str) -> DataFrame:
    """Whole texts as prompts, asked through a ledger."""
    prompts = d.table(spark, sf, "documents").select("doc_id", F.col("text").alias("prompt"))
    return ledger.recorded(_digest, scratch(spark, "ledger"))(prompts).select("doc_id", "response", "attempts")


QUERIES = {
    f.__name__: f
    for f in (model_clips, model_moments, model_thoughts, thought_expansion, model_looks, four_layer_run, layer_usage, aligned_flags, full_run, render_results, render_totals, media_arguments, plan_warnings, platform_texts, chosen_clips, ranked_signals, scored_run, option_checks, run_progress, recorded_answers)
}

_CHUNKS = (
    talk_plans._B
    + f""",
pos AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY seg_id) AS place, '[' || {talk_plans._TIME} || '] ' || trim(text) AS line, length('[' || {talk_plans._TIME} || '] ' || text || chr(10)) // 4 AS tok FROM segments),
ka AS (SELECT video_id, list(tok ORDER BY place) AS ts, count(*) AS n FROM pos GROUP BY video_id),
fa AS (SELECT video_id, 1::BIGINT AS i, 1::BIGINT AS first, 0::HUGEINT AS used, 0::BIGINT AS chunk FROM ka
  UNION ALL SELECT f.video_id, i + 1, CASE WHEN hit THEN i - carry ELSE first END, CASE WHEN hit THEN coalesce(list_sum(ts[i - carry:i - 1]), 0) ELSE used END + ts[i], chunk + hit::INT
  FROM (SELECT f.*, ka.ts, ka.n, used + ka.ts[i] > {BUDGET} AND i > first AS hit, floor((i - first) * 0.1::DOUBLE)::BIGINT AS carry FROM fa f JOIN ka USING (video_id)) f WHERE i <= n),
ch AS (SELECT video_id, chunk, min(first) AS a, max(i) - 1 AS b FROM fa WHERE i > 1 GROUP BY ALL),
nc AS (SELECT video_id, count(*) AS chunks FROM ch GROUP BY ALL),
pr AS (SELECT c.video_id, c.chunk, any_value(n.chunks) AS chunks, length(string_agg(line, chr(10) ORDER BY place)) AS plen FROM ch c JOIN nc n USING (video_id) JOIN pos p ON p.video_id = c.video_id AND p.place BETWEEN c.a AND c.b GROUP BY ALL)"""
)


def _lines_of(every: int, name: str) -> str:
    return f"""{name} AS (SELECT c.video_id, c.chunk, pr.chunks, floor(p.start)::BIGINT AS tm, length(line) AS n, row_number() OVER (PARTITION BY c.video_id, c.chunk ORDER BY place) - 1 AS k
  FROM ch c JOIN pr USING (video_id, chunk) JOIN pos p ON p.video_id = c.video_id AND p.place BETWEEN c.a AND c.b WHERE plen % 11 <> 0 AND length(line) % {every} = 0)"""


def _det(n: int) -> str:
    """Clips that the stand-in finds (det: video_id, rank, name, start, end, title, reason, score)."""
    return (
        _CHUNKS
        + f""",
{_lines_of(3, "cl")},
raw_clips AS (SELECT video_id, chunks, chunk * 100000 + k + 1 AS id, k, tm::DOUBLE AS start, (tm + 15 + n % 40)::DOUBLE AS "end", 'clip at ' || tm AS title, 'line of ' || n AS reason, n * 7 % 100 / 100.0::DOUBLE AS score FROM cl WHERE 15 + n % 40 BETWEEN {SHORT} AND {LONG}),
long_clips AS (SELECT * FROM raw_clips WHERE chunks > 1),
{_fold("0.7", "long_clips", "c_")},
det AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY id) AS rank, printf('clip_%03d', k + 1) AS name, start, "end", title, reason, score FROM raw_clips WHERE chunks = 1
  UNION ALL SELECT video_id, rank, printf('clip_%03d', rank), start, "end", title, reason, score FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, start, id) AS rank FROM c_kept) WHERE rank <= {n})"""
    )


_MOM = (
    _CHUNKS
    + f""",
{_lines_of(4, "ml")},
raw_moments AS (SELECT video_id, chunks, chunk * 100000 + k AS id, tm::DOUBLE AS start, (tm + 10 + n % 30)::DOUBLE AS "end", 'idea at ' || tm AS idea, n * 13 % 100 / 100.0::DOUBLE AS score FROM ml),
long_moments AS (SELECT * FROM raw_moments WHERE chunks > 1),
{_fold("0.5", "long_moments", "m_")},
mom AS (SELECT video_id, printf('moment_%03d', rank) AS id, start AS rs, "end" AS re, idea, score FROM (
  SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, id) AS rank, start, "end", idea, score FROM raw_moments WHERE chunks = 1
  UNION ALL SELECT * FROM (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, start, id) AS rank, start, "end", idea, score FROM m_kept) WHERE rank <= @n@))"""
)
_TEXT = lambda source, a, b: f"SELECT m.video_id, m.id, length(string_agg(trim(s.text), ' ' ORDER BY seg_id)) AS n, string_agg(trim(s.text), ' ' ORDER BY seg_id) AS t FROM {source} m JOIN segments s ON s.video_id = m.video_id AND s.start < m.{b} AND s.\"end\" > m.{a} GROUP BY ALL"
_THO = (
    _MOM
    + """,
cx AS (SELECT m.video_id, m.id, length(string_agg(trim(s.text), ' ' ORDER BY seg_id)) AS n FROM mom m JOIN segments s ON s.video_id = m.video_id AND s.start >= (rs + re) / 2 - 60 AND s."end" <= (rs + re) / 2 + 60 GROUP BY ALL),
tho AS (SELECT m.*, greatest(rs - n % 7, 0)::DOUBLE AS s0, (re + n % 11)::DOUBLE AS e0, n % 100 / 100.0::DOUBLE AS confidence, 'thought of ' || n AS summary FROM mom m JOIN cx USING (video_id, id))"""
)
_LOOK = (
    _THO
    + f""",
x1 AS ({_TEXT("tho", "s0", "e0")}),
l1 AS (SELECT t.*, s0 + coalesce(n, 0) % 5 - 2 AS s1, e0 + coalesce(n, 0) % 7 - 3 AS e1, coalesce(n, 0) * 37 % 100 / 100.0::DOUBLE AS c1, CASE WHEN coalesce(n, 0) % 3 = 0 THEN 'needs_context' END AS r1 FROM tho t LEFT JOIN x1 USING (video_id, id)),
x2 AS ({_TEXT("l1", "s1", "e1")}),
t2 AS (SELECT t.*, s1 + coalesce(n, 0) % 5 - 2 AS s2, e1 + coalesce(n, 0) % 7 - 3 AS e2, coalesce(n, 0) * 37 % 100 / 100.0::DOUBLE AS c2, CASE WHEN coalesce(n, 0) % 3 = 0 THEN 'needs_context' END AS r2 FROM l1 t LEFT JOIN x2 USING (video_id, id)),
{_GATE}"""
)
_ENERGY = ", ".join(["pairs2 AS (SELECT c.video_id, c.rank, e.energy_score, (least(c.\"end\", e.\"end\") - greatest(c.start, e.start)) / (c.\"end\" - c.start) AS ratio FROM det c JOIN energy_segments e ON c.video_id = e.video_id AND e.start < c.\"end\" AND c.start < e.\"end\")", "sums2 AS (SELECT video_id, rank, max(energy_score) AS m, avg(energy_score) AS a, sum(ratio) AS r FROM pairs2 WHERE ratio > 0.1::DOUBLE GROUP BY ALL)"])
_FULL = f"""{_det(8)}, {_ENERGY},
hy AS (SELECT d.*, coalesce(m, 0) AS max_energy, least(score * (1 + 0.3::DOUBLE * coalesce(0.5::DOUBLE * m + 0.3::DOUBLE * a + 0.2::DOUBLE * least(r, 1), 0)), 1) AS hybrid FROM det d LEFT JOIN sums2 USING (video_id, rank)),
top4 AS (SELECT * RENAME (rank AS found) FROM hy),
best4 AS (SELECT *, found AS id FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY hybrid DESC, found) AS rank FROM top4) WHERE rank <= 4),
{talk_plans._aligned_sql("best4", int(SHORT), int(LONG))},
two AS (SELECT * FROM aligned WHERE rank <= 2),
tx AS ({_TEXT("two", "s5", "e5")}),
named AS (SELECT w.*, CASE WHEN (sb IS NOT NULL OR eb IS NOT NULL) AND coalesce(t, '') <> '' THEN CASE WHEN n > 60 THEN left(t, 57) || '...' ELSE t END ELSE title END AS new_title, d.seconds FROM two w LEFT JOIN tx USING (video_id, id) JOIN (SELECT video_id, arg_max("end", seg_id) AS seconds FROM segments GROUP BY video_id) d USING (video_id)),
cut AS (SELECT *, {talk_plans._SLUG("new_title")} || '_' || printf('%03d', rank) || '_' || {talk_plans._NAME("s5")} || '-' || {talk_plans._NAME("e5")} AS clip_id, greatest(s5 - 0.5::DOUBLE, 0) AS a, least(e5 + 0.5::DOUBLE, seconds) AS b FROM named)"""
_KINDS = "(['mp3', 'wav', 'aac', 'm4a', 'flac', 'ogg'])[c_custkey % 6 + 1]"
_S3 = lambda x: f"printf('%.3f', round(({x})::DECIMAL(18, 6), 3)::DOUBLE)"
_NUMBER_ERROR = lambda name, x, low, high: f"CASE WHEN {x} IS NULL THEN NULL WHEN try_cast({x} AS DOUBLE) IS NULL THEN '{name}:not_a_number' WHEN try_cast({x} AS DOUBLE) < {low} THEN '{name}:too_small' WHEN try_cast({x} AS DOUBLE) > {high} THEN '{name}:too_large' END"
_TITLES = "CASE kind " + " ".join(f"WHEN '{k}' THEN CASE code " + " ".join(f"WHEN '{c}' THEN '{t}'" for c, t in titles.items()) + f" ELSE '{other}' END" for k, (titles, other) in config.TITLES.items()) + " END"
ORACLE = {
    "recorded_answers": "SELECT doc_id, md5(text) || ':' || length(text) AS response, (text IS NOT NULL)::BIGINT AS attempts FROM documents",
    "model_clips": _det(CLIPS) + """ SELECT video_id, rank, name AS id, start, "end", score AS interest_score, title, reason, 'talk' AS content_type FROM det""",
    "model_moments": _MOM.replace("@n@", str(MOMENTS)) + " SELECT video_id, id, rs AS rough_start, re AS rough_end, score AS interest_score, idea AS core_idea, 'general' AS content_type FROM mom",
    "model_thoughts": _THO.replace("@n@", str(MOMENTS)) + " SELECT video_id, id, s0 AS expanded_start, e0 AS expanded_end, confidence, summary AS thought_summary FROM tho",
    "thought_expansion": _THO.replace("@n@", str(MOMENTS)) + " SELECT count(*) AS thoughts_analyzed, round(avg((e0 - s0) / (re - rs)), 4) AS avg_expansion_ratio FROM tho",
    "model_looks": _LOOK.replace("@n@", str(MOMENTS)) + " SELECT video_id, id, verdict, reason AS rejection_reason, round(s, 6) AS refined_start, round(e, 6) AS refined_end, round(c, 6) AS standalone_score FROM gated",
    "four_layer_run": _LOOK.replace("@n@", "7") + f""", ok AS (SELECT * FROM gated WHERE verdict = 'PASS'), x3 AS ({_TEXT("ok", "s", "e")}),
        pk AS (SELECT o.*, n, t, list_filter(string_split(t, ' '), lambda w: w <> '') AS ws, row_number() OVER (PARTITION BY video_id ORDER BY 0.6::DOUBLE * score + 0.4::DOUBLE * c DESC, id) AS rank FROM ok o JOIN x3 USING (video_id, id) WHERE t <> '')
        SELECT video_id, rank, printf('clip_%03d', rank) AS id, s AS start, e AS "end", e - s AS duration, score AS interest_score, CASE WHEN n > 60 THEN left(t, 57) || '...' ELSE t END AS title, len(ws) || ' words' AS reason, array_to_string(list_transform(ws[1:5], lambda w: '#' || w), ' ') AS hashtags,
          greatest(s, least(e, s + n % 90 - 5)) AS thumbnail_time, confidence, verdict FROM pk WHERE rank <= 3""",
    "layer_usage": _CHUNKS + """, mt AS (SELECT c.video_id, c.chunk, place, floor(p.start)::BIGINT AS tm, length(line) AS n FROM ch c JOIN pos p ON p.video_id = c.video_id AND p.place BETWEEN c.a AND c.b),
        js AS (SELECT video_id, chunk, string_agg('{"rough_start":' || tm || ',"rough_end":' || (tm + 10 + n % 30) || ',"core_idea":"idea at ' || tm || '","why_interesting":"length","interest_score":' || (n * 13 % 100 / 100.0::DOUBLE)::VARCHAR || '}', ',') FILTER (n % 4 = 0) AS m,
          string_agg('{"start_time":' || tm || ',"end_time":' || (tm + 15 + n % 40) || ',"title":"clip at ' || tm || '","reason":"line of ' || n || '","interest_score":' || (n * 7 % 100 / 100.0::DOUBLE)::VARCHAR || ',"content_type":"talk"}', ',') FILTER (n % 3 = 0) AS c FROM mt GROUP BY ALL),
        us AS (SELECT 1 AS layer, plen // 4 AS i, (length(coalesce(m, '')) + 2) // 4 AS o FROM pr JOIN js USING (video_id, chunk) WHERE plen % 11 <> 0 UNION ALL SELECT 2, plen // 4, (length(coalesce(c, '')) + 2) // 4 FROM pr JOIN js USING (video_id, chunk) WHERE plen % 11 <> 0)
        SELECT coalesce(layer, 0)::INT AS layer, count(*) AS calls, sum(i)::BIGINT AS tokens_in, sum(o)::BIGINT AS tokens_out, round(sum(i) / 1000000.0::DOUBLE * 2.5::DOUBLE + sum(o) / 1000000.0::DOUBLE * 10.0::DOUBLE, 6) AS dollars FROM us GROUP BY ROLLUP (layer)""",
    "aligned_flags": talk_plans._ALIGN + f""", tx AS ({_TEXT("aligned", "s5", "e5")}),
        db AS (SELECT DISTINCT b.video_id, b.time FROM bounds b WHERE EXISTS (SELECT 1 FROM segments s WHERE s.video_id = b.video_id AND abs(s.start + 0.4::DOUBLE + s.seg_id % 5 - b.time) < 1))
        SELECT a.video_id, a.id, round(s5, 6) AS start, round(e5, 6) AS "end", sb IS NOT NULL OR eb IS NOT NULL AS professionally_aligned, db.time IS NOT NULL AS on_cut, CASE WHEN (sb IS NOT NULL OR eb IS NOT NULL) AND coalesce(t, '') <> '' THEN CASE WHEN n > 60 THEN left(t, 57) || '...' ELSE t END ELSE 'clip ' || a.id END AS title, 'clip ' || a.id AS original_title
        FROM aligned a LEFT JOIN tx ON tx.video_id = a.video_id AND tx.id = a.id LEFT JOIN db ON db.video_id = a.video_id AND db.time = a.s5""",
    "full_run": _FULL + """ SELECT video_id, clip_id, rank::INT AS clip_number, new_title AS title, reason AS description, 'talk' AS content_type, round(a, 6) AS cut_start, round(b, 6) AS cut_end, round(round((b - a) * 1000)::BIGINT * 125 / 1048576.0::DOUBLE, 2) AS size_mb, round((s5 + e5) / 2, 6) AS thumbnail_time, clip_id || '_thumb.jpg' AS thumbnail,
        round(score, 6) AS ai_score, round(hybrid, 6) AS hybrid_score, round(max_energy, 6) AS energy_score FROM cut WHERE b > a""",
    "render_results": f"""WITH {d.SQL.strip()}, sec AS (SELECT video_id, arg_max("end", seg_id) AS seconds FROM segments GROUP BY video_id),
        c AS (SELECT video_id, id + 1 AS i, start + id % 3 * 40 AS start, "end" + id % 3 * 40 AS "end", seconds FROM talk_clips JOIN sec USING (video_id)),
        n AS (SELECT *, 'clip_' || printf('%03d', i) || '_' || {talk_plans._NAME("start")} || '-' || {talk_plans._NAME('"end"')} AS clip_id, greatest(start - 0.5::DOUBLE, 0) AS a, least("end" + 0.5::DOUBLE, seconds) AS b FROM c)
        SELECT video_id, i::INT AS "index", clip_id, b > a AS success, CASE WHEN b <= a THEN 'Invalid clip duration: start=' || {_S3("a")} || ', end=' || {_S3("b")} END AS error,
        CASE WHEN b > a THEN '-ss ' || {_S3("a")} || ' -i in.mp4 -ss ' || {_S3("a")} || ' -i in.wav -t ' || {_S3("b - a")} || ' -map 0:v -map 1:a -c:v libx264 -crf 23 -preset medium -c:a aac -b:a 128k -movflags +faststart -y clips/' || clip_id || '.mp4' END AS args, CASE WHEN b > a THEN round(i * 100003 / 1048576.0::DOUBLE, 2) END AS size_mb FROM n""",
    "render_totals": "SELECT count_if(l_partkey % 7 <> 0)::BIGINT AS succeeded, count_if(l_partkey % 7 = 0)::BIGINT AS failed, round(sum(l_partkey % 64 / 4.0::DOUBLE) FILTER (l_partkey % 7 <> 0), 1) AS total_mb FROM lineitem",
    "media_arguments": f"""SELECT c_custkey AS video, '-ss ' || {_S3("c_custkey / 8.0::DOUBLE")} || ' -i v.mp4 -frames:v 1 -vf scale=640:-1 -y t.jpg' AS thumbnail, '-i v.mp4 -vn -acodec ' || CASE {_KINDS} WHEN 'wav' THEN 'pcm_s16le' WHEN 'aac' THEN 'aac' WHEN 'm4a' THEN 'aac' WHEN 'flac' THEN 'flac' ELSE 'libmp3lame' END || CASE WHEN {_KINDS} = 'wav' THEN '' ELSE ' -b:a 192k' END || ' -ar 16000 -ac 1 -y a.' || {_KINDS} AS audio FROM customer""",
    "chosen_clips": f"WITH {d.SQL.strip()} SELECT video_id, \"index\", id FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY interest_score DESC, id) AS \"index\" FROM clips) WHERE \"index\" IN (1, 3, 5)",
    "ranked_signals": _PAIRS + """, au AS (SELECT video_id, id, avg(energy_score) AS a FROM pairs GROUP BY ALL), vi AS (SELECT c.video_id, c.id, count(*) AS n FROM clips c JOIN cuts u ON c.video_id = u.video_id AND u.time BETWEEN c.start AND c."end" GROUP BY ALL),
        x AS (SELECT c.video_id, c.id, round((interest_score * (5 / 11.0::DOUBLE) + coalesce(a, 0.5::DOUBLE) * (3 / 11.0::DOUBLE) + CASE WHEN c.video_id NOT IN (SELECT video_id FROM cuts) THEN 0.5::DOUBLE WHEN n IS NULL THEN 0.3::DOUBLE WHEN n <= 2 THEN 0.6::DOUBLE ELSE 0.9::DOUBLE END * (3 / 11.0::DOUBLE))::DECIMAL(18, 9), 2)::DOUBLE AS combined FROM clips c LEFT JOIN au USING (video_id, id) LEFT JOIN vi USING (video_id, id))
        SELECT video_id, id, row_number() OVER (PARTITION BY video_id ORDER BY combined DESC, id) AS rank, combined FROM x""",
    "scored_run": f"""{_det(4)}, rk AS (SELECT *, round(score, 2) AS combined, row_number() OVER (PARTITION BY video_id ORDER BY round(score, 2) DESC, rank) AS q FROM det),
        so AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY combined DESC, q) AS p FROM rk WHERE "end" - start BETWEEN {SHORT} AND {LONG}),
        sf AS (SELECT video_id, p, [{{'s': start, 'e': "end"}}] AS kept, true AS took FROM so WHERE p = 1
          UNION ALL SELECT o.video_id, o.p, CASE WHEN hit THEN kept ELSE list_append(kept, {{'s': start, 'e': "end"}}) END, NOT hit FROM (
            SELECT o.*, f.kept, len(list_filter(f.kept, lambda k: greatest(least(k.e, o."end") - greatest(k.s, o.start), 0) / least(k.e - k.s, o."end" - o.start) > 0.3::DOUBLE)) > 0 AS hit FROM sf f JOIN so o ON o.video_id = f.video_id AND o.p = f.p + 1) o)
        SELECT * FROM (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY combined DESC, q) AS rank, name AS id, start, "end", combined, title, 'clips/clip_' || name || '_raw.mp4' AS raw, 'clips/clip_' || name || '_subtitled.mp4' AS subtitled, 'clips/clip_' || name || '_thumbnail.jpg' AS thumbnail FROM so JOIN sf USING (video_id, p) WHERE took) WHERE rank <= 4""",
    "run_progress": f"""WITH {d.SQL.strip()}, e AS (SELECT video_id AS run, event_type AS stage, value AS progress, event_id % 13 = 0 AS bad, row_number() OVER (PARTITION BY video_id, event_type, event_id % 13 = 0 ORDER BY t, event_id) AS k, row_number() OVER (PARTITION BY video_id ORDER BY t, event_id) AS o FROM frames),
        s AS (SELECT run, stage, min(o) FILTER (NOT bad) AS started, max(o) FILTER (NOT bad AND k > 1) AS lo, arg_max(least(greatest(progress, 0), 100), o) FILTER (NOT bad AND k > 1) AS lp, min(o) FILTER (NOT bad AND k > 1 AND progress >= 100) AS done, max(o) FILTER (NOT bad AND k > 1 AND progress >= 100) AS done_last, min(o) FILTER (bad) AS f1, max(o) FILTER (bad) AS f2 FROM e GROUP BY ALL),
        n AS (SELECT *, CASE WHEN started IS NOT NULL THEN lead(started) OVER (PARTITION BY run ORDER BY started NULLS LAST) END AS nx FROM s), c AS (SELECT *, nx IS NOT NULL AND NOT coalesce(done < nx, false) AND NOT coalesce(f1 < nx, false) AS closed FROM n),
        z AS (SELECT run, stage, CASE WHEN f2 IS NOT NULL AND (done_last IS NULL OR done_last < f2) THEN 'failed' WHEN closed OR done IS NOT NULL THEN 'completed' ELSE 'in_progress' END AS status, CASE WHEN closed AND (lo IS NULL OR lo < nx) THEN 100 ELSE coalesce(lp, 0) END AS progress FROM c),
        q AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY stage) AS p FROM z WHERE status = 'failed'), w AS (SELECT run, count(*) AS n, string_agg(p || '. ' || stage || chr(10) || '   stopped at ' || floor(progress)::BIGINT || '%', chr(10) ORDER BY p) AS many, any_value(stage || chr(10) || '   stopped at ' || floor(progress)::BIGINT || '%') AS one FROM q GROUP BY run)
        SELECT z.run, round(count_if(status = 'completed') / count(*) * 100, 6) AS overall, coalesce(any_value(n), 0)::INT AS failed, CASE coalesce(any_value(n), 0) WHEN 0 THEN '' WHEN 1 THEN any_value(one) ELSE any_value(n) || ' errors found:' || chr(10) || any_value(many) || chr(10) || 'Fix these issues and try again' END AS summary FROM z LEFT JOIN w USING (run) GROUP BY z.run""",
    "plan_warnings": _PLAN + " SELECT DISTINCT 'File size (' || printf('%.1f', round((size / 1000000.0::DOUBLE)::DECIMAL(18, 6), 1)::DOUBLE) || 'MB) exceeds ' || name || ' limit (' || printf('%.1f', largest / 1000000.0::DOUBLE) || 'MB)' AS warning FROM k WHERE size > largest",
    "platform_texts": _PLAN + f""" SELECT video, platform, CASE action WHEN 'scale' THEN 'Video will be scaled to fit (no cropping)' WHEN 'crop_horizontal' THEN 'Video will be cropped horizontally (~' || floor((1 - ta / sa) * 100 + 0.5)::BIGINT || '% removed from sides)' ELSE 'Video will be cropped vertically (~' || floor((1 - sa / ta) * 100 + 0.5)::BIGINT || '% removed from top/bottom)' END AS description, {_VF("0", "0")} AS vf FROM k""",
    "option_checks": f"""WITH o AS (SELECT o_orderkey AS k, (o_orderkey % 130)::VARCHAR AS a, CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 50)::VARCHAR END AS b, CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 70)::VARCHAR ELSE 'many' END AS c, (o_orderkey % 14)::VARCHAR AS p, CASE WHEN o_orderkey % 3 = 0 THEN 'sk-' || repeat('x', o_orderkey % 60) WHEN o_orderkey % 3 = 1 THEN 'other' END AS key,
          (['preflight', 'processing', 'system', 'none'])[o_orderkey % 4 + 1] AS kind, (['TIMEOUT', 'DISK_FULL', 'INVALID_OPTION'])[o_orderkey % 3 + 1] AS code FROM orders),
        e AS (SELECT *, {_NUMBER_ERROR("num_clips", "a", 1, 100)} AS ea, {_NUMBER_ERROR("min_duration", "b", 5, 600)} AS eb, {_NUMBER_ERROR("max_duration", "c", 10, 1200)} AS ec, {_NUMBER_ERROR("padding", "p", 0, 10)} AS ep FROM o)
        SELECT k AS o_orderkey, concat_ws(',', ea, eb, ec, ep, CASE WHEN eb IS NULL AND ec IS NULL AND try_cast(b AS DOUBLE) >= try_cast(c AS DOUBLE) THEN 'duration:min_not_below_max' END) AS errors, CASE WHEN coalesce(key, '') = '' THEN 'API_KEY_MISSING' WHEN key NOT LIKE 'sk-%' OR length(key) < 40 THEN 'API_KEY_INVALID' END AS key_error,
        CASE WHEN key LIKE 'sk-%' THEN '{config.KEY_SHOWN}' ELSE key END AS shown, {_TITLES} AS title, CASE k % 4 WHEN 0 THEN 30 WHEN 1 THEN 60 WHEN 2 THEN 120 END::INT AS longest, CASE k % 5 WHEN 1 THEN '000000' WHEN 2 THEN 'FFFF00' WHEN 3 THEN 'FF0000' ELSE 'FFFFFF' END AS colour, CASE WHEN k % 2 = 0 THEN 'ab   ' ELSE 'abcdefgh' END AS padded,
        round((k * 1000 / 1048576.0::DOUBLE)::DECIMAL(18, 9), 2)::DOUBLE AS mb, round((k * 1000 / 1000000.0::DOUBLE)::DECIMAL(18, 9), 2)::DOUBLE AS mb_decimal FROM e""",
}
