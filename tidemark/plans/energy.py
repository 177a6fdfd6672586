"""Queries over frames: normalised energy, mixes, averages, thresholds, peaks, energy segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import loudness, noise, signal
from tidemark.plans.ranking import r6
from tidemark.sources import domain as d
from tidemark.sources import sound
from tidemark.sources.shared import scratch


def _features(spark, sf):
    """Frames with three features; two are made from the event id."""
    f = d.frames(spark, sf)
    return f.withColumn("centroid", (F.col("event_id") * 7919 % 1000) / 1000.0).withColumn("zcr", (F.col("event_id") * 104729 % 1000) / 1000.0)


def energy_normalised(spark, sf: str) -> DataFrame:
    return d.frames(spark, sf).withColumn("x", signal.normalise("value")).select("video_id", "frame", *r6("x"))


def energy_mix(spark, sf: str) -> DataFrame:
    f = _features(spark, sf)
    n = {c: signal.normalise(c) for c in ("value", "centroid", "zcr")}
    f = f.withColumn("peak_energy", signal.peak_mix(n["value"], n["centroid"])).withColumn("timeline_energy", signal.timeline_mix(n["value"], n["centroid"], n["zcr"]))
    return f.select("video_id", "frame", *r6("peak_energy", "timeline_energy"))


def energy_smoothed(spark, sf: str) -> DataFrame:
    f = signal.smooth(signal.smooth(d.frames(spark, sf), "energy", 5, "odd"), "energy", 4, "even")
    return f.select("video_id", "frame", *r6("odd", "even"))


def energy_threshold(spark, sf: str) -> DataFrame:
    return signal.threshold(d.frames(spark, sf)).select("video_id", *r6("threshold"))


def energy_peaks(spark, sf: str) -> DataFrame:
    return signal.peaks(d.frames(spark, sf)).select("video_id", "frame", *r6("t", "height"))


def energy_segments(spark, sf: str) -> DataFrame:
    return signal.peak_segments(d.frames(spark, sf), 10.0, 60.0).select("video_id", "id", *r6("start", "end", "peak_time", "energy_score", "avg_energy"))


def energy_top(spark, sf: str) -> DataFrame:
    from tidemark.operators.scoring import top

    return top(signal.peak_segments(d.frames(spark, sf), 10.0, 60.0), "energy_score", 3).select("video_id", "id", "rank", *r6("energy_score"))


def energy_timeline(spark, sf: str) -> DataFrame:
    return signal.energy_timeline(_features(spark, sf), 5, "value").select("video_id", "frame", *r6("t", "combined"))


def _samples(spark, sf):
    """Each user's values in order as samples."""
    e = d.frames(spark, sf).select("video_id", F.struct("frame", (F.col("value") / 512.0 - 0.06).alias("x")).alias("f"))
    return e.groupBy("video_id").agg(F.transform(F.array_sort(F.collect_list("f")), lambda f: f["x"]).alias("samples")).withColumn("rate", F.lit(8))


def frame_features(spark, sf: str) -> DataFrame:
    """Level, centroid and crossings of frames of eight samples, four apart."""
    return signal.frame_features(_samples(spark, sf), 8, 4).select("video_id", "frame", *r6("t", "rms", "centroid", "zcr"))


def _blocks(spark, sf, size: int = 16, rate: int = 8):
    """The same samples in blocks."""
    f = d.frames(spark, sf).select("video_id", F.expr(f"frame div {size} * {size}").alias("first"), F.struct("frame", (F.col("value") / 512.0 - 0.06).alias("x")).alias("f"))
    return f.groupBy("video_id", "first").agg(F.transform(F.array_sort(F.collect_list("f")), lambda f: f["x"]).alias("samples")).withColumn("rate", F.lit(rate))


def frame_features_blocks(spark, sf: str) -> DataFrame:
    """The same features of the same samples in blocks of sixteen."""
    return signal.frame_features(_blocks(spark, sf), 8, 4).select("video_id", "frame", *r6("t", "rms", "centroid", "zcr"))


def wave_blocks(spark, sf: str) -> DataFrame:
    """Samples written as WAV files, two or more for each video, and read back in blocks of sixteen."""
    path = scratch(spark, "waves")
    sound.write_waves(_blocks(spark, sf), path, 64)
    whole = F.transform("samples", lambda x: F.round(x * 32768).cast("long"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    return sound.read_waves(spark, path, 16).select("video_id", "first", F.size("samples").cast("long").alias("n"), total(whole).alias("total"), total(F.transform(whole, lambda x, i: x * (i + 1))).alias("weighted"))


#: Samples a second of the loudness queries, and the frequencies of their weighting, which lie lower than by ear.
RATE = 40


def _weights(rate: int):
    return loudness.high_shelf(rate, at=5.0), loudness.high_pass(rate, at=1.0)


def gated_loudness(spark, sf: str) -> DataFrame:
    """Gating blocks, those past the gates, and loudness of samples in blocks of sixteen."""
    return loudness.gated_loudness(_blocks(spark, sf, 16, RATE), _weights).select("video_id", "blocks", "gated", *r6("loudness"))


def louder_blocks(spark, sf: str) -> DataFrame:
    """Sums of the samples of each block, an eighth as loud, brought to the target loudness."""
    quiet = _blocks(spark, sf, 16, RATE).withColumn("samples", F.transform("samples", lambda x: x / 8))
    return loudness.louder(quiet, weights=_weights).select("video_id", "first", F.aggregate("samples", F.lit(0.0), lambda s, x: s + x).alias("total")).select("video_id", "first", *r6("total"))


def reduced_noise(spark, sf: str) -> DataFrame:
    """Sums of each block's samples, plain and weighted by place, after noise reduction with spectra of eight samples."""
    out = noise.reduced(_blocks(spark, sf), "gentle", noise.Frames(8, 4, 1, 1))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    sums = out.select("video_id", "first", total(F.col("samples")).alias("total"), total(F.transform("samples", lambda x, i: x * (i + 1))).alias("weighted"))
    return sums.select("video_id", "first", *r6("total", "weighted"))


def sample_levels(spark, sf: str) -> DataFrame:
    """Level and sum of samples as they are, compressed, made louder and lifted; whether they should be enhanced."""
    x = F.col("samples")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    s = _samples(spark, sf).withColumn("level", signal.rms(x)).withColumn("quiet", F.transform(x, lambda v: v / 16))
    out = s.select("video_id", "level", total(signal.compress(F.transform(x, lambda v: v * 4))).alias("compressed"), total(signal.louder(x)).alias("louder"), total(signal.lifted(F.col("quiet"))).alias("lifted"), signal.should_enhance(F.col("level"), F.col("video_id") * 50.0).alias("enhance"))
    return out.select("video_id", *r6("level", "compressed", "louder", "lifted"), "enhance")


QUERIES = {f.__name__: f for f in (energy_normalised, energy_mix, energy_smoothed, energy_threshold, energy_peaks, energy_segments, energy_top, energy_timeline, frame_features, frame_features_blocks, wave_blocks, gated_loudness, louder_blocks, reduced_noise, sample_levels)}

_B = f"""WITH RECURSIVE {d.SQL.strip()},
thr AS (SELECT video_id, greatest(quantile_cont(energy, 0.7), 0.5::DOUBLE) AS threshold FROM frames GROUP BY video_id)"""
_NORM = lambda x: f"CASE WHEN max({x}) OVER v - min({x}) OVER v < 1e-10 THEN 0.0::DOUBLE ELSE ({x} - min({x}) OVER v) / (max({x}) OVER v - min({x}) OVER v) END"
_SMOOTH = lambda k, a, b: f"(sum(energy) OVER (o ROWS BETWEEN {a} PRECEDING AND {b} FOLLOWING) + greatest({a} - frame, 0) * first_value(energy) OVER w + greatest(frame + {b} - (count(*) OVER w - 1), 0) * last_value(energy) OVER w) / {k}"
_PEAKS = _B + """,
isl AS (SELECT *, sum(new) OVER (PARTITION BY video_id ORDER BY frame) AS g FROM (SELECT *, (energy IS DISTINCT FROM lag(energy) OVER (PARTITION BY video_id ORDER BY frame))::INT AS new FROM frames)),
flat AS (SELECT video_id, g, min(frame) AS a, max(frame) AS b, any_value(energy) AS h FROM isl GROUP BY ALL),
tops AS (SELECT video_id, (a + b) // 2 AS frame, h FROM (SELECT *, lag(h) OVER o AS l, lead(h) OVER o AS r FROM flat WINDOW o AS (PARTITION BY video_id ORDER BY g)) WHERE l < h AND r < h),
tall AS (SELECT t.*, row_number() OVER (PARTITION BY video_id ORDER BY h DESC, frame DESC) AS p FROM tops t JOIN thr USING (video_id) WHERE h >= threshold),
f AS (SELECT video_id, p, [frame] AS kept, true AS took FROM tall WHERE p = 1
  UNION ALL SELECT t.video_id, t.p, CASE WHEN hit THEN kept ELSE list_append(kept, frame) END, NOT hit FROM (SELECT t.*, f.kept, len(list_filter(f.kept, lambda k: abs(k - t.frame) < 3)) > 0 AS hit FROM f JOIN tall t ON t.video_id = f.video_id AND t.p = f.p + 1) t),
spaced AS (SELECT tall.* FROM tall JOIN f USING (video_id, p) WHERE took),
prom AS (SELECT s.*, (SELECT min(x.energy) FROM frames x WHERE x.video_id = s.video_id AND x.frame BETWEEN coalesce((SELECT max(y.frame) FROM frames y WHERE y.video_id = s.video_id AND y.frame < s.frame AND y.energy > s.h), -1) + 1 AND s.frame) AS l,
  (SELECT min(x.energy) FROM frames x WHERE x.video_id = s.video_id AND x.frame >= s.frame AND x.frame < coalesce((SELECT min(y.frame) FROM frames y WHERE y.video_id = s.video_id AND y.frame > s.frame AND y.energy > s.h), 1000000000)) AS r FROM spaced s),
peaks AS (SELECT p.video_id, p.frame, p.h, fr.t, row_number() OVER (PARTITION BY p.video_id ORDER BY p.frame) AS peak FROM prom p JOIN frames fr USING (video_id, frame) WHERE p.h - greatest(l, r) >= 0.1)"""
_SEGS = _PEAKS + """,
walk AS (SELECT p.*, coalesce((SELECT max(x.frame) FROM frames x WHERE x.video_id = p.video_id AND x.frame < p.frame AND x.energy < p.h * 0.5), -1) + 1 AS a,
  coalesce((SELECT min(x.frame) FROM frames x WHERE x.video_id = p.video_id AND x.frame > p.frame AND x.energy < p.h * 0.5), (SELECT max(frame) + 1 FROM frames x WHERE x.video_id = p.video_id)) - 1 AS b, (SELECT max(t) FROM frames x WHERE x.video_id = p.video_id) AS last_t FROM peaks p),
s1 AS (SELECT w.*, x.t AS s, y.t AS e FROM walk w JOIN frames x ON x.video_id = w.video_id AND x.frame = w.a JOIN frames y ON y.video_id = w.video_id AND y.frame = w.b),
s2 AS (SELECT *, CASE WHEN e - s < 10 THEN greatest(0, s - (10 - (e - s)) / 2) ELSE s END AS s2, CASE WHEN e - s < 10 THEN least(last_t, e + (10 - (e - s)) / 2) ELSE e END AS e2 FROM s1),
s3 AS (SELECT *, s2 + greatest((e2 - s2 - 60) / 2, 0) AS start, e2 - greatest((e2 - s2 - 60) / 2, 0) AS "end" FROM s2),
segs AS (SELECT *, (SELECT avg(energy) FROM frames x WHERE x.video_id = s3.video_id AND x.t >= s3.start AND x.t < s3."end") AS avg_energy FROM s3)"""
ORACLE = {
    "energy_normalised": _B + f" SELECT video_id, frame, round({_NORM('value')}, 6) AS x FROM frames WINDOW v AS (PARTITION BY video_id)",
    "energy_mix": _B + f""", k AS (SELECT *, (event_id * 7919 % 1000) / 1000.0::DOUBLE AS centroid, (event_id * 104729 % 1000) / 1000.0::DOUBLE AS zcr FROM frames),
        n AS (SELECT video_id, frame, {_NORM('value')} AS a, {_NORM('centroid')} AS b, {_NORM('zcr')} AS c FROM k WINDOW v AS (PARTITION BY video_id))
        SELECT video_id, frame, round(0.7::DOUBLE * a + 0.3::DOUBLE * b, 6) AS peak_energy, round(0.70::DOUBLE * a + 0.25::DOUBLE * b + 0.05::DOUBLE * c, 6) AS timeline_energy FROM n""",
    "energy_timeline": _B + f""", k AS (SELECT *, (event_id * 7919 % 1000) / 1000.0::DOUBLE AS centroid, (event_id * 104729 % 1000) / 1000.0::DOUBLE AS zcr FROM frames),
        n AS (SELECT video_id, frame, t, 0.70::DOUBLE * {_NORM('value')} + 0.25::DOUBLE * {_NORM('centroid')} + 0.05::DOUBLE * {_NORM('zcr')} AS energy FROM k WINDOW v AS (PARTITION BY video_id))
        SELECT video_id, frame, round(t, 6) AS t, round({_SMOOTH(5, 2, 2)}, 6) AS combined FROM n WINDOW o AS (PARTITION BY video_id ORDER BY frame), w AS (PARTITION BY video_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    "frame_features": _B + """, p AS (SELECT video_id, list_concat(list_concat([0.0::DOUBLE for _ in range(4)], list(value / 512.0::DOUBLE - 0.06::DOUBLE ORDER BY frame)), [0.0::DOUBLE for _ in range(4)]) AS x FROM frames GROUP BY video_id),
        fr AS (SELECT video_id, f, x[f * 4 + 1:f * 4 + 8] AS y FROM (SELECT video_id, x, unnest(range(0, 1 + (len(x) - 8) // 4)) AS f FROM p WHERE len(x) > 8)),
        s AS (SELECT video_id, f, y, unnest(range(0, 8)) AS n FROM fr),
        v AS (SELECT video_id, f, n, y[n + 1] AS x, y[n + 1] * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * n / 8)) AS h, CASE WHEN n < 7 THEN ((y[n + 1] < 0) <> (y[n + 2] < 0))::INT ELSE 0 END AS z FROM s),
        m AS (SELECT video_id, f, k, sqrt(sum(h * cos(2 * pi() * k * n / 8)) ** 2 + sum(h * sin(2 * pi() * k * n / 8)) ** 2) AS mag FROM v, (SELECT unnest(range(0, 5)) AS k) GROUP BY ALL),
        c AS (SELECT video_id, f, sum(mag * k) / sum(mag) AS centroid FROM m GROUP BY ALL), r AS (SELECT video_id, f, sqrt(avg(x * x)) AS rms, sum(z) / 8 AS zcr FROM v GROUP BY ALL)
        SELECT video_id, f AS frame, f * 4 / 8.0::DOUBLE AS t, round(rms, 6) AS rms, round(centroid, 6) AS centroid, zcr::DOUBLE AS zcr FROM r JOIN c USING (video_id, f)""",
    "sample_levels": _B + """, p AS (SELECT video_id, value / 512.0::DOUBLE - 0.06::DOUBLE AS x FROM frames), l AS (SELECT video_id, sqrt(avg(x * x)) AS level, sqrt(avg(x * x / 256)) AS low, sum(x) AS s, sum(greatest(-1, least(1, CASE WHEN abs(x * 4) > 0.3::DOUBLE THEN sign(x) * (0.3::DOUBLE + (abs(x * 4) - 0.3::DOUBLE) / 3) ELSE x * 4 END))) AS c FROM p GROUP BY video_id)
        SELECT video_id, round(level, 6) AS level, round(c, 6) AS compressed, round(CASE WHEN 20 * log10(level) < -21 THEN s * (0.7::DOUBLE * 10 ** ((-18 - 20 * log10(level)) / 20) + 0.3::DOUBLE) ELSE s END, 6) AS louder, round(CASE WHEN low < 0.04::DOUBLE THEN s / 16 * (0.08::DOUBLE / low) * 0.8::DOUBLE ELSE s / 16 END, 6) AS lifted, level < 0.01::DOUBLE OR level > 0.5::DOUBLE OR video_id * 50 > 4000 AS enhance FROM l""",
    "energy_smoothed": _B + f" SELECT video_id, frame, round({_SMOOTH(5, 2, 2)}, 6) AS odd, round({_SMOOTH(4, 2, 1)}, 6) AS even FROM frames WINDOW o AS (PARTITION BY video_id ORDER BY frame), w AS (PARTITION BY video_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "energy_threshold": _B + " SELECT video_id, round(threshold, 6) AS threshold FROM thr",
    "energy_peaks": _PEAKS + " SELECT video_id, frame, round(t, 6) AS t, round(h, 6) AS height FROM peaks",
    "energy_segments": _SEGS + """ SELECT video_id, printf('energy_%03d', peak) AS id, round(start, 6) AS start, round("end", 6) AS "end", round(t, 6) AS peak_time, round(h, 6) AS energy_score, round(avg_energy, 6) AS avg_energy FROM segs""",
    "energy_top": _PEAKS + """ SELECT video_id, id, rank, round(h, 6) AS energy_score FROM (SELECT *, printf('energy_%03d', peak) AS id, row_number() OVER (PARTITION BY video_id ORDER BY h DESC, peak) AS rank FROM peaks) WHERE rank <= 3""",
}
ORACLE["frame_features_blocks"] = ORACLE["frame_features"]
ORACLE["wave_blocks"] = _B + """, q AS (SELECT video_id, frame // 16 * 16 AS first, frame % 16 + 1 AS i, greatest(-32768, least(32767, round((value / 512.0::DOUBLE - 0.06::DOUBLE) * 32768)))::BIGINT AS x FROM frames)
    SELECT video_id, first, count(*) AS n, sum(x)::BIGINT AS total, sum(x * i)::BIGINT AS weighted FROM q GROUP BY ALL"""


def _loud_sql(scale: str) -> str:
    """Loudness in SQL: each filter a recursion over the samples, then both gates."""
    stage = lambda k, f: f"""{k} AS (SELECT video_id, frame, {f[0][0]!r}::DOUBLE * x AS y, {f[0][1] - f[1][1] * f[0][0]!r}::DOUBLE * x AS s, {f[0][2] - f[1][2] * f[0][0]!r}::DOUBLE * x AS u FROM {{}} WHERE frame = 0
      UNION ALL SELECT i.video_id, i.frame, {f[0][0]!r}::DOUBLE * i.x + r.s, {f[0][1]!r}::DOUBLE * i.x - {f[1][1]!r}::DOUBLE * ({f[0][0]!r}::DOUBLE * i.x + r.s) + r.u, {f[0][2]!r}::DOUBLE * i.x - {f[1][2]!r}::DOUBLE * ({f[0][0]!r}::DOUBLE * i.x + r.s) FROM {k} r JOIN {{}} i ON i.video_id = r.video_id AND i.frame = r.frame + 1)"""  # noqa: E731
    one, two = (stage(k, f).format(src, src) for k, f, src in zip(("w1", "w2"), _weights(RATE), ("xs", "ys"), strict=True))
    return f"""{_B}, xs AS (SELECT video_id, frame, (value / 512.0::DOUBLE - 0.06::DOUBLE) * {scale} AS x FROM frames), {one}, ys AS (SELECT video_id, frame, y AS x FROM w1), {two},
    len AS (SELECT video_id, count(*) AS n, CASE WHEN count(*) / 40.0::DOUBLE >= 0.4::DOUBLE THEN round_even((count(*) / 40.0::DOUBLE - 0.4::DOUBLE) / 0.1::DOUBLE, 0)::BIGINT + 1 ELSE 0 END AS blocks FROM xs GROUP BY video_id),
    z AS (SELECT l.video_id, b AS block, (SELECT sum(y * y) / 16 FROM w2 WHERE w2.video_id = l.video_id AND w2.frame >= b * 4 AND w2.frame < b * 4 + 16) AS power FROM (SELECT video_id, unnest(range(0, blocks)) AS b FROM len) l),
    a AS (SELECT *, -0.691::DOUBLE + 10 * log10(power) AS level FROM z WHERE power > 0 AND -0.691::DOUBLE + 10 * log10(power) >= -70),
    g AS (SELECT video_id, -10.691::DOUBLE + 10 * log10(avg(power)) AS gate FROM a GROUP BY video_id),
    loud AS (SELECT video_id, count(*) AS gated, -0.691::DOUBLE + 10 * log10(avg(power)) AS loudness FROM a JOIN g USING (video_id) WHERE level > gate AND level > -70 GROUP BY video_id)"""


ORACLE["gated_loudness"] = _loud_sql("1") + " SELECT video_id, blocks, coalesce(gated, 0) AS gated, round(loudness, 6) AS loudness FROM len LEFT JOIN loud USING (video_id)"
ORACLE["louder_blocks"] = _loud_sql("0.125::DOUBLE") + """, lv AS (SELECT video_id, sqrt(avg(x * x)) AS level FROM xs GROUP BY video_id),
    gain AS (SELECT video_id, CASE WHEN loudness IS NULL THEN CASE WHEN level > 0 AND level < 0.04::DOUBLE THEN 0.08::DOUBLE / level * 0.8::DOUBLE ELSE 1 END WHEN loudness < -21 THEN 0.7::DOUBLE * 10 ** ((-18 - loudness) / 20) + 0.3::DOUBLE ELSE 1 END AS gain FROM len JOIN lv USING (video_id) LEFT JOIN loud USING (video_id))
    SELECT video_id, frame // 16 * 16 AS first, round(sum(x) * any_value(gain), 6) AS total FROM xs JOIN gain USING (video_id) GROUP BY ALL"""
_HANN = "(0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * {} / 8))"
ORACLE["reduced_noise"] = _B + f""", xs AS (SELECT video_id, frame, value / 512.0::DOUBLE - 0.06::DOUBLE AS x FROM frames), len AS (SELECT video_id, count(*) AS n FROM xs GROUP BY video_id),
    smp AS (SELECT k.video_id, k, i, n, coalesce(x, 0) * {_HANN.format("i")} AS h FROM (SELECT video_id, n, unnest(range(-1, (n - 1) // 4 + 1)) AS k FROM len) k CROSS JOIN (SELECT unnest(range(0, 8)) AS i) LEFT JOIN xs ON xs.video_id = k.video_id AND xs.frame = k * 4 + i),
    spec AS (SELECT video_id, k, n, b, sum(h * cos(2 * pi() * b * i / 8)) AS re, -sum(h * sin(2 * pi() * b * i / 8)) AS im FROM smp, (SELECT unnest(range(0, 5)) AS b) GROUP BY ALL),
    lv AS (SELECT *, 20 * log10(greatest(sqrt(re * re + im * im), 1e-30)) AS db FROM spec),
    fl AS (SELECT video_id, b, list(floor(db) ORDER BY floor(db))[ceil(0.25::DOUBLE * count(*))::INT] + 1 AS floor FROM lv WHERE k >= 0 AND k * 4 // 16 = (k * 4 + 7) // 16 AND k * 4 + 7 < n AND db >= -150 GROUP BY video_id, b),
    cut AS (SELECT video_id, k, b, re * g AS re, im * g AS im FROM (SELECT lv.*, 1 - 0.8::DOUBLE * (1 - greatest(0, least(1, (db - coalesce(floor, -150) - 9) / 6))) AS g FROM lv LEFT JOIN fl USING (video_id, b))),
    back AS (SELECT video_id, k * 4 + i AS frame, i, sum((CASE WHEN b IN (0, 4) THEN 1 ELSE 2 END) * (re * cos(2 * pi() * b * i / 8) - im * sin(2 * pi() * b * i / 8))) / 8 AS y FROM cut, (SELECT unnest(range(0, 8)) AS i) GROUP BY ALL),
    done AS (SELECT video_id, frame, sum(y * {_HANN.format("i")}) / ({_HANN.format("(frame % 4)")} ** 2 + {_HANN.format("(frame % 4 + 4)")} ** 2) AS y FROM back GROUP BY video_id, frame)
    SELECT video_id, frame // 16 * 16 AS first, round(sum(y), 6) AS total, round(sum(y * (frame % 16 + 1)), 6) AS weighted FROM done JOIN xs USING (video_id, frame) GROUP BY ALL"""
