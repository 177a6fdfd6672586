import datetime
import itertools
import json
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions import config, display, text
from tidemark.operators import chunks, editorial, folds, joins, ledger, model, platforms, signal, talk
from tidemark.sources import files, shared
from tidemark.streaming import events


def one(spark, **columns):
    """The values of expressions."""
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_display_goldens(spark):
    n = lambda x: F.lit(float(x))
    r = one(spark, a=display.duration(n(45)), b=display.duration(n(150)), c=display.duration(n(4530)), d=display.duration(n(3600)), e=display.duration(n(59.6)), f=display.duration(n(119.6)), g=display.clock(n(4530)), h=display.file_size(F.lit(1536)), i=display.file_size(F.lit(500)), j=display.cost(n(0.19)), k=display.percentage(n(0.853)), l=display.progress_bar(n(0.8)), m=display.thousands(F.lit(1234567)), o=display.time_range(n(150), n(195)), p=display.rate(n(30), n(60), True))
    assert tuple(r) == ("45s", "2m 30s", "1h 15m 30s", "1h 0m", "60s", "1m 60s", "1:15:30", "1.5 KB", "500 B", "$0.19", "85.3%", "[████████░░] 80%", "1,234,567", "2:30 - 3:15", "30.0/min")


def test_text_goldens(spark):
    s = F.lit
    r = one(spark, a=text.mm_ss(s(125.5)), b=text.slug(s("Why Startups -- Fail?!")), c=text.slug(s("Éa ñb")), d=text.slug(s("?!")), e=text.slug(s("a" * 30 + " " + "b" * 30)), f=text.clip_name(s(1), s("why startups fail"), s(125.0), s(168.0)), g=text.clip_name(s(3), s(None).cast("string"), s(0.0), s(1.0)), h=text.title_case(s("how-to_learn")), i=text.srt_time(s(3661.5)), j=text.unquote(s('"a"')), k=text.unquote(s("'a\"")), l=text.unquote(s("''a"), False))
    assert tuple(r) == ("02:05", "why-startups-fail", "éa-ñb", "untitled", "a" * 30, "why-startups-fail_001_02m05s-02m48s", "clip_003_00m00s-00m01s", "How To Learn", "01:01:01,500", "a", "'a\"", "a")
    ends = one(spark, a=text.sentence_end(s("Yes.")), b=text.sentence_end(s('say "so"')), c=text.sentence_end(s('"')), d=text.sentence_end(s("")), e=text.transition_start(s("However, we")), f=text.transition_start(s("However long")), g=text.transition_start(s("nowhere")))
    assert tuple(ends) == (True, True, False, False, True, True, False)


def test_errors_and_parsing(spark):
    s = F.lit
    r = one(spark, a=display.is_transient(s("Socket hang up")), b=display.friendly(s("read ENOENT")), c=display.friendly(s("boom")), d=display.retry_wait(s("try again in 2.5s"), s(1)), e=display.retry_wait(s("x"), s(3)), f=display.error_line(s("a\nValueError: b\nc\n")), g=display.error_line(s("a\nb\n\n")), h=display.positions(s("1,x, 3,,5")), i=display.number_error(s("abc"), 1, 9), j=display.number_error(s("0"), 1, 9), k=display.number_error(s(None).cast("string"), 1), l=display.range_error(s(5), s(5)), m=display.is_video(s("/a.b/C.MP4")), n=display.config_kind(s("1.50")), o=display.config_kind(s("1.5")), p=display.config_kind(s("[1, 2]")), q=display.config_kind(s("true")))
    assert tuple(r) == (True, "File or directory not found.", "boom", 3.5, 16.0, "ValueError: b", "b", [1, 3, 5], "not_a_number", "too_small", None, "min_not_below_max", True, "string", "number", "json", "bool")


def survivors(rows: list[tuple], threshold: float) -> list[int]:
    """Ids that stay, from the rule itself: the first of the rows (by start, then id) is settled against those behind it,
    then the rest, less what it suppressed, by the same rule. rows: (start, end, score, id)."""
    if not rows:
        return []
    first, rest = rows[0], rows[1:]
    near = list(itertools.takewhile(lambda r: r[0] <= first[1], rest))
    same = [r for r in near if min(first[1], r[1]) - max(first[0], r[0]) > threshold * min(first[1] - first[0], r[1] - r[0])]
    better = next((k for k, r in enumerate(same) if r[2] > first[2]), None)
    gone = set(same[:better])
    return ([first[3]] if better is None else []) + survivors([r for r in rest if r not in gone], threshold)


def test_merge_duplicates(spark):
    rng = random.Random(4)
    rows = [(v, i, float(s := rng.randrange(60)), float(s + rng.randrange(1, 30)), rng.randrange(5) / 4) for v in range(20) for i in range(rng.randrange(1, 15))]
    got = folds.merge_duplicates(spark.createDataFrame(rows, "video_id long, id long, start double, end double, interest_score double"), 0.5).collect()
    want = {(v, i) for v in range(20) for i in survivors([(s, e, x, i) for s, i, e, x in sorted((s, i, e, x) for w, i, s, e, x in rows if w == v)], 0.5)}
    assert {(r.video_id, r.id) for r in got} == want
    # by hand: the later, better one wins, and what the first had suppressed before stays away
    rows = [(1, 1, 0.0, 10.0, 0.5), (1, 2, 1.0, 11.0, 0.4), (1, 3, 2.0, 12.0, 0.9), (1, 4, 11.5, 20.0, 0.1)]
    got = folds.merge_duplicates(spark.createDataFrame(rows, "video_id long, id long, start double, end double, interest_score double"), 0.5)
    assert sorted(r.id for r in got.collect()) == [3, 4]


def test_islands_and_running_values(spark):
    rng = random.Random(6)
    rows = [(v, i, s := rng.random() * 5000, s + rng.random() * 40) for v in range(2) for i in range(300)]
    d = spark.createDataFrame(rows, "video_id long, id long, start double, end double")
    got = {(r.video_id, r.id): r.island for r in joins.islands(d, ["start", "id"], F.col("end"), width=50.0).collect()}
    for v in range(2):
        reach = begin = None
        for _, i, s, e in sorted((r for r in rows if r[0] == v), key=lambda r: (r[2], r[1])):
            begin = s if reach is None or s >= reach else begin
            reach = e if reach is None else max(reach, e)
            assert got[v, i] == begin


def test_asof_without_a_distance(spark):
    rng = random.Random(7)
    left = [(rng.randrange(2), i, rng.random() * 9000) for i in range(80)]
    right = [(rng.randrange(2), i, rng.random() * 9000) for i in range(25)]
    a, b = spark.createDataFrame(left, "video_id long, id long, at double"), spark.createDataFrame(right, "video_id long, r long, time double")
    for forward in (False, True):
        for width in (7.0, 600.0):
            got = {x.id: x.n_r for x in joins.asof(a, b, "at", "time", ["r"], "n", forward=forward, width=width).collect()}
            for v, i, at in left:
                ok = [y for y in right if y[0] == v and (y[2] >= at if forward else y[2] <= at)]
                best = (min if forward else max)(ok, key=lambda y: y[2], default=None)
                assert got[i] == (best[1] if best else None)


def test_one_long_video_is_split(spark):
    """The as-of join deals one video's rows out by time: no task has them all."""
    a = spark.range(20000).select(F.lit(1).cast("long").alias("video_id"), F.col("id"), (F.col("id") * 1.0).alias("at"))
    b = spark.range(20000).select(F.lit(1).cast("long").alias("video_id"), F.col("id").alias("r"), (F.col("id") * 1.0 + 0.5).alias("time"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in joins.asof(a, b, "at", "time", ["r"], "n", within=10.0).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(sizes) < 8000


def test_far_ends_are_refused(spark):
    rows = spark.createDataFrame([(1, 0.0, 1e12)], "video_id long, start double, end double")
    with pytest.raises(Exception, match="bins"):
        rows.select(joins.bins(F.col("start"), F.col("end"), 24.0)).collect()
    back = spark.createDataFrame([(1, 5.0, 1.0), (1, None, 1.0)], "video_id long, start double, end double")
    assert back.select(joins.bins(F.col("start"), F.col("end"), 1.0)).count() == 0


def test_interval_and_asof_joins_against_loops(spark):
    rng = random.Random(5)
    left = [(rng.randrange(3), i, s := rng.random() * 100, s + rng.random() * 30) for i in range(60)]
    right = [(rng.randrange(3), i, s := rng.random() * 100, s + rng.random() * 30) for i in range(60)]
    a = spark.createDataFrame(left, "video_id long, id long, start double, end double")
    b = spark.createDataFrame(right, "video_id long, r long, r_start double, r_end double")
    got = sorted((x.id, x.r) for x in joins.overlap_join(a, b, 7.0).collect())
    assert got == sorted((x[1], y[1]) for x in left for y in right if x[0] == y[0] and x[2] < y[3] and y[2] < x[3])
    near = {x.id: x.n_r for x in joins.asof(a, b, "start", "r_start", ["r"], "n", within=5.0).collect()}
    for x in left:
        past = [y for y in right if y[0] == x[0] and y[2] <= x[2]]
        best = max(past, key=lambda y: y[2], default=None)
        assert near[x[1]] == (best[1] if best and x[2] - best[2] <= 5 else None)


def test_find_peaks():
    assert signal.find_peaks(np.array([0, 1, 0, 2, 2, 0, 0.5]), 0.5, 1, 0.1).tolist() == [1, 3]
    assert signal.find_peaks(np.array([0, 3, 0, 2, 0, 1, 0.0]), 0, 3, 0.1).tolist() == [1, 5]
    assert signal.find_peaks(np.array([5, 1, 2, 1, 5.0]), 0, 1, 1.5).tolist() == []
    assert signal.find_peaks(np.zeros(0), 0, 1, 0).tolist() == []


def test_energy_segments_keep_their_bounds(spark):
    from tidemark.plans import energy

    for r in energy.energy_segments(spark, "/root/testdata/sf0.001").collect():
        assert r.end > r.start and r.end - r.start <= 60 + 1e-6


def test_frame_features(spark):
    rate = 8000
    tone = [float(math.sin(2 * math.pi * 440 * i / rate)) for i in range(8192)]
    rows = signal.frame_features(spark.createDataFrame([(1, rate, tone), (2, rate, [])], "video_id long, rate int, samples array<float>")).collect()
    middle = rows[len(rows) // 2]
    assert abs(middle.rms - math.sqrt(0.5)) < 0.01 and abs(middle.centroid - 440) < 15 and abs(middle.zcr - 0.11) < 0.01


def test_samples(spark):
    r = one(spark, a=signal.compress(F.array(F.lit(0.2), F.lit(0.9), F.lit(-5.0))), b=signal.rms(F.array(F.lit(3.0), F.lit(4.0))), c=signal.should_enhance(F.lit(0.1), F.lit(100.0)), d=signal.should_enhance(F.lit(None).cast("double"), F.lit(100.0)))
    assert [round(x, 6) for x in r.a] == [0.2, 0.5, -1.0] and round(r.b, 6) == round(math.sqrt(12.5), 6) and (r.c, r.d) == (False, True)


def test_sources(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"text": "a b", "language": "en", "duration": 3.0, "segments": [{"id": 0, "start": 0.0, "end": 1.0, "text": "a"}, {"id": 1, "start": 1.5, "end": 2.5, "text": "b"}], "words": [{"word": "a", "start": 0.0, "end": 0.4}]}))
    t = files.read_transcripts(spark, str(tmp_path / "t.json"))
    s = files.transcript_segments(t)
    assert [(r.seg_id, r.text) for r in s.orderBy("seg_id").collect()] == [(0, "a"), (1, "b")]
    assert files.transcript_words(t).count() == 1 and files.local_duration(s).first().duration == 2.5
    assert files.srt(s).first().srt == "1\n00:00:00,000 --> 00:00:01,000\na\n\n2\n00:00:01,500 --> 00:00:02,500\nb\n"
    lines = spark.createDataFrame([("[showinfo] pts_time:2.5 x",), ("[showinfo] pts_time:1 x",), ("showinfo pts_time:bad",), ("other",)], "value string")
    assert [r.time for r in files.scene_times(lines).collect()] == [1.0, 2.5]
    p = {"streams": [{"codec_type": "audio", "codec_name": "aac"}, {"codec_type": "video", "codec_name": "h264", "width": 10, "height": 20, "r_frame_rate": "30000/1001"}], "format": {"duration": "2.5", "size": "99"}}
    r = files.probe(spark.createDataFrame([(json.dumps(p),)], "probe string")).first()
    assert (r.duration, r.size_bytes, r.width, r.video_codec, r.audio_codec, round(r.fps, 2), r.has_audio) == (2.5, 99, 10, "h264", "aac", 29.97, True)
    chunks = files.chunk_plan(spark.createDataFrame([(1, 1200.0, 99 << 20), (2, 50.0, 1)], "video_id long, seconds double, bytes long")).orderBy("video_id", "chunk").collect()
    assert [(c.video_id, c["from"], c.to) for c in chunks] == [(1, 0.0, 600.0), (1, 600.0, 1200.0), (2, 0.0, 50.0)]
    e = files.progress_events(spark.createDataFrame([('{"type": "progress", "stage": "a", "progress": 5}',), ("plain",)], "value string"))
    assert [(x.stage, x.progress) for x in e.collect()] == [("a", 5.0)]
    first = files.cached(spark, str(tmp_path / "c"), lambda: spark.range(3))
    again = files.cached(spark, str(tmp_path / "c"), lambda: spark.range(9))
    assert first.count() == again.count() == 3


def test_result_documents(spark, tmp_path):
    clips = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "video_id long, rank long, id string")
    files.write_documents(files.result_documents(clips), str(tmp_path / "out"))
    doc = json.loads(spark.read.text(str(tmp_path / "out")).first().value)
    assert [c["id"] for c in doc["clips"]] == ["a", "b"] and doc["count"] == 2


def test_clip_arguments(spark):
    rows = spark.createDataFrame([(1, 10.0, 0.2, 4.0, "a.mp4", "s.wav", "o.mp4"), (2, 10.0, 11.0, 12.0, "a.mp4", "s.wav", "o.mp4")], "id long, video_seconds double, start double, end double, input string, audio_input string, output string")
    good, bad = platforms.clip_arguments(rows, padding=0.5).orderBy("id").collect()
    assert (good.cut_start, good.cut_end, good.error) == (0.0, 4.5, None) and bad.error and bad.args is None
    assert " ".join(good.args) == "-ss 0.000 -i a.mp4 -t 4.500 -c:v libx264 -crf 23 -preset medium -c:a aac -b:a 128k -movflags +faststart -y o.mp4"
    plain, empty = platforms.clip_arguments(rows, copy=True).orderBy("id").collect()
    assert " ".join(plain.args) == "-ss 0.200 -i a.mp4 -t 3.800 -c copy -avoid_negative_ts 1 -y o.mp4" and empty.error is None and empty.args
    two = platforms.clip_arguments(rows, audio=True).orderBy("id").first().args
    assert " ".join(two[:12]) == "-ss 0.200 -i a.mp4 -ss 0.200 -i s.wav -t 3.800 -map 0:v"
    fast = platforms.clip_arguments(rows, audio=True, copy=True).orderBy("id").first().args
    assert " ".join(fast[14:]) == "-c:v copy -c:a aac -b:a 128k -avoid_negative_ts 1 -y o.mp4"


def test_thumbnails_and_audio(spark):
    s = F.lit
    r = one(spark, a=platforms.thumbnail_arguments(s(1.5), s("v"), s("o"), width=640), b=platforms.thumbnail_arguments(s(1.5), s("v"), s("o")), c=platforms.audio_arguments(s("v"), s("o"), s("wav"), rate=16000, mono=True), d=platforms.audio_arguments(s("v"), s("o"), s("ogg")))
    assert [" ".join(x) for x in r] == ["-ss 1.500 -i v -frames:v 1 -vf scale=640:-1 -y o", "-ss 1.500 -i v -frames:v 1 -y o", "-i v -vn -acodec pcm_s16le -ar 16000 -ac 1 -y o", "-i v -vn -acodec libmp3lame -b:a 192k -y o"]


def test_selection(spark):
    rows = spark.range(1, 8).select(F.col("id").alias("index"))
    assert [r["index"] for r in platforms.chosen(rows, "1,x, 3,9").orderBy("index").collect()] == [1, 3]
    with pytest.raises(ValueError):
        platforms.chosen(rows, "a,b")


def test_config(spark):
    s = F.lit
    n = s(None).cast("string")
    m = lambda **kv: F.create_map(*[s(x) for p in kv.items() for x in p])
    r = one(spark, a=config.merged(m(x="1", y="2"), m(y="3", z="4")), b=config.key_error(n), c=config.key_error(s("pk")), d=config.key_error(s("sk-" + "x" * 40)), e=config.masked(s("sk-abc")), f=config.masked(s("plain")), g=config.option_errors(num_clips=s("0"), min_duration=s("30"), max_duration=s("20"), padding=n), h=config.preset(s("medium")), i=config.preset(s("x")), j=config.error_title(s("system"), s("DISK_FULL")), k=config.error_title(s("processing"), s("?")), l=config.colour(s("Red")), o=config.colour(s("blue")))
    assert tuple(r) == ({"x": "1", "y": "3", "z": "4"}, "API_KEY_MISSING", "API_KEY_INVALID", None, "sk-" + "•" * 18, "plain", ["num_clips:too_small", "duration:min_not_below_max"], (30, 60), None, "Disk is full", "Processing failed", "FF0000", "FFFFFF")
    e = lambda *x: F.array(*map(s, x)).cast("array<string>")
    r = one(spark, a=display.error_summary(e(), e()), b=display.error_summary(e("T"), e("m")), c=display.error_summary(e("T", "U"), e("m", "n")), d=display.padded(s("ab"), 4), e=display.padded(s("abcde"), 4), f=display.bullets(e("x", "y")), g=display.megabytes(s(1048576)), h=display.megabytes(s(1500000), True))
    assert tuple(r) == ("", "T\n   m", "2 errors found:\n1. T\n   m\n2. U\n   n\nFix these issues and try again", "ab  ", "abcde", "  • x\n  • y", 1.0, 1.5)


def test_gate_bounds(spark):
    row = dict(expanded_start=100.0, expanded_end=150.0, start_1=105.0, end_1=155.0, score_1=0.5, reason_1=None, start_2=105.0, end_2=155.0, score_2=0.9, reason_2=None)
    schema = ", ".join(f"{k} {'string' if 'reason' in k else 'double'}" for k in row)
    far = row | {"start_1": 120.0}
    near, moved = editorial.gate(spark.createDataFrame([tuple(r.values()) for r in (row, far)], schema)).select("verdict", "rejection_reason").collect()
    assert tuple(near) == ("PASS", None) and tuple(moved) == ("REJECT", "structural_issue")


def test_track():
    stages: dict = {}
    now = events.track(None, stages, "a", 40)
    now = events.track(now, stages, "a", 140)
    now = events.track(now, stages, "b", 10)
    now = events.track(now, stages, "c", 10)
    assert now == "c" and stages == {"a": ["completed", 100.0], "b": ["completed", 100.0], "c": ["in_progress", 0.0]}


@pytest.mark.parametrize("blank", [False, True])
def test_empty_transcripts(spark, blank):
    s = spark.createDataFrame([(1, 0, 0.0, 1.0, "  ")] if blank else [], "video_id long, seg_id long, start double, end double, text string")
    assert talk.boundaries(s).count() == 0 and talk.sessions(s).count() == int(blank)


def test_analysis_documents_of_both_shapes(spark, tmp_path):
    (tmp_path / "new.json").write_text(json.dumps({"video_path": "a.mp4", "clips": [{"id": "clip_001", "title": "t", "start_time": 1.0, "end_time": 9.5, "duration": 8.5, "interest_score": 0.5}]}))
    (tmp_path / "old.json").write_text(json.dumps({"video_path": "b.mp4", "duration": 60, "clips": [{"id": 1, "title": "u", "start": 2, "end": 5, "ai_score": 0.25}]}))
    got = files.read_analysis(spark, str(tmp_path)).orderBy("video_path").select("video_path", "id", "start_time", "end_time", "duration", "interest_score").collect()
    assert [tuple(r) for r in got] == [("a.mp4", "clip_001", 1.0, 9.5, 8.5, 0.5), ("b.mp4", "1", 2.0, 5.0, 3.0, 0.25)]


def test_answers_are_asked_again_after_rate_limits_only():
    waits, asked = [], []

    def call(prompt):
        asked.append(prompt)
        if prompt == "limit" and asked.count(prompt) < 3:
            raise RuntimeError("429: try again in 1.5s" if asked.count(prompt) == 1 else "rate_limit_exceeded")
        if prompt == "never":
            raise RuntimeError("429")
        if prompt == "bad":
            raise ValueError("broken")
        return prompt.upper()

    assert model.answer(call, "ok", sleep=waits.append) == ("OK", 1) and model.answer(call, "bad", sleep=waits.append) == (None, 1)
    assert model.answer(call, "limit", sleep=waits.append) == ("LIMIT", 3) and waits == [2.5, 4.0]
    assert model.answer(call, "never", sleep=waits.append) == (None, 5) and waits[2:] == [2.0, 4.0, 8.0, 16.0]


def test_caller_is_a_scorer(spark):
    def call(prompt):
        if prompt == "x":
            raise ValueError("no")
        return prompt + "!"

    got = model.caller(call)(spark.createDataFrame([(1, "a"), (2, "x"), (3, None), (4, "a")], "id long, prompt string")).orderBy("id").collect()
    assert [(r.response, r.attempts) for r in got] == [("a!", 1), (None, 1), (None, 0), ("a!", 1)]


def test_failed_chunks_give_no_clips(spark):
    rows = [(1, i, i * 12.0, i * 12.0 + 10, "x" * 40) for i in range(60)]
    s = spark.createDataFrame(rows, "video_id long, seg_id long, start double, end double, text string")
    none = lambda df: df.withColumn("response", F.lit(None).cast("string"))
    assert model.detect_clips(s, none, 3, budget=100).count() == 0 and model.four_layers(s, 3, ask=lambda kind: none).count() == 0
    every = lambda df: df.withColumn("response", F.lit('[{"start_time": 1, "end_time": 20, "title": "a"}, {"start_time": 1, "end_time": 21, "title": "b", "interest_score": 0.9}]'))
    one, many = model.detect_clips(s, every, 3).collect(), model.detect_clips(s, every, 3, budget=100).collect()
    assert [r.title for r in sorted(one, key=lambda r: r["rank"])] == ["a", "b"] and [r.title for r in many] == ["b"]


def test_layers_packages_and_lineage(spark):
    rows = [(1, i, i * 12.0, i * 12.0 + 10, f"so this is line {i} of the talk " + "x" * (i % 13)) for i in range(80)]
    s = spark.createDataFrame(rows, "video_id long, seg_id long, start double, end double, text string")
    got = model.four_layers(s, 4).collect()
    assert got and [r["rank"] for r in got] == list(range(1, len(got) + 1))
    for r in got:
        m = r.metadata
        assert len(r.title) <= 60 and len(m.hashtags) <= 5 and r.start <= m.thumbnail_time <= r.end and m.layer3.verdict == "PASS"
        assert m.layer2.expanded_start <= m.layer1.rough_start and m.standalone_score >= 0.7


def test_progress_is_told_by_batch(spark, tmp_path):
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).write.parquet(str(tmp_path / "in" / f"p{k}"))
    told = []
    rows = spark.readStream.schema("id long").option("maxFilesPerTrigger", 4).parquet(str(tmp_path / "in" / "*"))
    events.on_progress(rows, str(tmp_path / "out"), lambda k, n: told.append((k, n)))
    assert sum(n for _, n in told) == 30 and [k for k, _ in told] == list(range(len(told)))


def test_failing_updates():
    stages: dict = {}
    now = events.track(None, stages, "a", 10)
    now = events.track(now, stages, "a", 0, failed=True)
    now = events.track(now, stages, "b", 10)
    assert stages == {"a": ["failed", 0.0], "b": ["in_progress", 0.0]} and events.track(now, stages, "c", 0, failed=True) == "b"
    events.track(now, stages, "a", 100)
    assert stages["a"] == ["completed", 100.0]


def test_logs_and_layers(spark, tmp_path):
    lines = spark.createDataFrame([(i, f'{{"level":{i % 4},"message":"m"}}' if i % 5 else " ") for i in range(40)], "at long, value string")
    assert [r.at for r in files.log_tail(lines, 3).collect()] == [39, 38, 37]
    assert tuple(files.log_stats(lines, 8).first()) == (8, 2, 2)  # 39 to 31 without 35: errors 39, 31; warnings 38, 34
    files.write_layers({"a": spark.range(3)}, str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "l" / "a")).count() == 3
    (tmp_path / "v").mkdir()
    for n in ("a.mp4", "b.mp4", "c.txt"):
        (tmp_path / "v" / n).write_text("x")
    listed = files.list_videos(spark, str(tmp_path / "v"))
    assert listed.count() == 2 and files.newest(listed, 1).count() == 1 and "content" not in listed.columns
    (tmp_path / "c.json").write_text("not json")
    assert files.read_config(spark, str(tmp_path / "c.json")).first().config == {}


def test_levels(spark):
    quiet, loud = F.array(F.lit(0.001), F.lit(-0.001)), F.array(F.lit(0.5), F.lit(-0.5))
    r = one(spark, a=signal.louder(quiet), b=signal.louder(loud), c=signal.lifted(quiet), d=signal.lifted(loud), e=signal.louder(F.array(F.lit(0.0))))
    assert abs(r.a[0] - (0.7 * 10 ** (-18 / 20) + 0.3 * 0.001)) < 1e-9 and r.b == [0.5, -0.5] and abs(r.c[0] - 0.064) < 1e-9 and r.d == [0.5, -0.5] and r.e == [0.0]


def test_scans_of_few_files_are_spread(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    assert shared.spread(rows).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and shared.spread(rows).count() == 100
    grouped = rows.groupBy("id").count()
    assert shared.spread(grouped) is grouped


def test_tables_in_the_shared_folder(spark):
    df, path = shared.store(spark.range(5), "t")
    assert path.startswith(shared.shared_dir(spark)) and df.count() == 5
    shared.discard(spark, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(path)


def test_peaks_over_blocks_equal_one_array(spark):
    """Blocks of a few frames, plateaus over several blocks, ties, one and no frames, missing values."""
    rng = np.random.default_rng(3)
    signals = {v: np.repeat(rng.integers(0, m := (3, 8, 1000)[v % 3], n) / m, 4 if v % 5 == 0 else 1)[:n] for v in range(24) if (n := int(rng.integers(1, 160)))}
    rows = [(v, i, i * 0.5, float(x)) for v, xs in signals.items() for i, x in enumerate(xs)] + [(90, 0, 0.0, None), (90, 1, 0.5, math.nan)]
    df = spark.createDataFrame(rows, "video_id long, frame long, t double, energy double")
    for distance, block in ((3, 7), (10, 16)):
        got: dict[int, list] = {}
        for r in signal.peaks(df, distance=distance, floor=0.3, block=block).collect():
            got.setdefault(r.video_id, []).append(r)
        assert set(got) <= set(signals)
        for v, x in signals.items():
            own = sorted(got.get(v, []), key=lambda r: r.peak)
            assert [r.frame for r in own] == signal.find_peaks(x, max(float(np.percentile(x, 70)), 0.3), distance, 0.1).tolist()
            for r in own:
                under = np.flatnonzero(x < x[r.frame] * 0.5)
                first, last = max([-1, *under[under < r.frame]]) + 1, min([len(x), *under[under > r.frame]]) - 1
                assert (r.t, r.height, r.start_t, r.end_t, r.last_t) == (r.frame * 0.5, x[r.frame], first * 0.5, last * 0.5, (len(x) - 1) * 0.5)


def test_one_long_signal_is_many_tasks(spark):
    n = 300_000
    df = spark.range(n).select(F.lit(1).cast("long").alias("video_id"), F.col("id").alias("frame"), (F.col("id") / 100).alias("t"), (F.abs(F.sin(F.col("id") / 37.0)) * (F.xxhash64("id") % 1000 / 4000.0 + 0.75)).alias("energy"))
    x = np.array([r.energy for r in df.orderBy("frame").select("energy").collect()])
    got = sorted(r.frame for r in signal.peaks(df, distance=188, block=8192).collect())
    assert got == signal.find_peaks(x, max(float(np.percentile(x, 70)), 0.5), 188, 0.1).tolist()


def test_exact_quantiles_by_ranges(spark):
    from tidemark.operators import peaks

    rng = random.Random(5)
    values = {k: [rng.choice([rng.gauss(0, 1), 1.0, 1e9]) for _ in range(rng.randrange(1, 60))] for k in range(12)}
    df = spark.createDataFrame([(k, x) for k, xs in values.items() for x in [*xs, None]], "video_id long, x double")
    for share in (0.0, 0.5, 0.7, 1.0):
        got = {r.video_id: r["quantile"] for r in peaks.quantile(df, "x", share).collect()}
        assert all(math.isclose(got[k], float(np.quantile(xs, share)), rel_tol=1e-12, abs_tol=1e-12) for k, xs in values.items())


def test_suppression_and_merging_in_one_island(spark):
    """Islands over many batches against the rules, and a chain of 20,000 intervals in one island."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        rng = random.Random(8)
        rows = [(v, i, float(s := rng.randrange(300)), float(s + rng.randrange(40)), rng.randrange(5) / 4) for v in range(4) for i in range(120)]
        df = spark.createDataFrame(rows, "video_id long, id long, start double, end double, score double")
        for limit in (0.3, 0.7, 1.0):
            merged = {(r.video_id, r.id) for r in folds.merge_duplicates(df, limit, "score").collect()}
            assert merged == {(v, i) for v in range(4) for i in survivors([(s, e, x, i) for s, i, e, x in sorted((s, i, e, x) for w, i, s, e, x in rows if w == v)], limit)}
            want = set()
            for v in range(4):
                kept: list[tuple[float, float]] = []
                for _, i, s, e, _ in sorted((r for r in rows if r[0] == v), key=lambda r: (-r[4], r[1])):
                    if not any((short := min(e - s, b - a)) > 0 and (min(e, b) - max(s, a)) / short > limit for a, b in kept):
                        kept.append((s, e))
                        want.add((v, i))
            assert {(r.video_id, r.id) for r in folds.suppress(df, limit).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    chain = spark.range(20_000).select(F.lit(1).cast("long").alias("video_id"), "id", F.col("id").cast("double").alias("start"), (F.col("id") + 2.5).alias("end"), F.lit(0.5).alias("score"))
    assert folds.suppress(chain).count() == 10_000 and folds.merge_duplicates(chain, 0.5, "score").count() == 10_000


def test_streams_in_any_order(spark, tmp_path):
    """Updates of one file a micro-batch, in a random order: the stages are those of all updates by time; what is later than the
    watermark is dropped."""
    rng = random.Random(6)
    rows = [(k, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=k // 2), k % 3, rng.choice("abcd"), float(rng.randrange(-20, 130)), None) for k in range(200)]
    shuffled = rng.sample(rows, len(rows))
    for k in range(5):
        spark.createDataFrame(shuffled[k * 40 : k * 40 + 40], events.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    stream = events.event_stream(spark, str(tmp_path), 1)
    updates = lambda e: e.select(F.col("user_id").alias("run"), "at", F.col("event_id").alias("tie"), F.col("event_type").alias("stage"), F.col("value").alias("progress"))
    states = events.run_to_end(stream, lambda e: events.stage_tracker(updates(e), "1 hour"), str(tmp_path / "out"))
    got = {(r.run, r.stage): (r.s.status, r.s.progress) for r in states.groupBy("run", "stage").agg(F.max_by(F.struct("status", "progress"), "batch").alias("s")).collect()}
    want = {}
    for run in range(3):
        stages, now = {}, None
        for _, _, _, stage, progress, _ in (r for r in rows if r[2] == run):
            now = events.track(now, stages, stage, progress)
        want |= {(run, s): tuple(v) for s, v in stages.items()}
    assert got == want
    counted = events.run_to_end(stream, lambda e: events.tumbling(e, "10 seconds", "1 hour"), str(tmp_path / "windows"))
    assert counted.agg(F.sum("n")).first()[0] == 200
    met = events.run_to_end(stream, lambda e: events.sessions(e, "1 second", "1 hour"), str(tmp_path / "sessions"))
    assert met.agg(F.sum("n")).first()[0] == 200
    strict = events.run_to_end(stream, lambda e: events.tumbling(e, "10 seconds", "0 seconds"), str(tmp_path / "strict"))
    assert 0 < strict.agg(F.sum("n")).first()[0] < 200


def chunks_by_the_rule(tokens: list[int], budget: int, overlap: float) -> list[tuple[int, int]]:
    out, first, used = [], 1, 0
    for i, own in enumerate(tokens, 1):
        if used + own > budget and i > first:
            out.append((first, i - 1))
            first = i - int((i - first) * overlap)
            used = sum(tokens[first - 1 : i])
        else:
            used += own
    return [*out, (first, len(tokens))]


@pytest.mark.parametrize(("budget", "overlap", "block"), [(20, 0.1, 7), (15, 0.45, 5), (3, 0.3, 8), (21000, 0.1, 10), (20, 0.6, 7)])
def test_token_chunks_over_blocks(spark, budget, overlap, block):
    """Videos of many blocks, rows over the budget, rows without tokens, gaps between ids."""
    rng = random.Random(budget)
    videos = {v: [rng.choice([0, 0, 1, 2, 3, 5, 9, 40] if v % 2 else [1, 2, 3]) for _ in range(rng.randrange(1, 120))] for v in range(16)}
    videos |= {97: [0] * 30 + [30] + [0] * 30 + [1] * 20, 98: [50] * 30, 99: [0] * 60}
    rows = [(v, i * 3 if v % 3 == 0 else i, t) for v, ts in videos.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "video_id long, seg_id long, tokens int")
    got: dict[int, list] = {}
    for r in chunks.token_chunks(df, budget, overlap, block).orderBy("video_id", "chunk").collect():
        got.setdefault(r.video_id, []).append((r.chunk, r.first, r.last))
    assert got == {v: [(k, *c) for k, c in enumerate(chunks_by_the_rule(ts, budget, overlap))] for v, ts in videos.items()}


def test_ledger_asks_each_prompt_once(spark, tmp_path):
    """Repeated rows, null prompts, second runs and repeated tasks make no second call; failed prompts are asked again."""
    told, path = str(tmp_path / "calls"), f"file://{tmp_path}/ledger"

    def call(prompt: str) -> str:
        with open(told, "a") as f:
            f.write(prompt + "\n")
        if prompt.startswith("bad"):
            raise ValueError("no")
        return prompt.upper()

    def calls() -> list[str]:
        with open(told) as f:
            return sorted(f.read().split("\n")[:-1])

    ask = ledger.recorded(call, path, together=4, tasks=3)
    rows = [(k, f"p{k % 40}") for k in range(100)] + [(200, None), (201, "bad")]
    df = spark.createDataFrame(rows, "id long, prompt string")
    got = {r.id: (r.response, r.attempts) for r in ask(df).collect()}
    assert got == {k: (None, 0) if p is None else (None, 1) if p == "bad" else (p.upper(), 1) for k, p in rows}
    assert calls() == sorted({p for _, p in rows if p})
    more = spark.createDataFrame([(1, "p1"), (2, "new"), (3, "bad")], "id long, prompt string")
    assert {r.id: r.response for r in ask(more).collect()} == {1: "P1", 2: "NEW", 3: None}
    assert calls() == sorted([*{p for _, p in rows if p}, "new", "bad"])
    batch = pa.RecordBatch.from_pydict({"_key": [f"k{k}" for k in range(10)], "prompt": [f"q{k}" for k in range(10)]})
    run = ledger._asks(call, f"{tmp_path}/other", 1, 4, 0.0)
    first = [b.to_pylist() for b in run(iter([batch]))]
    before = len(calls())
    assert [b.to_pylist() for b in run(iter([batch]))] == first and len(calls()) == before
    assert [r["response"] for b in first for r in b] == [f"Q{k}" for k in range(10)]


def test_pace_holds_the_rate():
    clock = [0.0]
    pace = ledger.Pace(0.5, lambda: clock[0], lambda s: clock.__setitem__(0, clock[0] + s))
    begins = []
    for k in range(6):
        pace.wait()
        begins.append(clock[0])
        clock[0] += 0.1 if k != 3 else 2.0
    assert all(b - a >= 0.5 - 1e-9 for a, b in zip(begins, begins[1:])) and begins[4] - begins[3] == 2.0


def test_frames_of_a_long_recording_some_at_a_time(spark):
    rng = np.random.default_rng(1)
    y = rng.normal(0, 0.2, 9001)
    padded = np.pad(y, 32)
    want = np.lib.stride_tricks.sliding_window_view(padded, 64)[::16]
    df = spark.createDataFrame([(1, 8000, y.tolist()), (2, 8000, [0.5] * 3), (3, 8000, None)], "video_id long, rate int, samples array<double>")
    rows = sorted(tuple(r) for r in signal.frame_features(df, 64, 16).collect())
    own = [r for r in rows if r[0] == 1]
    assert len(own) == len(want) == 563 and [r[1] for r in own] == list(range(563)) and len(rows) == 564
    assert np.allclose([r[3] for r in own], np.sqrt((want**2).mean(axis=1)), rtol=1e-12)
    assert np.allclose([r[5] for r in own], (np.diff(np.signbit(want), axis=1) != 0).sum(axis=1) / 64)
