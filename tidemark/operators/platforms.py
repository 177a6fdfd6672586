"""Publishing platforms: specifications, crop plans, encode plans, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.display import megabytes
from tidemark.functions.intervals import midpoint, pad
from tidemark.functions.text import clip_name

#: Key, name, width, height, aspect ratio, longest seconds, largest bytes, video and audio rates, frames.
PLATFORMS = (
    ("tiktok", "TikTok", 1080, 1920, "9:16", 180, 287_000_000, "5M", "128k", 30),
    ("instagram-reels", "Instagram Reels", 1080, 1920, "9:16", 90, 100_000_000, "4M", "128k", 30),
    ("youtube-shorts", "YouTube Shorts", 1080, 1920, "9:16", 60, 100_000_000, "5M", "128k", 30),
    ("youtube", "YouTube (16:9)", 1920, 1080, "16:9", None, 256_000_000_000, "8M", "192k", 30),
    ("instagram-feed", "Instagram Feed (Square)", 1080, 1080, "1:1", 60, 100_000_000, "4M", "128k", 30),
    ("twitter", "Twitter/X", 1280, 720, "16:9", 140, 512_000_000, "6M", "128k", 30),
    ("linkedin", "LinkedIn", 1920, 1080, "16:9", 600, 5_000_000_000, "8M", "192k", 30),
)
SCHEMA = "platform string, name string, width int, height int, aspect_ratio string, max_duration int, max_file_size long, bitrate string, audio_bitrate string, fps int"


def platforms(spark: SparkSession) -> DataFrame:
    """Seven rows."""
    return spark.createDataFrame(list(PLATFORMS), SCHEMA)


def _specifications() -> Column:
    """The same as an array of structs."""
    fields = [f.split() for f in SCHEMA.split(", ")]
    return F.array(*[F.struct(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(p, fields, strict=True)]) for p in PLATFORMS])


def plan(videos: DataFrame, strategy: str = "center", quality: bool = True) -> DataFrame:
    """Each video on each platform: action, crop, filter and encode arguments, preview, size and length flags.

    videos: video, src_w int, src_h int, src_fps double, seconds double, size long. A video without dimensions has a row
    with an error on each platform and no plan. The platforms are a fixed array of seven, so there is no join.
    """
    known = (F.col("src_w") > 0) & (F.col("src_h") > 0)
    j = videos.withColumn("error", F.when(F.coalesce(known, F.lit(False)), None).otherwise("no video dimensions")).withColumn("_p", F.explode(_specifications()))
    j = j.select(*videos.columns, "error", "_p.*")
    j = j.withColumn("src_w", F.when(F.col("error").isNull(), F.col("src_w"))).withColumn("src_h", F.when(F.col("error").isNull(), F.col("src_h")))
    source, target = F.col("src_w") / F.col("src_h"), F.col("width") / F.col("height")
    same = F.abs(source - target) <= 0.01
    wide = source > target
    new_w = (F.col("src_h") * F.col("width") / F.col("height")).cast("int")
    new_h = (F.col("src_w") * F.col("height") / F.col("width")).cast("int")
    x, y = _offset(F.col("src_w") - new_w, strategy, 0.45), _offset(F.col("src_h") - new_h, strategy, 0.35)
    scale = F.format_string("scale=%d:%d", "width", "height")
    crop = F.when(wide, F.format_string("crop=%d:%d:%d:0,", new_w, F.col("src_h"), x)).otherwise(F.format_string("crop=%d:%d:0:%d,", F.col("src_w"), new_h, y))
    fps = F.when(F.col("src_fps") != F.col("fps"), F.format_string("fps=%d,", "fps")).otherwise("")
    share = F.when(same, 0.0).when(wide, (1 - target / source) * 100).otherwise((1 - source / target) * 100)
    action = F.when(F.col("error").isNull(), F.when(same, "scale").when(wide, "crop_horizontal").otherwise("crop_vertical"))
    vf = F.concat(fps, F.when(same, "").otherwise(crop), scale)
    buffer = F.concat((F.regexp_extract("bitrate", r"^(\d+)", 1).cast("int") * 2).cast("string"), F.lit("M"))
    # fixed texts: preview sentences and the size warning
    said = F.when(same, "Video will be scaled to fit (no cropping)").when(wide, F.format_string("Video will be cropped horizontally (~%.0f%% removed from sides)", share)).otherwise(F.format_string("Video will be cropped vertically (~%.0f%% removed from top/bottom)", share))
    over = F.col("size") > F.col("max_file_size")
    limit = F.when(over, F.format_string("File size (%.1fMB) exceeds %s limit (%.1fMB)", F.col("size") / 1e6, F.col("name"), F.col("max_file_size") / 1e6))
    args = F.array(*map(F.lit, ("-vf",)), vf, *map(F.lit, ("-c:v", "libx264", "-preset", "medium" if quality else "fast", "-b:v")), "bitrate", F.lit("-maxrate"), "bitrate", F.lit("-bufsize"), buffer, *map(F.lit, ("-c:a", "aac", "-b:a")), "audio_bitrate", *map(F.lit, ("-ar", "48000", "-movflags", "+faststart", "-y")))
    return j.select("video", "platform", action.alias("action"), F.when(F.col("error").isNull(), vf).alias("vf"), F.round(share, 1).alias("crop_percentage"), F.when(F.col("error").isNull(), said).alias("description"), limit.alias("warning"), F.coalesce(F.col("seconds") > F.col("max_duration"), F.lit(False)).alias("too_long"), F.when(F.col("error").isNull(), args).alias("args"), "error")


def _offset(spare: Column, strategy: str, smart: float) -> Column:
    if strategy == "smart":
        return (spare * smart).cast("int")
    return {"center": F.floor(spare / 2).cast("int"), "top": F.lit(0)}.get(strategy, spare.cast("int"))


#: Audio codecs by format, and of other formats.
AUDIO_CODECS, OTHER_CODEC = {"mp3": "libmp3lame", "wav": "pcm_s16le", "aac": "aac", "m4a": "aac", "flac": "flac"}, "libmp3lame"


def seconds(x: Column) -> Column:
    """Seconds as an argument, to the millisecond."""
    return F.format_string("%.3f", x)


def _words(*parts: Column | str) -> Column:
    """An array of arguments: text as it is, columns by value."""
    return F.array(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def clip_arguments(clips: DataFrame, padding: float = 0.0, copy: bool = False, audio: bool = False, codec: str = "libx264", crf: int = 23, preset: str = "medium", audio_codec: str = "aac") -> DataFrame:
    """Padded and clamped bounds and arguments of each clip. clips: video_seconds, start, end, input, output and, with
    ``audio``, audio_input: a second file that the sound comes from. With ``copy`` pictures are not encoded anew, and an
    empty clip is no error; else an empty clip has an error and no arguments."""
    start, end = pad(F.col("start"), F.col("end"), padding, F.col("video_seconds"))
    c = clips.withColumn("cut_start", start).withColumn("cut_end", end).withColumn("length", F.col("cut_end") - F.col("cut_start"))
    seek, length = seconds(F.col("cut_start")), seconds(F.col("length"))
    source = ["-ss", seek, "-i", F.col("input")] + (["-ss", seek, "-i", F.col("audio_input")] if audio else []) + ["-t", length] + (["-map", "0:v", "-map", "1:a"] if audio else [])
    if copy:
        how = ["-c:v", "copy", "-c:a", "aac", "-b:a", "128k"] if audio else ["-c", "copy"]
        how += ["-avoid_negative_ts", "1"]
    else:
        how = ["-c:v", codec, "-crf", str(crf), "-preset", preset, "-c:a", audio_codec, "-b:a", "128k", "-movflags", "+faststart"]
    bad = F.col("length") <= 0 if not copy else F.lit(False)
    said = F.format_string("Invalid clip duration: start=%s, end=%s", seek, seconds(F.col("cut_end")))
    return c.withColumn("error", F.when(bad, said)).withColumn("args", F.when(~bad, _words(*source, *how, "-y", F.col("output"))))


def thumbnail_arguments(time: Column, source: Column, output: Column, width: int | None = None, height: int | None = None) -> Column:
    """One frame at a time, scaled where a width or height is given (the other follows)."""
    scale = ["-vf", f"scale={width or -1}:{height or -1}"] if width or height else []
    return _words("-ss", seconds(time), "-i", source, "-frames:v", "1", *scale, "-y", output)


def audio_arguments(source: Column, output: Column, kind: Column, bitrate: str = "192k", rate: int | None = None, mono: bool = False) -> Column:
    """The sound of a video in a format; wav has no bit rate."""
    codec = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in AUDIO_CODECS.items() for v in kv]), kind), F.lit(OTHER_CODEC))
    bits = F.when(F.coalesce(kind, F.lit("")) == "wav", F.array().cast("array<string>")).otherwise(_words("-b:a", bitrate))
    more = (["-ar", str(rate)] if rate else []) + (["-ac", "1"] if mono else [])
    return F.concat(_words("-i", source, "-vn", "-acodec", codec), bits, _words(*more, "-y", output))


def render(clips: DataFrame, sizes: Column, folder: str = "clips", **how) -> DataFrame:
    """Result rows of a batch: every clip has one, and one that cannot be cut has an error instead of arguments.

    clips: video_id, index, title, start, end, video_seconds, input. sizes: bytes that an encoder reports for a clip.
    """
    name = clip_name(F.col("index"), F.col("title"), F.col("start"), F.col("end"))
    rows = clips.withColumn("clip_id", name).withColumn("output", F.concat(F.lit(f"{folder}/"), name, F.lit(".mp4")))
    done = clip_arguments(rows, **how).withColumn("success", F.col("error").isNull())
    return done.withColumn("size_bytes", F.when(F.col("success"), sizes)).withColumn("size_mb", megabytes(F.col("size_bytes")))


def clip_metadata(clips: DataFrame, results: DataFrame) -> DataFrame:
    """Metadata of the clips that were cut: the two tables are joined by the clip's place in its video.

    clips: video_id, index, title, start, end, reason, content_type, interest_score, hybrid_score, max_energy.
    """
    made = results.where("success").select("video_id", "index", "clip_id", "cut_start", "cut_end", "size_mb")
    j = clips.join(made, ["video_id", "index"])
    title = F.when(F.coalesce("title", F.lit("")) == "", "Untitled").otherwise(F.col("title"))
    thumb = F.concat("clip_id", F.lit("_thumb.jpg"))
    return j.select(
        "video_id", "clip_id", F.col("index").alias("clip_number"), title.alias("title"), F.coalesce("reason", F.lit("")).alias("description"), F.coalesce("content_type", F.lit("general")).alias("content_type"), "cut_start", "cut_end", "size_mb",
        F.struct(F.coalesce("interest_score", F.lit(0.0)).alias("ai_score"), F.coalesce("hybrid_score", F.lit(0.0)).alias("hybrid_score"), F.coalesce("max_energy", F.lit(0.0)).alias("energy_score")).alias("scores"),
        thumb.alias("thumbnail"), midpoint(F.col("start"), F.col("end")).alias("thumbnail_time"),
    )


def render_totals(results: DataFrame) -> DataFrame:
    """Successes, failures and megabytes of render results."""
    return results.agg(F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"), F.round(F.coalesce(F.sum(F.when(F.col("success"), F.col("size_mb"))), F.lit(0.0)), 1).alias("total_mb"))


def warnings(planned: DataFrame) -> DataFrame:
    """The distinct warnings of a platform plan."""
    return planned.where("warning IS NOT NULL").select("warning").distinct()


def chosen(clips: DataFrame, selection: str) -> DataFrame:
    """The clips whose index is in a list such as 1,3,5; ValueError where the list has no number."""
    wanted = [int(x) for x in (p.strip() for p in selection.split(",")) if x.lstrip("+-").isdigit()]
    if not wanted:
        raise ValueError("Invalid clip selection")
    return clips.where(F.col("index").isin(wanted))
