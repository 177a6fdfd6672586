"""File sources and sinks: transcripts, analyses, scene logs, probes, progress lines, logs, result documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.display import is_video

WORD = "struct<word:string,start:double,end:double>"
SEGMENT = "struct<id:long,start:double,end:double,text:string>"
TRANSCRIPT = f"video_id string, text string, language string, duration double, words array<{WORD}>, segments array<{SEGMENT}>"
#: Clips as the engine writes them (start_time, interest_score) and as older documents have them (start, ai_score).
CLIP = "struct<id:string,title:string,start_time:double,end_time:double,start:double,end:double,duration:double,interest_score:double,ai_score:double,hybrid_score:double,content_type:string>"
ANALYSIS = f"video_id long, video_path string, duration double, transcript_word_count long, clips array<{CLIP}>"
PROBE = "streams array<struct<codec_type:string,codec_name:string,width:int,height:int,r_frame_rate:string>>, format struct<duration:string,size:string,bit_rate:string>"
PROGRESS = "type string, stage string, progress double, message string"


def read_transcripts(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row a document: of a file each, or (lines) of a line each. A document without a video_id has its file's path."""
    rows = spark.read.schema(TRANSCRIPT).option("multiLine", not lines).json(path)
    return rows.withColumn("video_id", F.coalesce("video_id", F.input_file_name()))


def transcript_documents(segments: DataFrame, words: DataFrame | Callable[[Column], Column] | None = None) -> DataFrame:
    """video_id, value: the transcript document of each video. segments: video_id, seg_id, start, end, text; words:
    video_id, word_idx, word, start, end, or a function from a segment (id, start, end, text) to the array of its words,
    which needs no rows of words."""
    own = F.array_sort(F.collect_list(F.struct(F.col("seg_id").alias("id"), "start", "end", "text")))
    docs = segments.groupBy("video_id").agg(own.alias("segments"), F.max_by("end", "seg_id").alias("duration"))
    if callable(words):
        docs = docs.withColumn("words", F.flatten(F.transform("segments", words)))
    elif words is not None:
        spoken = words.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("word_idx", F.struct("word", "start", "end").alias("w")))).alias("ws"))
        docs = docs.join(spoken.select("video_id", F.transform("ws", lambda w: w["w"]).alias("words")), "video_id", "left")
    text = F.array_join(F.transform("segments", lambda s: F.trim(s["text"])), " ")
    return docs.select("video_id", F.to_json(F.struct(F.col("video_id").cast("string").alias("video_id"), text.alias("text"), *[c for c in docs.columns if c != "video_id"])).alias("value"))


def transcript_segments(transcripts: DataFrame) -> DataFrame:
    return transcripts.select("video_id", F.posexplode("segments").alias("seg_id", "s")).select("video_id", F.col("seg_id").cast("long").alias("seg_id"), "s.start", "s.end", "s.text")


def transcript_words(transcripts: DataFrame) -> DataFrame:
    return transcripts.select("video_id", F.posexplode("words").alias("word_idx", "w")).select("video_id", F.col("word_idx").cast("long").alias("word_idx"), "w.word", "w.start", "w.end")


def local_duration(segments: DataFrame) -> DataFrame:
    """A local transcript lasts until its last segment's end."""
    return segments.groupBy("video_id").agg(F.max_by("end", "seg_id").alias("duration"))


def chunk_plan(videos: DataFrame, length: float = 600.0, most_bytes: int = 24 << 20) -> DataFrame:
    """video_id, chunk, from, to: one chunk, or spans of a length where the audio is too large. videos: seconds, bytes."""
    n = F.when(F.col("bytes") > most_bytes, F.greatest(F.ceil(F.col("seconds") / length), F.lit(1))).otherwise(1)
    rows = videos.select("video_id", "seconds", (n > 1).alias("split"), F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).alias("chunk"))
    return rows.select("video_id", "chunk", (F.col("chunk") * length).alias("from"), F.when(F.col("split"), F.least((F.col("chunk") + 1) * length, "seconds")).otherwise(F.col("seconds")).alias("to"))


def join_chunks(segments: DataFrame, length: float = 600.0) -> DataFrame:
    """Segments of transcribed chunks with times from the video's start, numbered anew. segments: video_id, chunk, seg_id, ..."""
    order = Window.partitionBy("video_id").orderBy("chunk", "seg_id")
    shift = F.col("chunk") * length
    return segments.select("video_id", (F.row_number().over(order) - 1).cast("long").alias("seg_id"), (F.col("start") + shift).alias("start"), (F.col("end") + shift).alias("end"), "text")


def read_analysis(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The clips of analysis documents of either shape, in one."""
    docs = spark.read.schema(ANALYSIS).option("multiLine", not lines).json(path)
    c = docs.select("video_id", "video_path", F.inline("clips"))
    start, end = F.coalesce("start_time", "start"), F.coalesce("end_time", "end")
    return c.select("video_id", "video_path", "id", "title", start.alias("start_time"), end.alias("end_time"), F.coalesce("duration", end - start).alias("duration"), F.coalesce("interest_score", "ai_score").alias("interest_score"), "hybrid_score", "content_type")


def scene_times(lines: DataFrame, score: float = 0.4, keys: tuple[str, ...] = ()) -> DataFrame:
    """Scene cuts of a detector's log lines (value): those with a time that can be read, in order within their keys."""
    hit = lines.where(F.col("value").contains("showinfo") & F.col("value").contains("pts_time:"))
    time = F.regexp_extract("value", r"pts_time:\s*([^\s]+)", 1).try_cast("double")
    return hit.select(*keys, time.alias("time"), F.lit(score).alias("score"), F.lit("scene_change").alias("type")).where("time IS NOT NULL").orderBy(*keys, "time")


def scene_documents(cuts: DataFrame, threshold: float = 0.4, least: float = 2.0) -> DataFrame:
    """video_id, value: the scene document of each video. cuts: video_id, time, score, type."""
    times = F.array_sort(F.collect_list(F.struct("time", "score", "type")))
    docs = cuts.groupBy("video_id").agg(times.alias("scenes"))
    n = F.size("scenes")
    mean = F.when(n > 1, (F.element_at("scenes", -1)["time"] - F.element_at("scenes", 1)["time"]) / (n - 1)).otherwise(0.0)
    named = F.struct("video_id", F.lit(threshold).alias("threshold"), F.lit(least).alias("min_scene_duration"), n.alias("scene_count"), mean.alias("avg_scene_duration"), "scenes", F.struct(F.lit("ffmpeg_scene_filter").alias("detection_method"), F.lit("1.0").alias("version")).alias("metadata"))
    return docs.select("video_id", F.to_json(named).alias("value"))


def frame_rate(text: Column, missing: float = 0.0) -> Column:
    """A rate such as 30000/1001."""
    part = F.split(text, "/")
    top, low = F.try_element_at(part, F.lit(1)).try_cast("double"), F.coalesce(F.try_element_at(part, F.lit(2)).try_cast("double"), F.lit(1.0))
    return F.coalesce(F.try_divide(top, low), F.lit(missing))


def probe(df: DataFrame, column: str = "probe") -> DataFrame:
    """Video information from a media probe's JSON: the first video and the first audio stream."""
    p = F.from_json(column, PROBE)
    first = lambda kind: F.try_element_at(F.filter(F.col("_p.streams"), lambda s: s["codec_type"] == kind), F.lit(1))
    d = df.withColumn("_p", p).withColumn("_v", first("video")).withColumn("_a", first("audio"))
    kept = [c for c in df.columns if c != column]
    return d.select(*kept, F.col("_p.format.duration").try_cast("double").alias("duration"), F.col("_p.format.size").try_cast("long").alias("size_bytes"), F.col("_p.format.bit_rate").try_cast("long").alias("bitrate"), "_v.width", "_v.height", F.col("_v.codec_name").alias("video_codec"), F.col("_a.codec_name").alias("audio_codec"), frame_rate(F.col("_v.r_frame_rate")).alias("fps"), F.col("_a").isNotNull().alias("has_audio"))


def list_videos(spark: SparkSession, path: str, pattern: str = "*.mp4") -> DataFrame:
    """path, modificationTime and length of files; their content is not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).drop("content")


def check_videos(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """wanted (path) with what is wrong: null, VIDEO_NOT_FOUND or INVALID_VIDEO_FORMAT. found: path, as list_videos gives it."""
    have = found.select("path").distinct().withColumn("_have", F.lit(True))
    bad = F.when(F.col("_have").isNull(), "VIDEO_NOT_FOUND").when(~is_video(F.col("path")), "INVALID_VIDEO_FORMAT")
    return wanted.join(have, "path", "left").withColumn("error", bad).drop("_have")


def progress_events(lines: DataFrame) -> DataFrame:
    """Progress events of a stream or table of text lines; other lines drop out."""
    return lines.select(F.from_json("value", PROGRESS).alias("e")).where("e.type = 'progress'").select("e.*")


def log_tail(lines: DataFrame, n: int) -> DataFrame:
    """The last n lines that are not blank. lines: at (order), value."""
    return lines.where(F.trim("value") != "").orderBy(F.col("at").desc()).limit(n)


def log_stats(lines: DataFrame, n: int = 1000) -> DataFrame:
    """Lines, errors (level 3) and warnings (level 2) among the last n of a log of JSON lines."""
    level = lambda k: F.count_if(F.col("value").contains(f'"level":{k}'))
    return log_tail(lines, n).agg(F.count("*").alias("lines"), level(3).alias("errors"), level(2).alias("warnings"))


def newest(files: DataFrame, n: int = 5) -> DataFrame:
    """The newest files by modification time."""
    return files.orderBy(F.col("modificationTime").desc(), "path").limit(n)


def cached(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """The table at path, computed and written first where there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(at, "_SUCCESS")):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """path, config: the settings of each JSON document as a map of texts (empty where it cannot be read)."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.from_json("value", "map<string,string>").alias("config"))
    return rows.withColumn("config", F.coalesce("config", F.create_map().cast("map<string,string>")))


def metadata_documents(clips: DataFrame) -> DataFrame:
    """video_id, value: source and clips of each video. clips: video_id, source_video, rank, ..."""
    row = F.struct(*[c for c in clips.columns if c not in ("video_id", "source_video")])
    docs = clips.groupBy("video_id", "source_video").agg(F.array_sort(F.collect_list(F.struct("rank", row.alias("clip")))).alias("xs"))
    return docs.select("video_id", F.to_json(F.struct("source_video", F.lit(0).alias("duration"), F.transform("xs", lambda x: x["clip"]).alias("clips"))).alias("value"))


def hybrid_documents(clips: DataFrame, stats: DataFrame, ai: DataFrame, energy: DataFrame, weight: float = 0.3) -> DataFrame:
    """video_id, value: clips in rank order, statistics, settings, and how many clips and energy segments there were.

    clips: video_id, rank, ...; stats: one row a video; ai and energy: video_id, ... (counted only)."""
    row = F.struct(*[c for c in clips.columns if c != "video_id"])
    docs = clips.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("rank", row.alias("clip")))).alias("xs"))
    count = lambda df, name: df.groupBy("video_id").agg(F.count("*").alias(name))
    docs = docs.join(stats.select("video_id", F.struct(*[c for c in stats.columns if c != "video_id"]).alias("stats")), "video_id", "left")
    docs = docs.join(count(ai, "n_ai"), "video_id", "left").join(count(energy, "n_energy"), "video_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    found = F.struct(zero("n_ai").alias("total_ai_clips"), zero("n_energy").alias("total_energy_segments"))
    return docs.select("video_id", F.to_json(F.struct("video_id", F.transform("xs", lambda x: x["clip"]).alias("clips"), "stats", F.struct(F.lit(weight).alias("energy_weight")).alias("config"), found.alias("metadata"))).alias("value"))


def result_documents(clips: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """One JSON document a video: its clips in rank order and their number; ``stats`` (one row a video) is put beside."""
    row = F.struct(*[c for c in clips.columns if c != "video_id"])
    docs = clips.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("rank", row.alias("clip")))).alias("xs"))
    docs = docs.select("video_id", F.transform("xs", lambda x: x["clip"]).alias("clips"), F.size("xs").alias("count"))
    if stats is not None:
        docs = docs.join(stats.select("video_id", F.struct(*[c for c in stats.columns if c != "video_id"]).alias("stats")), "video_id", "left")
    return docs.select("video_id", F.to_json(F.struct(*docs.columns)).alias("value"))


def write_documents(docs: DataFrame, path: str) -> None:
    """JSON lines, one a row of ``value``, in packed files (words with their times shrink about tenfold)."""
    docs.select("value").write.mode("overwrite").text(path, compression="gzip")


def write_layers(layers: dict[str, DataFrame], path: str) -> None:
    """Every layer of an editorial run as a table of its own, for inspection."""
    for name, df in layers.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def srt(segments: DataFrame) -> DataFrame:
    """video_id, srt: subtitles of each video."""
    from tidemark.functions.text import srt_time

    order = F.row_number().over(Window.partitionBy("video_id").orderBy("seg_id"))
    block = F.format_string("%d\n%s --> %s\n%s\n", order, srt_time(F.col("start")), srt_time(F.col("end")), F.trim("text"))
    rows = segments.withColumn("_b", block)
    return rows.groupBy("video_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_id", "_b"))), lambda r: r["_b"]), "\n").alias("srt"))
