"""Signal operators over frames: normalisation, mixes, centred averages, peaks, energy segments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import peaks as blocks
from tidemark.operators.joins import overlap_join
from tidemark.operators.peaks import find_peaks as find_peaks  # of one array


def normalise(name: str, key: str = "video_id") -> Column:
    """Min-max over the video; 0 where the range is under 1e-10."""
    w = Window.partitionBy(key)
    low, high = F.min(name).over(w), F.max(name).over(w)
    return F.when(high - low < 1e-10, 0.0).otherwise((F.col(name) - low) / (high - low))


def peak_mix(rms: Column, centroid: Column) -> Column:
    return 0.7 * rms + 0.3 * centroid


def timeline_mix(rms: Column, centroid: Column, crossings: Column) -> Column:
    return 0.70 * rms + 0.25 * centroid + 0.05 * crossings


def smooth(df: DataFrame, name: str, size: int, out: str = "smoothed") -> DataFrame:
    """Centred moving average of ``size`` frames; the edge frames stand for missing ones; of an even size the extra
    frame is on the left."""
    left, right = size // 2, size - size // 2 - 1
    order = Window.partitionBy("video_id").orderBy("frame")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n = F.count("*").over(whole)
    first, last = F.first(name).over(whole), F.last(name).over(whole)
    before = F.greatest(F.lit(left) - F.col("frame"), F.lit(0))
    after = F.greatest(F.col("frame") + right - (n - 1), F.lit(0))
    total = F.sum(name).over(order.rowsBetween(-left, right))
    return df.withColumn(out, (total + before * first + after * last) / size)


def threshold(df: DataFrame, name: str = "energy", share: float = 0.7, floor: float = 0.5) -> DataFrame:
    """video_id, threshold: the exact percentile, not under the floor."""
    return df.groupBy("video_id").agg(F.greatest(F.percentile(name, share), F.lit(floor)).alias("threshold"))


def peaks(df: DataFrame, name: str = "energy", distance: int = 3, prominence: float = 0.1, floor: float = 0.5, block: int = blocks.BLOCK) -> DataFrame:
    """video_id, peak (1, 2, ... by time), frame, t, height, start_t, end_t (while at half the height or more), last_t: the
    peaks that find_peaks gives of a video's frames, found block by block (see operators/peaks.py)."""
    return blocks.find(df, name, distance, prominence, floor, block)


def peak_segments(df: DataFrame, least: float, most: float, name: str = "energy", width: float = 24.0, **how) -> DataFrame:
    """Energy segments around peaks: grown evenly to the least length, trimmed evenly to the most, with the mean energy
    of the frames inside (null if there is none)."""
    p = peaks(df, name, **how)
    length = F.col("end_t") - F.col("start_t")
    p = p.withColumn("grow", F.when(length < least, (least - length) / 2).otherwise(0.0))
    p = p.withColumn("start", F.when(length < least, F.greatest(F.lit(0.0), F.col("start_t") - F.col("grow"))).otherwise(F.col("start_t")))
    p = p.withColumn("end", F.when(length < least, F.least("last_t", F.col("end_t") + F.col("grow"))).otherwise(F.col("end_t")))
    p = p.withColumn("trim", F.greatest((F.col("end") - F.col("start") - most) / 2, F.lit(0.0)))
    p = p.withColumn("start", F.col("start") + F.col("trim")).withColumn("end", F.col("end") - F.col("trim"))
    points = df.select("video_id", F.col("t").alias("r_start"), F.col("t").alias("r_end"), F.col(name).alias("x"))
    inside = overlap_join(p.select("video_id", "peak", "start", "end"), points, width, inclusive=True).where("r_start < end")
    means = inside.groupBy("video_id", "peak").agg(F.avg("x").alias("avg_energy"))
    return p.join(means, ["video_id", "peak"], "left").select("video_id", F.format_string("energy_%03d", "peak").alias("id"), "start", "end", F.col("t").alias("peak_time"), F.col("height").alias("energy_score"), "avg_energy")


#: Frames whose windows a worker holds at once.
FRAMES = 512


FEATURES = "video_id long, frame long, t double, rms double, centroid double, zcr double"


def _measured(y: np.ndarray, at: int, frames: range, rate: int, frame: int, hop: int) -> Iterator[list[np.ndarray]]:
    """Columns frame, t, rms, centroid and zcr of the frames, some at a time: their windows are four times the samples and
    more. y: samples from number ``at`` on; what is missing around it is silence."""
    shape, step = np.hanning(frame + 1)[:-1], np.fft.rfftfreq(frame, 1 / rate)
    for low in range(frames.start, frames.stop, FRAMES):
        count = min(FRAMES, frames.stop - low)
        begin = low * hop - frame // 2 - at
        end = begin + (count - 1) * hop + frame
        part = np.pad(np.asarray(y[max(begin, 0) : max(end, 0)], float), (min(max(-begin, 0), end - begin), min(max(end - len(y), 0), end - begin)))
        rows = np.lib.stride_tricks.sliding_window_view(part, frame)[::hop][:count]
        size = np.abs(np.fft.rfft(rows * shape, axis=1))
        total = size.sum(axis=1)
        centroid = np.where(total > 0, (size * step).sum(axis=1) / np.where(total > 0, total, 1), 0.0)
        zcr = (np.diff(np.signbit(rows), axis=1) != 0).sum(axis=1) / frame
        n = np.arange(low, low + count)
        yield [n, n * hop / rate, np.sqrt((rows**2).mean(axis=1)), centroid, zcr]


def _count(total: int, frame: int, hop: int) -> int:
    """Centred frames of a recording."""
    room = total + frame // 2 * 2 - frame
    return 1 + room // hop if total > 0 and room >= 0 else 0


def _whole(batch: pa.RecordBatch, k: int, name: str = "samples") -> np.ndarray:
    held = batch[name][k]
    return held.values.to_numpy(zero_copy_only=False) if held.is_valid else np.zeros(0)


def frame_features(samples: DataFrame, frame: int = 2048, hop: int = 512) -> DataFrame:
    """video_id, frame, t, rms, centroid, zcr of centred frames.

    samples: video_id, rate int, samples array<float>, a recording in each row; or, with a column ``first``, blocks of
    recordings (see ``block_features``)."""
    if "first" in samples.columns:
        return block_features(samples, frame, hop)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (video, rate) in enumerate(zip(batch["video_id"].to_pylist(), batch["rate"].to_pylist(), strict=True)):
                y = _whole(batch, k)
                for c in _measured(y, 0, range(_count(len(y), frame, hop)), rate, frame, hop):
                    yield pa.RecordBatch.from_arrays([pa.array([video] * len(c[0]), pa.int64()), *map(pa.array, c)], FEATURES.split()[::2])

    return samples.select("video_id", "rate", "samples").mapInArrow(run, FEATURES)


def block_features(blocks: DataFrame, frame: int = 2048, hop: int = 512) -> DataFrame:
    """The frame features of recordings that lie in blocks: video_id, rate, first (number of its first sample), samples.

    A frame that lies in one block is worked out where the block is. A block's end and the next one's beginning (a frame's
    length each) meet by their common bound, and the frames over it are worked out there; past the last block is silence.
    So samples are read once and not shuffled, only their features and edges are (about a thirtieth for blocks of 2^18).
    Blocks of one recording follow on each other without gaps; one that is shorter than a frame must be its last, or this
    is an error. Rows without samples give nothing."""
    edge = frame - 1
    item = pa.struct([(n, pa.int64() if n == "frame" else pa.float64()) for n in FEATURES.split()[2::2]])
    ddl = "array<struct<frame:bigint,t:double,rms:double,centroid:double,zcr:double>>"

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(*(batch[c].to_pylist() for c in ("video_id", "rate", "first")), strict=True)
            for k, (video, rate, first) in enumerate(keys):
                y = _whole(batch, k)
                if not len(y):
                    continue
                end = first + len(y)
                # frames from the first that begins here (or before the recording) to the last that ends here
                low = 0 if first == 0 else -(-(first + frame // 2) // hop)
                high = (end - frame + frame // 2) // hop + 1
                done = [np.concatenate(c) for c in zip(*_measured(y, first, range(low, max(low, high)), rate, frame, hop), strict=True)] or [np.zeros(0)] * 5
                rows = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(done, item, strict=True)], fields=list(item))
                yield met_by_bounds([[video, first, rate, None, None, y[:edge], len(y)]] * (first > 0) + [[video, end, rate, first, y[-edge:], None, None]], rows)

    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.int64()]
    names = ["video_id", "at", "rate", "first", "before", "after", "n_after", "done"]

    def met_by_bounds(rows: list[list], done: pa.StructArray) -> pa.RecordBatch:
        """The features go with the last row, that of the block's end."""
        bounds = pa.array([None] * (len(rows) - 1) + [0, len(done)], pa.int32())
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(bounds, done)], names)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(*(batch[c].to_pylist() for c in ("video_id", "at", "rate", "first", "n_after", "ends", "begins")), strict=True)
            for k, (video, at, rate, first, n_after, ends, begins) in enumerate(keys):
                if ends != 1 or begins > 1:
                    raise ValueError(f"blocks of recording {video} do not follow on each other at sample {at}")
                before, after = _whole(batch, k, "before"), _whole(batch, k, "after")
                if begins and first > 0 and at - first < edge:
                    raise ValueError(f"a block of recording {video} before sample {at} is shorter than a frame")
                # frames that begin before the bound and end after it, but those that began before this block are done already
                low = max(0, (at - frame + frame // 2) // hop + 1, -(-(first + frame // 2) // hop) if first > 0 else 0)
                high = -(-(at + frame // 2) // hop)
                if not begins or n_after < edge:  # the recording ends here or in the next block
                    high = min(high, _count(at + (n_after or 0), frame, hop))
                held = batch["done"][k].values
                parts = [[held.field(i) for i in range(5)]] if held is not None and len(held) else []
                y = np.concatenate([before, after])
                parts += [list(map(pa.array, c)) for c in _measured(y, at - len(before), range(low, max(low, high)), rate, frame, hop)]
                for c in parts:
                    yield pa.RecordBatch.from_arrays([pa.array([video] * len(c[0]), pa.int64()), *c], FEATURES.split()[::2])

    schema = f"video_id long, at long, rate int, first long, before array<double>, after array<double>, n_after long, done {ddl}"
    rows = blocks.where("video_id IS NOT NULL AND size(samples) > 0").select("video_id", F.col("rate").cast("int").alias("rate"), F.col("first").cast("long").alias("first"), F.col("samples").cast("array<double>").alias("samples"))
    one = [F.first(c, ignorenulls=True).alias(c) for c in ("rate", "done", "first", "before", "after", "n_after")]
    met = rows.mapInArrow(inner, schema).groupBy("video_id", "at").agg(*one, F.count("before").alias("ends"), F.count("after").alias("begins"))
    return met.mapInArrow(over, FEATURES)


def compress(samples: Column, knee: float = 0.3, ratio: float = 3.0) -> Column:
    """Above the knee, only a part of the excess stays; then within -1 and 1."""
    soft = lambda x: F.when(F.abs(x) > knee, F.signum(x) * (knee + (F.abs(x) - knee) / ratio)).otherwise(x)
    return F.transform(samples, lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), soft(x))))


def rms(samples: Column) -> Column:
    return F.sqrt(F.aggregate(samples, F.lit(0.0), lambda a, x: a + x * x) / F.size(samples))


def decibels(level: Column) -> Column:
    """A level (root mean square) in decibels of full scale; null for silence."""
    return F.when(level > 0, 20 * F.log10(level))


def louder(samples: Column, target: float = -18.0) -> Column:
    """Seven parts brought to the target loudness and three as they were, only where it is more than 3 under the target.
    Loudness is the level in decibels, not weighted by ear."""
    level = decibels(rms(samples))
    gain = F.pow(F.lit(10.0), (target - level) / 20)
    return F.when(level < target - 3, F.transform(samples, lambda x: 0.7 * (x * gain) + 0.3 * x)).otherwise(samples)


def lifted(samples: Column, target: float = 0.08) -> Column:
    """The plain form, for where loudness cannot be told: eight tenths of the way's gain to a target level, only where the
    level is under half of it."""
    level = rms(samples)
    return F.when((level > 0) & (level < target * 0.5), F.transform(samples, lambda x: x * (target / level) * 0.8)).otherwise(samples)


def lifted_gain(level: Column, target: float = 0.08) -> Column:
    """The factor that ``lifted`` takes at a level."""
    return F.when((level > 0) & (level < target * 0.5), target / level * 0.8).otherwise(1.0)


def energy_timeline(df: DataFrame, size: int, level: str = "rms", centroid: str = "centroid", crossings: str = "zcr") -> DataFrame:
    """video_id, frame, t, combined: the three features, each normalised within its video, mixed and smoothed."""
    mixed = timeline_mix(*(normalise(c) for c in (level, centroid, crossings)))
    return smooth(df.withColumn("_mix", mixed), "_mix", size, "combined").select("video_id", "frame", "t", "combined")


def should_enhance(level: Column, centroid: Column) -> Column:
    """Too quiet, too loud or too bright; true where it cannot be told."""
    return F.coalesce((level < 0.01) | (level > 0.5) | (centroid > 4000), F.lit(True))
