"""Noise reduction of recordings in blocks: short-time spectra, a floor for each band, a smoothed mask, overlap-add.

Two passes over the samples. The first counts the levels of each band, in whole decibels, and gives the floor of a recording.
The second takes each block with the neighbouring samples that its spectra and mask reach, so a block's result is that of the
whole recording.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Decibels that levels are counted in; what is lower is silence and tells nothing of a floor.
LOWEST, HIGHEST = -150, 80


@dataclass(frozen=True)
class Level:
    """How much of what is under the mask goes, decibels over the floor where the mask opens, and over how many more it
    opens wholly; the floor is that share of a band's levels."""

    amount: float
    margin: float
    slope: float = 6.0
    share: float = 0.25


LEVELS = {"gentle": Level(0.8, 9.0), "moderate": Level(0.95, 12.0), "strong": Level(1.0, 15.0)}


@dataclass(frozen=True)
class Frames:
    """Length and step of the spectra, and how many bands and frames the mask is smoothed over (odd)."""

    length: int = 1024
    hop: int = 256
    bands: int = 3
    times: int = 5

    def __post_init__(self):
        if self.length % self.hop or self.length < 2 * self.hop or self.bands % 2 == 0 or self.times % 2 == 0:
            raise ValueError("a frame is two or more whole steps, and the mask is smoothed over odd numbers")

    @property
    def reach(self) -> int:
        """Samples on either side that a sample's result depends on."""
        return self.length + self.times // 2 * self.hop

    @property
    def window(self) -> np.ndarray:
        return np.hanning(self.length + 1)[:-1]

    def spectra(self, y: np.ndarray) -> np.ndarray:
        """Of the frames that begin at each step of y."""
        return np.fft.rfft(np.lib.stride_tricks.sliding_window_view(y, self.length)[:: self.hop] * self.window, axis=1)


def _decibels(spectra: np.ndarray) -> np.ndarray:
    return 20 * np.log10(np.maximum(np.abs(spectra), 1e-30))


def _smoothed(mask: np.ndarray, size: int, axis: int) -> np.ndarray:
    """Mean of neighbours, those past the edge being as the edge."""
    wide = np.pad(mask, [(size // 2, size // 2) if k == axis else (0, 0) for k in (0, 1)], mode="edge")
    return np.lib.stride_tricks.sliding_window_view(wide, size, axis=axis).mean(axis=-1)


def cleaned(y: np.ndarray, first: int, n: int, lead: int, floor: np.ndarray, level: Level, frames: Frames) -> np.ndarray:
    """n samples from number ``first`` on. y holds them after ``lead`` others; what is missing around it is silence."""
    length, hop, side = frames.length, frames.hop, frames.times // 2
    # frames begin at whole steps of the recording; those that touch the samples, and as many more as the mask looks at
    low = -(-(first - length + 1) // hop) - side
    high = (first + n - 1) // hop + side
    begin, end = low * hop, high * hop + length
    at = first - lead
    part = np.pad(y[max(begin - at, 0) : max(end - at, 0)], (max(at - begin, 0), max(end - at - len(y), 0)))
    spectra = frames.spectra(part)
    mask = np.clip((_decibels(spectra) - floor - level.margin) / level.slope, 0, 1)
    mask = _smoothed(mask, frames.bands, 1)
    mask = np.lib.stride_tricks.sliding_window_view(mask, frames.times, axis=0).mean(axis=-1)
    spectra = spectra[side : len(spectra) - side] * (1 - level.amount * (1 - mask))
    rows = np.fft.irfft(spectra, length, axis=1) * frames.window
    out = np.zeros((len(rows) - 1) * hop + length)
    for k in range(length // hop):  # pieces of a step's length, added where they lie
        out[k * hop : k * hop + len(rows) * hop] += rows[:, k * hop : (k + 1) * hop].ravel()
    weight = (frames.window**2).reshape(-1, hop).sum(axis=0)
    start = begin + side * hop
    return out[first - start : first - start + n] / weight[(first + np.arange(n)) % hop]


def floors(blocks: DataFrame, share: float = 0.25, frames: Frames = Frames()) -> DataFrame:
    """video_id, floor: for each band the level in decibels that a share of its frames do not pass, to a whole decibel.

    Frames are those that lie in one block; bands that are silent throughout have a floor of -150."""
    count = frames.length // 2 + 1

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, video in enumerate(batch["video_id"].to_pylist()):
                y = np.nan_to_num(batch["samples"][k].values.to_numpy(zero_copy_only=False).astype(float))
                skip = -batch["first"][k].as_py() % frames.hop
                held = np.zeros((count, HIGHEST - LOWEST), np.int64)
                for low in range(skip, len(y) - frames.length + 1, 512 * frames.hop):
                    found = np.floor(_decibels(frames.spectra(y[low : low + 511 * frames.hop + frames.length]))).astype(int)
                    at = np.minimum(found - LOWEST, HIGHEST - LOWEST - 1)
                    rows, bands = np.nonzero(at >= 0)
                    np.add.at(held, (bands, at[rows, bands]), 1)
                band, at = np.nonzero(held)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(band), video), pa.int64()), pa.array(band, pa.int32()), pa.array(at + LOWEST, pa.int32()), pa.array(held[band, at])], ["video_id", "band", "level", "n"])

    counts = blocks.select("video_id", "first", "samples").mapInArrow(levels, "video_id long, band int, level int, n long").groupBy("video_id", "band", "level").agg(F.sum("n").alias("n"))
    band = Window.partitionBy("video_id", "band")  # at most 230 levels
    ranked = counts.withColumn("upto", F.sum("n").over(band.orderBy("level"))).withColumn("all", F.sum("n").over(band))
    floor = ranked.where(F.col("upto") >= share * F.col("all")).groupBy("video_id", "band").agg((F.min("level") + 1.0).alias("floor"))
    held = floor.groupBy("video_id").agg(F.map_from_entries(F.collect_list(F.struct("band", "floor"))).alias("m"))
    bands = F.sequence(F.lit(0), F.lit(count - 1))
    return held.select("video_id", F.transform(bands, lambda b: F.coalesce(F.try_element_at("m", b), F.lit(float(LOWEST)))).alias("floor"))


def reduced(blocks: DataFrame, level: str | Level = "gentle", frames: Frames = Frames()) -> DataFrame:
    """The blocks (video_id, rate, first, samples) with the noise under each band's floor reduced; more columns stay.

    Samples are shuffled once, by (video_id, first), with the floors and the neighbours' edges; no task holds a recording.
    Blocks of a recording follow on each other; one shorter than ``frames.reach`` with others on both sides is an error.
    A recording without a whole frame in any block has no floor and stays as it is, as do rows without samples."""
    how = LEVELS[level] if isinstance(level, str) else level
    rows = blocks.where("video_id IS NOT NULL AND size(samples) > 0").select("video_id", "first", F.col("samples").cast("array<double>").alias("samples"))
    order = Window.partitionBy("video_id").orderBy("first")
    places = rows.select("video_id", "first", F.size("samples").alias("n"))
    near = places.select("video_id", "first", (F.lag(F.col("first") + F.col("n")).over(order)).alias("before"), F.lag("first").over(order).alias("previous"), F.lead("first").over(order).alias("next"))
    near = near.join(floors(rows, how.share, frames), "video_id")
    edge = frames.reach
    heads = rows.select("video_id", F.col("first").alias("next"), F.slice("samples", 1, edge).alias("right"))
    tails = rows.select("video_id", F.col("first").alias("previous"), F.expr(f"slice(samples, greatest(1, size(samples) - {edge - 1}), {edge})").alias("left"))
    met = rows.join(near, ["video_id", "first"]).join(heads, ["video_id", "next"], "left").join(tails, ["video_id", "previous"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(*(batch[c].to_pylist() for c in ("video_id", "first", "before", "previous", "next")), strict=True)
            for k, (video, first, before, previous, following) in enumerate(keys):
                left, y, right, floor = (np.nan_to_num(batch[c][k].values.to_numpy(zero_copy_only=False)) if batch[c][k].is_valid else np.zeros(0) for c in ("left", "samples", "right", "floor"))
                if (previous is not None and before != first) or (following is not None and following != first + len(y)):
                    raise ValueError(f"blocks of recording {video} do not follow on each other at sample {first}")
                if previous is not None and following is not None and len(y) < edge:
                    raise ValueError(f"the block of recording {video} at sample {first} is shorter than {edge} samples")
                out = cleaned(np.concatenate([left, y, right]), first, len(y), len(left), floor, how, frames)
                yield pa.RecordBatch.from_arrays([pa.array([video]), pa.array([first]), pa.ListArray.from_arrays(pa.array([0, len(out)], pa.int32()), pa.array(out))], ["video_id", "first", "_clean"])

    clean = met.select("video_id", "first", "samples", "before", "previous", "next", "left", "right", "floor").mapInArrow(run, "video_id long, first long, _clean array<double>")
    return blocks.join(clean, ["video_id", "first"], "left").withColumn("samples", F.coalesce("_clean", F.col("samples").cast("array<double>"))).drop("_clean")
