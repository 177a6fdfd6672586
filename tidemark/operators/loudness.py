"""Gated loudness of recordings in blocks: a weighting filter with its state carried over blocks, gates of 400 ms, gains.

The filter is linear, so a block is filtered once, from rest, and what the state before it adds is added to its sums later:
with y = y0 + O s, the energy of a stretch is the sum of y0^2 + 2 s (O y0) + s (O O) s. Samples are read once; only a few
numbers for each tenth of a second travel.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.signal import lifted_gain
from tidemark.sources.shared import materialize

#: Fixed values of the published measure: length of a gating block in steps, step in seconds, offset, gates in decibels.
STEPS, STEP, OFFSET, ABSOLUTE, RELATIVE = 4, 0.1, -0.691, -70.0, -10.0
#: Samples filtered at once by a matrix, and what is left of a state when it is left out.
ROW, LEFT = 128, 1e-24

Biquad = tuple[tuple[float, float, float], tuple[float, float, float]]


def high_shelf(rate: float, gain: float = 4.0, q: float = 1 / math.sqrt(2), at: float = 1500.0) -> Biquad:
    """Numerator and denominator of a shelf of so many decibels above a frequency."""
    a, w = 10 ** (gain / 40), 2 * math.pi * at / rate
    c, bend = math.cos(w), 2 * math.sqrt(a) * math.sin(w) / (2 * q)
    top = (a * (a + 1 + (a - 1) * c + bend), -2 * a * (a - 1 + (a + 1) * c), a * (a + 1 + (a - 1) * c - bend))
    low = (a + 1 - (a - 1) * c + bend, 2 * (a - 1 - (a + 1) * c), a + 1 - (a - 1) * c - bend)
    return tuple(x / low[0] for x in top), tuple(x / low[0] for x in low)


def high_pass(rate: float, q: float = 0.5, at: float = 38.0) -> Biquad:
    w = 2 * math.pi * at / rate
    c, bend = math.cos(w), math.sin(w) / (2 * q)
    top, low = ((1 + c) / 2, -(1 + c), (1 + c) / 2), (1 + bend, -2 * c, 1 - bend)
    return tuple(x / low[0] for x in top), tuple(x / low[0] for x in low)


def ear(rate: int) -> tuple[Biquad, ...]:
    """The weighting by ear: a shelf, then a high pass."""
    return high_shelf(rate), high_pass(rate)


class Cascade:
    """Biquads one after another as one linear system: state' = A state + B x, y = C state + D x."""

    def __init__(self, biquads: tuple[Biquad, ...]):
        a, b, c, d = np.zeros((0, 0)), np.zeros(0), np.zeros(0), 1.0
        for top, low in biquads:
            own_a = np.array([[-low[1], 1.0], [-low[2], 0.0]])
            own_b = np.array([top[1] - low[1] * top[0], top[2] - low[2] * top[0]])
            a = np.block([[a, np.zeros((len(a), 2))], [np.outer(own_b, c), own_a]])
            b, c, d = np.append(b, own_b * d), np.append(top[0] * c, [1.0, 0.0]), d * top[0]
        self.a, self.b, self.c, self.d, self.order = a, b, c, d, len(a)
        radius = max(abs(np.linalg.eigvals(a)), default=0.0)
        if radius >= 1:
            raise ValueError("the filter does not settle")
        n = 1 + math.ceil(math.log(LEFT) / math.log(radius)) if radius > 0 else self.order
        while np.abs(np.linalg.matrix_power(a, n)).max(initial=0.0) > LEFT:  # equal poles settle later
            n += n // 8 + 1
        self.memory = n
        powers = [np.eye(self.order)]
        for _ in range(ROW):
            powers.append(powers[-1] @ a)
        self.seen = np.array([c @ p for p in powers[:ROW]]).reshape(ROW, self.order)  # of a state, in the outputs of a row
        self.reach = np.array([p @ b for p in powers[ROW - 1 :: -1]]).reshape(ROW, self.order)  # of a row, in the next state
        self.over = powers[ROW]
        h = np.append(d, self.seen[:-1] @ b)
        lag = np.subtract.outer(np.arange(ROW), np.arange(ROW))
        self.direct = np.where(lag >= 0, h[np.maximum(lag, 0)], 0.0)

    def run(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Outputs from rest and the state at the end."""
        whole = len(x) // ROW * ROW
        rows = x[:whole].reshape(-1, ROW)
        given, state, states = rows @ self.reach, np.zeros(self.order), np.empty((len(rows), self.order))
        for k in range(len(rows)):
            states[k] = state
            state = self.over @ state + given[k]
        y = np.empty(len(x))
        y[:whole] = (rows @ self.direct.T + states @ self.seen.T).ravel()
        for i in range(whole, len(x)):
            y[i] = self.c @ state + self.d * x[i]
            state = self.a @ state + self.b * x[i]
        return y, state

    def trace(self, n: int) -> np.ndarray:
        """What each number of a state adds to the next n outputs."""
        rows, state = [], np.eye(self.order)
        for _ in range(-(-n // ROW)):
            rows.append(self.seen @ state)
            state = self.over @ state
        return np.concatenate(rows)[:n] if rows else np.zeros((0, self.order))


@lru_cache(maxsize=64)
def _cascade(biquads: tuple[Biquad, ...]) -> Cascade:
    return Cascade(biquads)


def _cells(first: int, n: int, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the steps that samples first to first + n lie in, and the bounds between them as offsets."""
    low, high = int(first / (STEP * rate)) - 1, int((first + n) / (STEP * rate)) + 2
    number = np.arange(max(low, 0), high + 1)
    begin = np.floor(number * STEP * rate + 1e-9).astype(np.int64)
    inside = np.flatnonzero((begin[1:] > first) & (begin[:-1] < first + n) & (begin[1:] > begin[:-1]))
    cells = number[inside]
    return cells, np.clip(np.append(begin[inside], begin[inside[-1] + 1]) - first, 0, n)


def step_energies(blocks: DataFrame, weights: Callable[[int], tuple[Biquad, ...]] = ear) -> DataFrame:
    """video_id, step, rate, n, energy: samples and the sum of their weighted squares in each tenth of a second.

    blocks: video_id, rate, first, samples; they follow on each other without gaps. The sums of a block are written once,
    then each block's beginning meets the states that the blocks before it ended with, as far back as the filter remembers
    (a sixth of a second by ear)."""
    made = lambda rate: _cascade(weights(rate))
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.float64())]
    names = ["video_id", "rate", "first", "end", "state", "steps", "counts", "energies", "crossed", "squared"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(*(batch[c].to_pylist() for c in ("video_id", "rate", "first")), strict=True)
            for k, (video, rate, first) in enumerate(keys):
                x = np.nan_to_num(batch["samples"][k].values.to_numpy(zero_copy_only=False).astype(float))
                cascade = made(rate)
                y, state = cascade.run(x)
                cells, bounds = _cells(first, len(x), rate)
                energies = np.add.reduceat(y * y, bounds[:-1])
                near = min(len(x), cascade.memory) if first > 0 else 0  # later on the state before is forgotten
                touched = int(np.searchsorted(bounds[:-1], near))
                seen = cascade.trace(int(bounds[touched]))
                crossed = [seen[a:b].T @ y[a:b] for a, b in zip(bounds[:touched], bounds[1 : touched + 1], strict=True)]
                squared = [(seen[a:b].T @ seen[a:b]).ravel() for a, b in zip(bounds[:touched], bounds[1 : touched + 1], strict=True)]
                row = [video, rate, first, first + len(x), state, cells, np.diff(bounds), energies, np.concatenate([*crossed, []]), np.concatenate([*squared, []])]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for r in batch.to_pylist():
                cascade, order = made(r["rate"]), made(r["rate"]).order
                s = np.zeros(order)
                for e in r["earlier"] or []:
                    if e["end"] <= r["first"] <= e["end"] + cascade.memory:
                        s += np.linalg.matrix_power(cascade.a, r["first"] - e["end"]) @ np.array(e["state"])
                energies = np.array(r["energies"])
                crossed, squared = np.reshape(r["crossed"], (-1, order)), np.reshape(r["squared"], (-1, order, order))
                energies[: len(crossed)] += 2 * crossed @ s + (squared @ s) @ s
                for column, x in zip(out, ([r["video_id"]] * len(energies), r["steps"], [r["rate"]] * len(energies), r["counts"], energies.tolist()), strict=True):
                    column += x
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float64()), strict=True)], ["video_id", "step", "rate", "n", "energy"])

    rows = blocks.where("video_id IS NOT NULL AND rate > 0 AND size(samples) > 0").select("video_id", F.col("rate").cast("int").alias("rate"), F.col("first").cast("long").alias("first"), "samples")
    ddl = "video_id long, rate int, first long, `end` long, state array<double>, steps array<long>, counts array<long>, energies array<double>, crossed array<double>, squared array<double>"
    held = materialize(rows.mapInArrow(sums, ddl), "loudness")
    rate, longest = held.agg(F.max("rate"), F.max(F.col("end") - F.col("first"))).first()
    if rate is None:
        return held.sparkSession.createDataFrame([], "video_id long, step long, rate int, n long, energy double")
    back = Window.partitionBy("video_id").orderBy("first").rangeBetween(-(made(rate).memory + longest), -1)
    earlier = held.select("video_id", "first", F.collect_list(F.struct("end", "state")).over(back).alias("earlier"))
    met = held.drop("state").join(earlier, ["video_id", "first"]).mapInArrow(carried, "video_id long, step long, rate int, n long, energy double")
    return met.groupBy("video_id", "step").agg(F.first("rate").alias("rate"), F.sum("n").alias("n"), F.sum("energy").alias("energy"))


def mean_loudness(energy: Column) -> Column:
    return OFFSET + 10 * F.log10(energy)


def gated_loudness(blocks: DataFrame, weights: Callable[[int], tuple[Biquad, ...]] = ear) -> DataFrame:
    """video_id, blocks (gating blocks), gated (those past both gates), loudness.

    Blocks of 400 ms every 100 ms; those of -70 and more give the relative gate, ten under their mean's loudness; those over
    both give the loudness. It is null where there is no whole gating block, or none past the gates (silence). The last
    block may lack up to half a step, as the number of blocks is rounded."""
    steps = materialize(step_energies(blocks, weights), "steps")
    length = steps.groupBy("video_id").agg(F.sum("n").alias("n"), F.first("rate").alias("rate"))
    seconds = F.col("n") / F.col("rate")
    length = length.select("video_id", F.when(seconds >= STEPS * STEP, F.rint((seconds - STEPS * STEP) / STEP).cast("long") + 1).otherwise(0).alias("blocks"))
    spread = steps.select("video_id", "rate", F.explode(F.sequence(F.greatest(F.col("step") - (STEPS - 1), F.lit(0)), "step")).alias("block"), "energy")
    power = spread.groupBy("video_id", "block").agg((F.sum("energy") / (STEPS * STEP * F.first("rate"))).alias("power"))
    power = power.join(length, "video_id").where("block < blocks AND power > 0").withColumn("level", mean_loudness(F.col("power"))).where(F.col("level") >= ABSOLUTE)
    gate = power.groupBy("video_id").agg((mean_loudness(F.avg("power")) + RELATIVE).alias("gate"))
    past = power.join(gate, "video_id").where((F.col("level") > F.col("gate")) & (F.col("level") > ABSOLUTE))
    loud = past.groupBy("video_id").agg(F.count("*").alias("gated"), mean_loudness(F.avg("power")).alias("loudness"))
    return length.join(loud, "video_id", "left").select("video_id", "blocks", F.coalesce("gated", F.lit(0).cast("long")).alias("gated"), "loudness")


def gains(blocks: DataFrame, target: float = -18.0, weights: Callable[[int], tuple[Biquad, ...]] = ear) -> DataFrame:
    """video_id, loudness, gain: seven parts brought to the target and three as they are, where a recording is more than 3
    under the target; where its loudness cannot be told, the plain form by level (``lifted``)."""
    square = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)
    rows = blocks.where("video_id IS NOT NULL AND rate > 0 AND size(samples) > 0")
    level = rows.groupBy("video_id").agg(F.sqrt(F.sum(square("samples")) / F.sum(F.size("samples"))).alias("level"))
    told = gated_loudness(blocks, weights).join(level, "video_id")
    heard = F.when(F.col("loudness") < target - 3, 0.7 * F.pow(F.lit(10.0), (target - F.col("loudness")) / 20) + 0.3).otherwise(1.0)
    return told.select("video_id", "loudness", F.when(F.col("loudness").isNotNull(), heard).otherwise(lifted_gain(F.col("level"))).alias("gain"))


def louder(blocks: DataFrame, target: float = -18.0, weights: Callable[[int], tuple[Biquad, ...]] = ear) -> DataFrame:
    """The blocks with their samples brought to the target loudness (see ``gains``)."""
    gain = gains(blocks, target, weights).select("video_id", "gain")
    return blocks.join(gain, "video_id", "left").withColumn("samples", F.when(F.col("gain") != 1, F.transform("samples", lambda x: x * F.col("gain"))).otherwise(F.col("samples"))).drop("gain")
