"""Peaks of a signal whose frames are spread over many tasks.

A video's frames are cut into blocks of ``BLOCK`` frames, a row each. What a block needs to know of the rest of its video is
in summaries, a small row for each block: its highest and lowest value, its first and last ones and how long they last. So a
block finds its local maxima alone, also plateaus that reach over its end. Thinning to a distance is sequential, but only
among peaks nearer than the distance to each other: it goes by islands of such peaks, never by frames. Prominence and the
walk to half the height ask for the nearest frame above or below a level: it is in the peak's own block, or else the
summaries name the block that holds it, and the question is sent there; the blocks between count by their lowest values.
Videos of one block are worked out where they lie.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.joins import islands
from tidemark.sources.shared import discard, spread, store

BLOCK = 65_536
#: Ranges of values in which the exact percentile is looked for.
RANGES = 4096


def find_peaks(x: np.ndarray, height: float, distance: int, prominence: float) -> np.ndarray:
    """Indexes of local maxima (the middle of a plateau) of a height, thinned to a distance from the highest down (of
    equal ones the later first), that stand out by a prominence."""
    n = len(x)
    edge = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if n else np.zeros(0, np.int64)
    ends = np.append(edge[1:], n) - 1
    inner = np.flatnonzero((edge > 0) & (ends < n - 1))
    tops = inner[(x[edge[inner] - 1] < x[edge[inner]]) & (x[ends[inner] + 1] < x[edge[inner]])]
    peaks = (edge[tops] + ends[tops]) // 2
    peaks = peaks[x[peaks] >= height]
    keep = np.ones(len(peaks), bool)
    low, high = np.searchsorted(peaks, peaks - distance, "right"), np.searchsorted(peaks, peaks + distance, "left")
    for i in np.argsort(x[peaks], kind="stable")[::-1]:
        if keep[i]:
            keep[low[i] : high[i]] = False
            keep[i] = True
    found = peaks[keep]
    if not len(found):
        return found.astype(np.int64)
    left, right = _base(x), _base(x[::-1])[::-1]
    return found[x[found] - np.maximum(left[found], right[found]) >= prominence].astype(np.int64)


def _base(x: np.ndarray) -> np.ndarray:
    """The lowest value from each frame back to the nearest higher one: one pass with a falling stack."""
    out = np.empty(len(x))
    tops: list[tuple[float, float]] = []  # value, lowest since the one below it in the stack
    for i, v in enumerate(x.tolist()):
        low = v
        while tops and tops[-1][0] <= v:
            low = min(low, tops.pop()[1])
        tops.append((v, low))
        out[i] = low
    return out


def _lower_before(x: np.ndarray, at: list[int], levels: list[float]) -> list[int]:
    """The last frame before each of ``at`` (rising) that is under its level, -1 if none: one pass with a rising stack."""
    out: list[int] = []
    low: list[float] = []
    frames: list[int] = []
    want = iter([*zip(at, levels, strict=True), (-1, 0.0)])
    p, level = next(want)
    for i, v in enumerate(x.tolist()):
        if i == p:
            k = bisect.bisect_left(low, level) - 1
            out.append(frames[k] if k >= 0 else -1)
            p, level = next(want)
        while low and low[-1] >= v:
            low.pop()
            frames.pop()
        low.append(v)
        frames.append(i)
    return out


def quantile(df: DataFrame, name: str, share: float, key: str = "video_id") -> DataFrame:
    """key, quantile: the exact quantile, interpolated between neighbours. Values are counted by ranges between a key's least
    and greatest; only the ranges that hold the two neighbours are ordered, so no task sees all of a key."""
    rows = df.select(key, F.col(name).cast("double").alias("x")).where("x IS NOT NULL")
    ends = rows.groupBy(key).agg(F.min("x").alias("a"), F.max("x").alias("b"), F.count("*").alias("n"))
    place = share * (F.col("n") - 1)
    ends = ends.withColumn("lo", F.floor(place)).withColumn("hi", F.ceil(place)).withColumn("part", place - F.floor(place))
    which = F.when(F.col("b") > F.col("a"), F.least(F.floor((F.col("x") - F.col("a")) / (F.col("b") - F.col("a")) * RANGES), F.lit(RANGES - 1))).otherwise(0)
    ranged = rows.join(ends, key).withColumn("r", which)
    counts = ranged.groupBy(key, "r", "lo", "hi").agg(F.count("*").alias("c"))
    before = Window.partitionBy(key).orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0)))
    held = counts.where("(before <= lo AND lo < before + c) OR (before <= hi AND hi < before + c)").select(F.col(key).alias("_k"), F.col("r").alias("_r"), "before")
    order = Window.partitionBy(key, "r").orderBy("x")
    near = ranged.join(held, (F.col(key) == F.col("_k")) & (F.col("r") == F.col("_r"))).withColumn("o", F.col("before") + F.row_number().over(order) - 1)
    two = near.where("o = lo OR o = hi").groupBy(key).agg(F.min("x").alias("p"), F.max("x").alias("q"), F.first("part").alias("part"))
    step = F.col("q") - F.col("p")
    return two.select(key, F.when(F.col("part") >= 0.5, F.col("q") - step * (1 - F.col("part"))).otherwise(F.col("p") + step * F.col("part")).alias("quantile"))


def _blocks(df: DataFrame, name: str, size: int) -> DataFrame:
    """video_id, block, x, t: values and times of the frames that have a value, in order."""
    rows = df.select("video_id", "frame", "t", F.col(name).cast("double").alias("x")).where("x IS NOT NULL AND NOT isnan(x)")
    g = rows.groupBy("video_id", F.floor(F.col("frame") / size).alias("block")).agg(F.array_sort(F.collect_list(F.struct("frame", "x", "t"))).alias("f"))
    return g.select("video_id", "block", F.transform("f", lambda f: f["x"]).alias("x"), F.transform("f", lambda f: f["t"]).alias("t"))


def _arrays(column: pa.Array) -> list[np.ndarray]:
    flat, edges = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


#: Of a block: frames, greatest and least value, first value and how often it comes at the start, the value behind these (null
#: if there is none), last value, first and last time.
SUMMARY = {"n": "long", "top": "double", "low": "double", "head": "double", "head_n": "long", "behind": "double", "tail": "double", "first_t": "double", "last_t": "double"}


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for x, t in zip(_arrays(batch["x"]), _arrays(batch["t"]), strict=True):
            other = np.flatnonzero(x != x[0])
            head = int(other[0]) if len(other) else len(x)
            rows.append((len(x), x.max(), x.min(), x[0], head, x[head] if head < len(x) else None, x[-1], t[0], t[-1]))
        columns = [pa.array([r[k] for r in rows], pa.int64() if kind == "long" else pa.float64()) for k, kind in enumerate(SUMMARY.values())]
        yield pa.RecordBatch.from_arrays([batch["video_id"], batch["block"], *columns], ["video_id", "block", *SUMMARY])


class _Around:
    """The summaries of all blocks of a video, in order, and the place of one block among them."""

    def __init__(self, blocks: pa.StructArray, block: int):
        self.block = blocks.field("block").to_numpy()
        for c in SUMMARY:
            setattr(self, c, blocks.field(c).to_numpy(zero_copy_only=False))
        self.at = int(np.searchsorted(self.block, block))
        self.start = int(self.n[: self.at].sum())

    def local_maxima(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Middles (counted from the video's first frame) and heights of plateaus that begin in this block and are higher than
        what is on both sides. A plateau at the start or the end of the video is none."""
        k, count = self.at, len(self.n)
        edge = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
        ends = np.append(edge[1:], len(x)) - 1
        left = np.append(self.tail[k - 1] if k else np.inf, x[edge[1:] - 1])
        right = np.append(x[ends[:-1] + 1], np.inf)
        last, j = int(ends[-1]), k + 1
        while j < count and self.head[j] == x[-1]:  # the last plateau goes on in later blocks
            last += int(self.head_n[j])
            if self.head_n[j] < self.n[j]:
                break
            j += 1
        if j < count:
            right[-1] = self.behind[j] if self.head[j] == x[-1] else self.head[j]
        ends[-1] = last
        own = (left < x[edge]) & (right < x[edge])
        return (edge[own] + ends[own]) // 2 + self.start, x[edge[own]]


def _with_summaries(blocks: DataFrame, summaries: DataFrame) -> DataFrame:
    """Blocks with the summaries of their video: dealt by block, so that a long video is many keys."""
    s = summaries.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("block", *SUMMARY))).alias("around"))
    return blocks.join(s.select("video_id", "around", F.explode("around.block").alias("block")), ["video_id", "block"])


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k, x in enumerate(_arrays(batch["x"])):
            pos, height = _Around(batch["around"][k].values, batch["block"][k].as_py()).local_maxima(x)
            tall = height >= batch["floor"][k].as_py()
            yield pa.RecordBatch.from_arrays([pa.array([batch["video_id"][k].as_py()] * int(tall.sum()), batch["video_id"].type), pa.array(pos[tall], pa.int64()), pa.array(height[tall])], ["video_id", "pos", "height"])


def thin(pos: np.ndarray, height: np.ndarray, distance: int) -> np.ndarray:
    """Which of the rising positions stay: from the highest down (of equal ones the later first), those that no kept one is nearer to
    than the distance."""
    keep = np.ones(len(pos), bool)
    low, high = np.searchsorted(pos, pos - distance, "right"), np.searchsorted(pos, pos + distance, "left")
    for i in np.argsort(height, kind="stable")[::-1]:
        if keep[i]:
            keep[low[i] : high[i]] = False
            keep[i] = True
    return keep


def _thinned(distance: int):
    """Rows by video, island and position; an island's rows follow each other, and islands are apart: whole islands at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settled(rows: pa.Table) -> pa.RecordBatch:
            island = np.cumsum(_new(rows)) - 1
            pos = rows["pos"].to_numpy()
            far = island * (int(np.ptp(pos)) + distance + 1) + pos - pos.min()
            return rows.select(["video_id", "pos"]).filter(pa.array(thin(far, rows["height"].to_numpy(), distance))).combine_chunks().to_batches(max_chunksize=1 << 30)

        open_ = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch]) if open_ is None else pa.concat_tables([open_, pa.Table.from_batches([batch])])
            cut = int(np.flatnonzero(_new(rows))[-1])  # the last island may go on
            open_ = rows.slice(cut)
            if cut:
                yield from settled(rows.slice(0, cut))
        if open_ is not None:
            yield from settled(open_)

    return run


def _new(rows: pa.Table) -> np.ndarray:
    video, island = rows["video_id"].to_numpy(), rows["island"].to_numpy()
    return np.append(True, (video[1:] != video[:-1]) | (island[1:] != island[:-1]))


#: Kinds of questions to another block: lowest value up to the nearest frame above a level, before (0) and after (1) the
#: peak; time beside the nearest frame below a level, before (2) and after (3).
LOCAL = "video_id long, pos long, t double, height double, left_low double, right_low double, start_t double, end_t double, last_t double, asks array<struct<kind:int,block:long,level:double>>"


def _nearest_below(x: np.ndarray, at: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The last place before each of ``at`` (rising) whose value is under its level; -1 if there is none."""
    return np.array(_lower_before(x, at.tolist(), level.tolist()), np.int64).reshape(-1)


def _lowest(x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least value of each stretch, both ends inclusive."""
    return np.minimum.reduceat(np.append(x, np.inf), np.stack([first, last + 1], 1).ravel())[::2] if len(first) else np.zeros(0)


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each kept peak with what its own block and the summaries tell, and what is to be asked of other blocks."""
    for batch in batches:
        for k, (x, t, kept) in enumerate(zip(_arrays(batch["x"]), _arrays(batch["t"]), _arrays(batch["kept"]), strict=True)):
            a = _Around(batch["around"][k].values, batch["block"][k].as_py())
            p = np.sort(kept) - a.start
            h, n, at = x[p], len(x), a.at
            back = (n - 1 - p)[::-1]  # the same from the other end
            higher = [_nearest_below(-x, p, -h), n - 1 - _nearest_below(-x[::-1], back, -h[::-1])[::-1]]
            under = [_nearest_below(x, p, h * 0.5), n - 1 - _nearest_below(x[::-1], back, (h * 0.5)[::-1])[::-1]]
            low = [_lowest(x, higher[0] + 1, p), _lowest(x, p, higher[1] - 1)]
            beside = [t[under[0] + 1], t[under[1] - 1]]
            asks: list[list[dict]] = [[] for _ in p]
            for kind, places in ((0, higher[0]), (1, higher[1]), (2, under[0]), (3, under[1])):
                before = kind % 2 == 0
                others = np.arange(at)[::-1] if before else np.arange(at + 1, len(a.n))
                for i in np.flatnonzero(places == (-1 if before else n)).tolist():
                    level = h[i] if kind < 2 else h[i] * 0.5
                    there = np.flatnonzero(a.top[others] > level if kind < 2 else a.low[others] < level)
                    found = int(there[0]) if len(there) else len(others)
                    if kind < 2:
                        low[kind][i] = min([low[kind][i], *a.low[others[:found]]])
                    elif found:
                        beside[kind - 2][i] = a.first_t[others[found - 1]] if before else a.last_t[others[found - 1]]
                    if len(there):
                        asks[i].append({"kind": kind, "block": int(a.block[others[found]]), "level": float(level)})
            columns = [pa.array([batch["video_id"][k].as_py()] * len(p), pa.int64()), pa.array(p + a.start), *map(pa.array, (t[p], h, *low, *beside)), pa.array(np.full(len(p), a.last_t[-1]))]
            kind = pa.list_(pa.struct([("kind", pa.int32()), ("block", pa.int64()), ("level", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(asks, kind)], ["video_id", "pos", "t", "height", "left_low", "right_low", "start_t", "end_t", "last_t", "asks"])


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers of a block to what is asked of it; null where its first or last frame is the nearest one."""
    for batch in batches:
        for k, (x, t) in enumerate(zip(_arrays(batch["x"]), _arrays(batch["t"]), strict=True)):
            q = batch["asked"][k].values
            pos, kind, level = (q.field(c).to_numpy() for c in ("pos", "kind", "level"))
            out = np.full(len(q), np.nan)
            up, down = np.maximum.accumulate, np.minimum.accumulate
            lows, lows_back = np.append(np.inf, down(x)), np.append(down(x[::-1])[::-1], np.inf)
            out[kind == 0] = lows_back[len(x) - np.searchsorted(up(x[::-1]), level[kind == 0], "right")]
            out[kind == 1] = lows[np.searchsorted(up(x), level[kind == 1], "right")]
            i = np.searchsorted(lows_back[:-1], level[kind == 2], "left")
            out[kind == 2] = np.append(t, np.nan)[i]
            i = np.searchsorted(-lows[1:], -level[kind == 3], "right") - 1
            out[kind == 3] = np.where(i >= 0, t[np.maximum(i, 0)], np.nan)
            yield pa.RecordBatch.from_arrays([pa.array([batch["video_id"][k].as_py()] * len(q), pa.int64()), pa.array(pos), pa.array(kind), pa.array(np.where(np.isfinite(out), out, np.nan), from_pandas=True)], ["video_id", "pos", "kind", "value"])


PEAKS = "video_id long, peak long, frame long, t double, height double, start_t double, end_t double, last_t double"


def _of_whole_videos(distance: int, prominence: float, floor: float):
    """Peaks of videos that are one block each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for video, x, t in zip(batch["video_id"].to_pylist(), _arrays(batch["x"]), _arrays(batch["t"]), strict=True):
                p = find_peaks(x, max(float(np.percentile(x, 70)), floor), distance, prominence)
                half, n = x[p] * 0.5, len(x)
                first = _nearest_below(x, p, half) + 1
                last = n - 2 - _nearest_below(x[::-1], (n - 1 - p)[::-1], half[::-1])[::-1]
                parts.append((np.full(len(p), video), np.arange(1, len(p) + 1), p, t[p], x[p], t[first], t[last], np.full(len(p), t[-1])))
            kinds = [np.int64] * 3 + [float] * 5
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[k] for p in parts] or [[]]).astype(kind)) for k, kind in enumerate(kinds)], [c.split()[0] for c in PEAKS.split(", ")])

    return run


def find(df: DataFrame, name: str, distance: int, prominence: float, floor: float, block: int = BLOCK) -> DataFrame:
    """video_id, peak (1, 2, ... by time), frame, t, height, start_t, end_t (while at half the height or more), last_t. frame
    counts the frames that have a value. Frames without one, and frames that are no number, are left out."""
    spark = df.sparkSession
    stored = spread(store(_blocks(df, name, block), "peaks-blocks")[0])
    many = stored.groupBy("video_id").agg(F.count("*").alias("k"))
    short = stored.join(many.where("k = 1"), "video_id", "left_semi").mapInArrow(_of_whole_videos(distance, prominence, floor), PEAKS)
    many = many.where("k > 1").select("video_id")
    if many.isEmpty():
        return short
    blocks = stored.join(many, "video_id", "left_semi")
    kind = dict(df.dtypes)["video_id"]
    summaries = blocks.mapInArrow(_summaries, f"video_id {kind}, block long, " + ", ".join(f"{c} {t}" for c, t in SUMMARY.items()))
    around, around_path = store(_with_summaries(blocks, summaries).withColumn("start", F.aggregate(F.filter("around", lambda b: b["block"] < F.col("block")), F.lit(0).cast("long"), lambda s, b: s + b["n"])), "peaks-around")
    level = quantile(df.where(~F.isnan(F.col(name).cast("double"))).join(many, "video_id", "left_semi"), name, 0.7).select("video_id", F.greatest("quantile", F.lit(floor)).alias("floor"))
    tops = around.join(level, "video_id").select("video_id", "block", "x", "around", "floor").mapInArrow(_tops, f"video_id {kind}, pos long, height double")
    apart = islands(tops, ["pos"], F.col("pos"), distance, float(block))
    kept = apart.repartition("video_id", "island").sortWithinPartitions("video_id", "island", "pos").mapInArrow(_thinned(distance), f"video_id {kind}, pos long")
    # to blocks again: the one that holds the place
    spans = around.select("video_id", "block", "start", (F.col("start") + F.size("x")).alias("stop"))
    at = spans.select("video_id", "block", "start", "stop", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("stop") - 1) / block))).alias("_b"))
    placed = kept.withColumn("_b", F.floor(F.col("pos") / block)).join(at, ["video_id", "_b"]).where("pos >= start AND pos < stop")
    by_block = placed.groupBy("video_id", "block").agg(F.collect_list("pos").alias("kept"))
    local, local_path = store(around.join(by_block, ["video_id", "block"]).select("video_id", "block", "x", "t", "around", "kept").mapInArrow(_local, LOCAL), "peaks-local")
    asked = local.select("video_id", "pos", F.explode("asks").alias("a")).groupBy("video_id", F.col("a.block").alias("block")).agg(F.collect_list(F.struct("pos", F.col("a.kind").alias("kind"), F.col("a.level").alias("level"))).alias("asked"))
    told = blocks.join(asked, ["video_id", "block"]).mapInArrow(_answers, "video_id long, pos long, kind int, value double")
    by_peak = told.groupBy("video_id", "pos").agg(*(F.max(F.when(F.col("kind") == k, F.col("value"))).alias(f"a{k}") for k in range(4)))
    whole = local.drop("asks").join(by_peak, ["video_id", "pos"], "left")
    base = F.greatest(F.least("left_low", "a0"), F.least("right_low", "a1"))
    high = whole.where(F.col("height") - base >= prominence)
    out = high.select("video_id", F.row_number().over(Window.partitionBy("video_id").orderBy("pos")).cast("long").alias("peak"), F.col("pos").alias("frame"), "t", "height", F.coalesce("a2", "start_t").alias("start_t"), F.coalesce("a3", "end_t").alias("end_t"), "last_t")
    done, _ = store(out, "peaks")
    for path in (around_path, local_path):
        discard(spark, path)
    return short.unionByName(done)
