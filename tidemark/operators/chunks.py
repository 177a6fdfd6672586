"""Greedy token chunks of a video whose rows are spread over many tasks.

A chunk takes rows while they fit the budget; the next one begins with the last part of its rows again and takes the row that
did not fit. So where a chunk ends depends only on where it begins, and a video's chunks are one path in a graph: row to the
first row of the chunk after the one that begins there. Rows are cut into blocks; each block, with the rows behind it that
a budget reaches (its halo), leads every one of its rows to the first chunk that begins behind the block, by doubling steps.
The path from block to block then needs only the rows where some path enters a block; with the row where the one path of the
video enters, each block gives its chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.shared import discard, spread, store

BLOCK = 65_536
#: Rows with tokens behind the first that does not fit any more: a chunk that begins again with more than the budget is cut
#: at each next row, and its rows at least halve each time, so this is enough for an overlap under a half.
BEHIND = 34
HEADS = "video_id {kind}, block long, n long, total long, some long"


def _lists(column: pa.Array) -> list[np.ndarray]:
    flat, edges = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


class Rows:
    """A block's rows: positions first to last of n in the video (from 1); sums holds the tokens up to each row with tokens, of
    the block and its halo, at its position."""

    def __init__(self, tokens: np.ndarray, start: int, before: int, n: int, halo_at: np.ndarray, halo_sum: np.ndarray):
        own = np.flatnonzero(tokens)
        self.first, self.last, self.n, self.before = start + 1, start + len(tokens), n, before
        self.at = np.concatenate([own + start + 1, halo_at]).astype(np.int64)
        self.sums = np.concatenate([before + np.cumsum(tokens)[own], halo_sum]).astype(np.int64)

    def up_to(self, at: np.ndarray) -> np.ndarray:
        """Tokens of the video up to positions of the block or its halo."""
        k = np.searchsorted(self.at, at, "right")
        return np.append(self.before, self.sums)[k]

    def over(self, first: np.ndarray, budget: int) -> np.ndarray:
        """The first row up to which a chunk from ``first`` has more than the budget; n + 1 where all fits."""
        k = np.searchsorted(self.sums, self.up_to(first - 1) + budget, "right")
        return np.append(self.at, self.n + 1)[k]

    def step(self, first: np.ndarray, taken: np.ndarray, budget: int, overlap: float) -> tuple[np.ndarray, np.ndarray]:
        """Of chunks that begin at ``first`` and have taken rows up to ``taken``: where the next one begins and what it has taken
        (n + 1 both where all the rest fits)."""
        ends = np.maximum(taken + 1, self.over(first, budget))
        carry = np.floor((ends - first) * overlap).astype(np.int64)
        return np.where(ends > self.n, self.n + 1, ends - carry), np.minimum(ends, self.n + 1)

    def is_cut(self, first: np.ndarray, taken: np.ndarray, budget: int) -> np.ndarray:
        """Whether what is taken again is over the budget already, so that the chunk ends at the next row."""
        return (first <= self.n) & (taken > first) & (self.up_to(np.minimum(taken, self.n)) - self.up_to(first - 1) > budget)

    def leaving(self, budget: int, overlap: float) -> np.ndarray:
        """For each row of the block, the first chunk start behind the block on the path from it (n + 1: none)."""
        rows = np.arange(self.first, self.last + 1)
        to, taken = self.step(rows, rows, budget, overlap)
        while (cut := self.is_cut(to, taken, budget)).any():
            to[cut], taken[cut] = self.step(to[cut], taken[cut], budget, overlap)
        while (inside := to <= self.last).any():
            to[inside] = to[to[inside] - self.first]
        return to

    def chunks(self, entry: int, budget: int, overlap: float) -> list[tuple[int, int]]:
        """First and last rows of the chunks on the path from a row, up to the first whole start behind the block."""
        out, first, taken = [], np.array([entry]), np.array([entry])
        while first[0] <= self.n and (first[0] <= self.last or self.is_cut(first, taken, budget)[0]):
            begin = int(first[0])
            first, taken = self.step(first, taken, budget, overlap)
            out.append((begin, int(taken[0]) - 1))
        return out


def _folded(blocks: DataFrame, budget: int, overlap: float) -> DataFrame:
    """Chunks of videos that are one block each: an aggregate() over its tokens. blocks: video_id, t."""
    n = F.size("t")
    init = F.struct(F.array().cast("array<struct<first:int,last:int>>").alias("done"), F.lit(1).alias("first"), F.lit(0).cast("long").alias("used"))

    def step(s: Column, i: Column) -> Column:
        own = F.element_at("t", i)
        full = (s["used"] + own > budget) & (i > s["first"])
        carry = F.floor((i - s["first"]) * F.lit(overlap)).cast("int")
        again = F.aggregate(F.when(carry > 0, F.slice("t", i - carry, carry)).otherwise(F.slice("t", 1, 0)), F.lit(0).cast("long"), lambda t, x: t + x)
        return F.when(full, F.struct(F.concat(s["done"], F.array(F.struct(s["first"].alias("first"), (i - 1).alias("last")))).alias("done"), (i - carry).alias("first"), (again + own).alias("used"))).otherwise(
            F.struct(s["done"].alias("done"), s["first"].alias("first"), (s["used"] + own).alias("used"))
        )

    ended = F.aggregate(F.sequence(F.lit(1), n), init, step, lambda s: F.concat(s["done"], F.array(F.struct(s["first"].alias("first"), n.alias("last")))))
    rows = blocks.select("video_id", F.posexplode(ended).alias("chunk", "c"))
    return rows.select("video_id", F.col("chunk").cast("long").alias("chunk"), F.col("c.first").cast("long").alias("first"), F.col("c.last").cast("long").alias("last"))


def token_chunks(df: DataFrame, budget: int, overlap: float = 0.10, block: int = BLOCK) -> DataFrame:
    """video_id, chunk, first and last (positions from 1 by seg_id) of greedy chunks of at most ``budget`` tokens; a chunk begins
    with the last ``int(rows * overlap)`` rows of the one before. A row over the budget is taken nevertheless. Videos of one
    block are folded where they lie; with an overlap of a half or more, under which a chunk may repeat for ever, every video is
    taken as one block. df: video_id, seg_id, tokens (null: 0)."""
    spark, kind = df.sparkSession, dict(df.dtypes)["video_id"]
    at = F.floor(F.col("seg_id") / block) if overlap < 0.5 else F.lit(0).cast("long")
    rows = df.select("video_id", at.alias("block"), F.struct("seg_id", F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("tokens")).alias("r"))
    grouped = rows.groupBy("video_id", "block").agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["tokens"]).alias("t"))
    held = spread(store(grouped, "chunks-blocks")[0])
    blocks = held.groupBy("video_id").agg(F.count("*").alias("k"))
    short = _folded(held.join(blocks.where("k = 1"), "video_id", "left_semi"), budget, overlap)
    held = held.join(blocks.where("k > 1"), "video_id", "left_semi")
    if held.isEmpty():
        return short

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [(len(t), int(t.sum()), int((t > 0).sum())) for t in _lists(batch["t"])]
            yield pa.RecordBatch.from_arrays([batch["video_id"], batch["block"], *(pa.array([x[k] for x in told], pa.int64()) for k in range(3))], ["video_id", "block", "n", "total", "some"])

    def wanted(table: pa.Table) -> pa.Table:
        """Of one video's blocks: where each stands, and the blocks whose rows it needs behind its own."""
        table = table.sort_by("block")
        n, total, some = (table[c].to_numpy() for c in ("n", "total", "some"))
        sums, rows_, count = np.cumsum(total), np.cumsum(n), np.cumsum(some)
        reach = np.minimum(np.searchsorted(sums, sums + budget, "right"), len(n) - 1)  # holds the first row that does not fit
        reach = np.minimum(np.searchsorted(count, count[reach] + BEHIND, "left"), len(n) - 1)
        names = table["block"].to_pylist()
        needs = [names[k + 1 : r + 1] for k, r in enumerate(reach.tolist())]
        columns = [pa.array(x) for x in (rows_ - n, sums - total, np.full(len(n), rows_[-1]))]
        return pa.table([table["video_id"], table["block"], *columns, pa.array(needs, pa.list_(pa.int64()))], names=["video_id", "block", "start", "before", "rows", "needs"])

    places, places_path = store(held.mapInArrow(heads, HEADS.format(kind=kind)).groupBy("video_id").applyInArrow(wanted, f"video_id {kind}, block long, start long, before long, rows long, needs array<long>"), "chunks-places")
    asked = places.withColumn("ends", F.coalesce(F.lead("before").over(Window.partitionBy("video_id").orderBy("block")), F.lit(0))).select("video_id", F.explode("needs").alias("block"), F.struct(F.col("block").alias("to"), F.col("ends").alias("ends")).alias("a"))
    asked = asked.groupBy("video_id", "block").agg(F.collect_list("a").alias("asked"))

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, t in enumerate(_lists(batch["t"])):
                some = np.flatnonzero(t)
                sums, at = batch["before"][k].as_py() + np.cumsum(t)[some], some + batch["start"][k].as_py() + 1
                to = batch["asked"][k].as_py()
                size = [int(np.searchsorted(sums, a["ends"] + budget, "right")) + BEHIND + 1 for a in to]
                yield pa.RecordBatch.from_arrays([pa.array([batch["video_id"][k].as_py()] * len(to), batch["video_id"].type), pa.array([a["to"] for a in to], pa.int64()), pa.array([at[:s] for s in size], pa.list_(pa.int64())), pa.array([sums[:s] for s in size], pa.list_(pa.int64()))], ["video_id", "block", "at", "sums"])

    whole = held.join(places.drop("needs"), ["video_id", "block"])
    halo = whole.join(asked, ["video_id", "block"]).mapInArrow(give, f"video_id {kind}, block long, at array<long>, sums array<long>")
    halo = halo.groupBy("video_id", "block").agg(F.array_sort(F.collect_list(F.struct("at", "sums"))).alias("h")).select("video_id", "block", F.flatten(F.transform("h", lambda h: h["at"])).alias("at"), F.flatten(F.transform("h", lambda h: h["sums"])).alias("sums"))
    none = F.array().cast("array<long>")
    full = whole.join(halo, ["video_id", "block"], "left").withColumn("at", F.coalesce("at", none)).withColumn("sums", F.coalesce("sums", none))
    ready, ready_path = store(full, "chunks-ready")

    def blocks_of(batch: pa.RecordBatch) -> Iterator[tuple[int, Rows]]:
        for k, (t, at, sums) in enumerate(zip(*(_lists(batch[c]) for c in ("t", "at", "sums")), strict=True)):
            yield k, Rows(t, batch["start"][k].as_py(), batch["before"][k].as_py(), batch["rows"][k].as_py(), at, sums)

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each block: its first and last row, and where the path from each of its rows leaves it, as runs of rows."""
        for batch in batches:
            for k, rows in blocks_of(batch):
                to = rows.leaving(budget, overlap)
                new = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
                yield pa.RecordBatch.from_arrays([batch["video_id"].slice(k, 1), batch["block"].slice(k, 1), pa.array([rows.first]), pa.array([new + rows.first], pa.list_(pa.int64())), pa.array([to[new]], pa.list_(pa.int64()))], ["video_id", "block", "first", "row", "to"])

    def path(table: pa.Table) -> pa.Table:
        """Where the path from a video's first row enters each block that it enters."""
        table = table.sort_by("first")
        first = table["first"].to_numpy()
        row, to = (_lists(table[c].combine_chunks()) for c in ("row", "to"))
        at, block, entry = 1, [], []
        while (k := int(np.searchsorted(first, at, "right")) - 1) not in block[-1:]:
            block.append(k)
            entry.append(at)
            at = int(to[k][np.searchsorted(row[k], at, "right") - 1])
        return pa.table([pa.array([table["video_id"][0].as_py()] * len(block), table["video_id"].type), pa.array([table["block"][k].as_py() for k in block], pa.int64()), pa.array(entry, pa.int64())], names=["video_id", "block", "entry"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, rows in blocks_of(batch):
                found = rows.chunks(batch["entry"][k].as_py(), budget, overlap)
                yield pa.RecordBatch.from_arrays([pa.array([batch["video_id"][k].as_py()] * len(found), batch["video_id"].type), *(pa.array([c[x] for c in found], pa.int64()) for x in (0, 1))], ["video_id", "first", "last"])

    entries = ready.mapInArrow(exits, f"video_id {kind}, block long, first long, row array<long>, to array<long>").groupBy("video_id").applyInArrow(path, f"video_id {kind}, block long, entry long")
    found, _ = store(ready.join(entries, ["video_id", "block"]).mapInArrow(walk, f"video_id {kind}, first long, last long"), "chunks")
    for p in (places_path, ready_path):
        discard(spark, p)
    number = F.row_number().over(Window.partitionBy("video_id").orderBy("last")) - 1
    return short.unionByName(found.select("video_id", number.cast("long").alias("chunk"), "first", "last"))
