"""Order-dependent folds over a video's rows: greedy suppression, merging of duplicates, minimum gaps, token chunks.

What cannot reach each other is folded apart: a video is cut into islands where no interval spans (or, for gaps, where two
rows are the gap apart). Suppression and merging run over an island's rows in order and hold little of it: the kept
intervals in an index, or those that are open. Minimum gaps are an aggregate() over an island's sorted times. Token chunks
are in operators/chunks.py.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.joins import islands


def _gathered(df: DataFrame, order: list[Column], columns: list[str], *key: str) -> DataFrame:
    """One row a video (and island): xs, its rows as structs in order."""
    keyed = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)], F.struct(*columns).alias("x"))
    return df.groupBy("video_id", *key).agg(F.transform(F.array_sort(F.collect_list(keyed)), lambda s: s["x"]).alias("xs"))


def _in_order(df: DataFrame, order: list[Column], schema_of: DataFrame, run) -> DataFrame:
    """mapInArrow over rows dealt by island, an island's rows following each other in an order; a task never holds an island."""
    rows = islands(df, ["start", "id"], F.col("end")).repartition("video_id", "island").sortWithinPartitions("video_id", "island", *order)
    return rows.mapInArrow(run, schema_of.schema)


class _Kept:
    """Kept intervals of an island for greedy suppression. Of two kept ones neither holds the other (the common part would be
    all of the shorter), so their ends rise with their starts, and those that meet an interval lie side by side."""

    def __init__(self, threshold: float):
        self.threshold, self.starts, self.ends = threshold, [], []

    def take(self, start: float, end: float) -> bool:
        """Whether the interval stays; then it suppresses what comes later."""
        if self.threshold >= 1 or not end > start:
            return True  # nothing is more than all of the shorter; an empty one meets nothing
        at = bisect.bisect_left(self.starts, end)
        k = at - 1
        while k >= 0 and self.ends[k] > start:
            common = min(end, self.ends[k]) - max(start, self.starts[k])
            if common > 0 and common / min(end - start, self.ends[k] - self.starts[k]) > self.threshold:
                return False
            k -= 1
        place = bisect.bisect_left(self.starts, start)
        self.starts.insert(place, start)
        self.ends.insert(place, end)
        return True


def suppress(df: DataFrame, threshold: float = 0.3, score: str = "score") -> DataFrame:
    """Greedy suppression: by falling score, keep what no kept interval overlaps by more than the threshold.

    An island is one run of rows by falling score in a task, which holds the kept intervals' ends alone, in an index: each
    row looks only at the few kept ones that it meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kept = None, _Kept(threshold)
        for batch in batches:
            stays = []
            for *own, start, end in zip(*(batch[c].to_pylist() for c in ("video_id", "island", "start", "end")), strict=True):
                if own != key:
                    key, kept = own, _Kept(threshold)
                stays.append(kept.take(start, end) if start is not None and end is not None else True)
            yield batch.select(names).filter(pa.array(stays, pa.bool_()))

    names = df.columns
    return _in_order(df, [F.col(score).desc_nulls_last(), F.col("id")], df, run)


class _Open:
    """Merging of duplicates as a sweep by rising start: only intervals that may still meet another are held, in order."""

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.open: list[tuple[float, float, float, int]] = []  # start, end, score, number of the row

    def meet(self, start: float, end: float, score: float, number: int, fate: dict[int, bool]) -> None:
        """Settles what this row settles: fate tells of each row whether it stays."""
        still, skipped = [], False
        for k, one in enumerate(self.open):
            s, e, x, n = one
            if start > e:
                fate[n] = True
                continue
            short = min(e - s, end - start)
            common = min(e, end) - max(s, start)
            if short > 0 and common > 0 and common / short > self.threshold:
                if score > x:
                    fate[n] = False
                    continue
                skipped = True
            still.append(one)
            if skipped:  # those behind do not look at it
                still += self.open[k + 1 :]
                break
        self.open = still
        if skipped:
            fate[number] = False
        else:
            self.open.append((start, end, score, number))

    def close(self, fate: dict[int, bool]) -> None:
        fate.update((one[3], True) for one in self.open)
        self.open = []


def merge_duplicates(df: DataFrame, threshold: float, score: str = "interest_score") -> DataFrame:
    """Duplicates of merged chunk results, by rising start: an interval suppresses later ones that overlap it by more
    than the threshold and do not score higher, until it meets one that does; then it is dropped itself, but what it
    suppressed stays so. The scan of an interval ends at the first that starts behind its end.

    An island is one run of rows by rising start in a task, which holds the intervals that are open at the time and their
    rows. Rows with a null start, end or score stay and suppress nothing."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sweep, count, fate = None, _Open(threshold), 0, {}
        held: pa.Table | None = None  # rows of open intervals of batches before, and their numbers
        numbers: list[int] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            first = count
            for *own, start, end, x in zip(*(batch[c].to_pylist() for c in ("video_id", "island", "start", "end", score)), strict=True):
                if own != key:
                    sweep.close(fate)
                    key = own
                if None in (start, end, x):
                    fate[count] = True
                else:
                    sweep.meet(start, end, x, count, fate)
                count += 1
            rows = pa.Table.from_batches([batch.select(names)])
            rows = rows if held is None else pa.concat_tables([held, rows])
            numbers += range(first, count)
            yield from rows.filter(pa.array([fate.get(n, False) for n in numbers])).combine_chunks().to_batches()
            waits = [n not in fate for n in numbers]
            held = rows.filter(pa.array(waits)).combine_chunks()
            numbers, fate = [n for n, w in zip(numbers, waits, strict=True) if w], {}
        if held is not None:
            sweep.close(fate)
            yield from held.to_batches()

    return _in_order(df, [F.col("start"), F.col("id")], df, run)


def minimum_gap(df: DataFrame, gap: float, time: str = "time", tie: str = "cut") -> DataFrame:
    """Keeps the first, then each that lies the gap or more behind the last one kept."""
    g = _gathered(islands(df, [time, tie], F.col(time), gap), [F.col(time), F.col(tie)], df.columns, "island")
    empty = F.filter("xs", lambda x: F.lit(False))
    kept = F.aggregate("xs", empty, lambda acc, x: F.when((F.size(acc) == 0) | (x[time] - F.element_at(acc, -1)[time] >= gap), F.concat(acc, F.array(x))).otherwise(acc))
    return g.select(F.inline(kept))
