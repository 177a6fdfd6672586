"""Periodic run detection: maximal stretches of words that repeat with a period, by an all-lag vectorised scan.

A text's words are numbered by an array of word ids, and the array is compared with itself shifted by every lag up to
n / 2 (a run holds its period twice at least): a matrix of many lags at once in numpy. Runs of true cells, found in the
flattened matrix, are stretches in which words a lag apart are identical; long enough ones whose smallest period is the lag
are the runs. Nothing is sampled, and no lag or word is left out.

Texts of up to ``LONG`` bytes are scanned where they lie. Of longer ones, each distinct text's ids are written once to the
shared folder, and ranges of lags of about ``CELLS`` comparisons each are dealt to all tasks (each with a copy of the ids,
four bytes a word); only the runs found, fewer than the words, come back to the text. Memory is bounded by one text.

Null and empty texts have no words, no runs and an empty collapsed text. Repeated rows, also with null ids, each get a row;
an empty table gives an empty result; other columns are not looked at, and an id column may have any name but n_words, runs
and collapsed (ValueError).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import pieces_of, release, text_bytes
from tidemark.sources.shared import discard, spread, store

LEAST, TIMES = 12, 2
#: Bytes of a text that is scanned by one task; comparisons of one range of lags; lags of a range at least, so that the copy of
#: the ids costs little beside the comparisons; cells of a matrix.
LONG, CELLS, LEAST_LAGS, MATRIX = 1 << 16, 200_000_000, 1024, 1 << 18
RUNS = "array<struct<start:long,length:long,period:long>>"


def word_ids(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words, from 0 in order of first use."""
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.uint32, len(words))
    return ids.astype(np.uint16) if len(seen) < 65534 else ids


def runs_at(ids: np.ndarray, low: int, high: int, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (start, length, period) of all runs with a period from low to high - 1, sorted by period and start."""
    n, found = len(ids), []
    # ids as they are against ids shifted; what is behind the end is equal to nothing
    top = np.iinfo(ids.dtype).max
    shifted = np.concatenate([ids, np.full(high, top, ids.dtype)])
    plain = np.append(ids, ids.dtype.type(top - 1))
    lag = low
    while lag < high:
        width = n - lag + 1
        rows = min(max(1, MATRIX // width), high - lag)
        lags = np.lib.stride_tricks.as_strided(shifted[lag:], (rows, width), shifted.strides * 2)
        equal = (lags == plain[:width]).ravel()
        # true cells in a row that a run of any of these lags has at least
        turn = [q for q in (least // times, least // times + 1) if lag <= q < lag + rows]
        need = min(max(least - q, (times - 1) * q) for q in (lag, lag + rows - 1, *turn))
        step, held = 1, 1
        while held < need and len(equal):
            step = min(held, need - held, 8)
            equal = equal[step:] & equal[:-step]
            held += step
            if held >= 16:
                break
        if equal.any():
            at = np.flatnonzero(equal)
            new = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            first = at[new]
            cells = np.diff(np.append(new, len(at))) + held - 1
            period = first // width + lag
            start, length = first % width, cells + period
            fits = length >= np.maximum(least, times * period)
            found.append(np.stack([start, length, period], axis=1)[fits])
        lag += rows
    every = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    own = [_smallest(ids, *row) for row in every.tolist()]
    return every[np.array(own, bool)] if len(every) else every


def _smallest(ids: np.ndarray, start: int, length: int, period: int) -> bool:
    """Whether a stretch of at least two periods has no smaller one. A smaller one would divide it, and so would one that
    is the period through a prime."""
    end = start + length
    return not any(np.array_equal(ids[start : end - p], ids[start + p : end]) for p in (period // r for r in _primes(period)))


def _primes(n: int) -> list[int]:
    """Prime factors of n, each once."""
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return out + [n] * (n > 1)


def all_runs(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Runs of all periods, sorted by start, then period."""
    found = runs_at(ids, 1, len(ids) // times + 1, least, times)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay: those that no run holds behind its first period."""
    edges = np.zeros(n + 1, np.int64)
    if len(runs):
        np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
        np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges)[:n] == 0


def _finished(found: list[tuple[list[bytes], np.ndarray]]) -> list[pa.Array]:
    """n_words, runs and collapsed of texts' words and runs."""
    edges = pa.array(np.concatenate([[0], np.cumsum([len(r) for _, r in found])]), pa.int32())
    flat = np.concatenate([r for _, r in found]) if found else np.zeros((0, 3), np.int64)
    runs = pa.ListArray.from_arrays(edges, pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"]))
    collapsed = [b" ".join(w if not len(r) else [x for x, stays in zip(w, kept(len(w), r).tolist(), strict=True) if stays]).decode() for w, r in found]
    return [pa.array([len(w) for w, _ in found], pa.int64()), runs, pa.array(collapsed, pa.string())]


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES, long: int = LONG, cells: int = CELLS, least_lags: int = LEAST_LAGS) -> DataFrame:
    """id, n_words, runs (start and length in words, and the smallest period; by start, then period) and collapsed (the text
    without the repeats, words joined by one space) of each row. A run is at least ``least`` words and ``times`` (2 or more)
    periods long, and no neighbouring word extends it."""
    if id_col in ("n_words", "runs", "collapsed"):
        raise ValueError(f"the id column may not be called {id_col}")
    if times < 2:
        raise ValueError("a run holds its period twice at least")
    kind = dict(df.dtypes)[id_col]
    rows = df.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))
    is_long = F.coalesce(F.octet_length("t"), F.lit(0)) > long

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in pieces_of(batches, 200):
            texts = [t.split() for t in text_bytes(batch["t"])]
            yield pa.RecordBatch.from_arrays([batch["i"], *_finished([(w, all_runs(word_ids(w), least, times)) for w in texts])], [id_col, "n_words", "runs", "collapsed"])

    schema = f"`{id_col}` {kind}, n_words long, runs {RUNS}, collapsed string"
    short = spread(rows.where(~is_long)).mapInArrow(here, schema)
    return short.unionByName(_long(rows.where(is_long).withColumn("k", F.sha2(F.encode("t", "UTF-8"), 256)), id_col, kind, least, times, cells, least_lags))


def _long(rows: DataFrame, id_col: str, kind: str, least: int, times: int, cells: int, least_lags: int) -> DataFrame:
    """The same of long texts, k being a text's digest: ranges of lags over all tasks."""

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, 20):
            ids = [word_ids(t.split()) for t in text_bytes(batch["t"])]
            yield pa.RecordBatch.from_arrays([batch["k"], pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())], ["k", "n", "ids"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in pieces_of(batches, 1):
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], "<u4")
                ids = ids.astype(np.uint16) if len(ids) and ids.max() < 65534 else ids
                found = runs_at(ids, row["low"], row["high"], least, times)
                yield pa.RecordBatch.from_arrays([pa.array([row["k"]] * len(found), pa.string()), *(pa.array(found[:, c], pa.int64()) for c in range(3))], ["k", "start", "length", "period"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, 20):
            found = []
            for text, runs in zip(text_bytes(batch["t"]), batch["runs"], strict=True):
                own = runs.values.flatten() if runs.is_valid else []
                found.append((text.split(), np.stack([np.asarray(c) for c in own], axis=1) if len(own) else np.zeros((0, 3), np.int64)))
            yield pa.RecordBatch.from_arrays([batch["i"], *_finished(found)], [id_col, "n_words", "runs", "collapsed"])

    # digests first: equal texts are one, and only one of them goes on
    words, path = store(rows.dropDuplicates(["k"]).select("k", "t").mapInArrow(numbered, "k string, n long, ids binary"), "runs-words")
    lags = F.greatest(F.lit(least_lags), F.floor(F.lit(cells) / F.col("n"))).cast("long")
    most = F.floor(F.col("n") / times).cast("long")
    ranges = words.where(most >= 1).withColumn("low", F.explode(F.sequence(F.lit(1).cast("long"), most, lags))).withColumn("high", F.least(F.col("low") + lags, most + 1))
    # a number of its own, so that small ranges, which take long, are not put together into few tasks
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found, _ = store(ranges.repartition(tasks, "k", "low").mapInArrow(scan, "k string, start long, length long, period long"), "runs-found")
    discard(rows.sparkSession, path)
    runs = found.groupBy(F.reverse("k").alias("of")).agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    runs = runs.withColumn("runs", F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))))
    whole = rows.join(runs, F.reverse("k") == F.col("of"), "left").select("i", "t", "runs")
    return whole.mapInArrow(finish, f"`{id_col}` {kind}, n_words long, runs {RUNS}, collapsed string")


def longest(runs: Column) -> Column:
    """The run of greatest length; of equal ones, of the smallest start, then period. Null where there is none."""
    by = F.transform(runs, lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"), r.alias("r")))
    return F.array_min(by)["r"]


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text; in every tenth document by hash of its id, words from some place on repeat, joined by one space."""

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            texts = []
            for i, text in zip(batch["doc_id"].to_pylist(), text_bytes(batch["text"]), strict=True):
                h = zlib.crc32(str(i).encode())
                if i is not None and h % 10 == 0 and (words := text.split()):
                    n, g = len(words), h // 10
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    text = b" ".join(words[:a] + [words[a + (k - a) % p] for k in range(a, n)])
                texts.append(text.decode())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return docs.select("doc_id", "text").mapInArrow(plant, f"doc_id {dict(docs.dtypes)['doc_id']}, text string")


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))))
    best = longest(F.col("runs"))
    lines = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    digest = lambda text: F.sha2(F.encode(text, "UTF-8"), 256)
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), digest(lines).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "b.start", "b.length", "b.period", F.expr("1000 * b.length div b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


ORACLE: dict[str, str] = {}
