"""Calls to a model through a ledger: no prompt is asked twice, several at a time, within a rate.

An answer is kept under a hash of its prompt. Prompts that the ledger has are joined to their answers and not asked; the
others are dealt over tasks by their hash, each once. A task asks ``together`` prompts at a time in a pool of threads, in
order of their hashes, and writes their answers as one file, under a name made of the hashes, by one rename; so a task that
is repeated after a lost executor finds what it has asked before, but for the prompts it was asking just then. The rate is
divided by the number of tasks: each keeps its calls so far apart that all of them together stay within it.
"""

from __future__ import annotations

import hashlib
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.editorial import Scorer
from tidemark.operators.model import ATTEMPTS, answer
from tidemark.sources.shared import store

ANSWERS = "_key string, response string, attempts long"
TOGETHER = 16


class Pace:
    """Lets calls begin at least so many seconds apart, whatever thread they come from."""

    def __init__(self, apart: float, now: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.apart, self.now, self.sleep = apart, now, sleep
        self.next, self.lock = now(), threading.Lock()

    def wait(self) -> None:
        with self.lock:
            begin = max(self.next, self.now())
            self.next = begin + self.apart
        if (ahead := begin - self.now()) > 0:
            self.sleep(ahead)


def _filesystem(path: str):
    """pyarrow's file system for a path or URI as Spark writes it, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def _asks(call: Callable[[str], str], ledger: str, attempts: int, together: int, apart: float):
    """One task: rows (_key, prompt) in order of keys, each key once, to their answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileType

        fs, top = _filesystem(ledger)
        pace = Pace(apart)

        def one(prompt: str) -> tuple[str | None, int]:
            def paced(p: str) -> str:
                pace.wait()
                return call(p)

            return answer(paced, prompt, attempts)

        fs.create_dir(top, recursive=True)
        with ThreadPoolExecutor(together) as pool:
            for rows in _groups(batches, together):
                keys = [k for k, _ in rows]
                name = f"{top}/{hashlib.sha256(','.join(keys).encode()).hexdigest()}.parquet"
                if fs.get_file_info(name).type == FileType.File:  # this task was here before
                    with fs.open_input_file(name) as f:
                        table = pq.read_table(f)
                    kept = dict(zip(table["_key"].to_pylist(), zip(table["response"].to_pylist(), table["attempts"].to_pylist(), strict=True), strict=True))
                else:
                    kept = {}
                missing = [(k, p) for k, p in rows if k not in kept]
                made = dict(zip((k for k, _ in missing), pool.map(one, (p for _, p in missing)), strict=True))
                told = [(k, *(kept.get(k) or made[k])) for k in keys]
                good = [x for x in told if x[1] is not None]  # what failed is asked again another time
                if made and good:
                    aside = f"{top}/_{uuid.uuid4().hex}"
                    with fs.open_output_stream(aside) as f:
                        pq.write_table(_table(good), f)
                    fs.move(aside, name)
                yield from _table(told).to_batches()

    return run


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["_key", "response", "attempts"])


def _groups(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[tuple[str, str]]]:
    rows: list[tuple[str, str]] = []
    for batch in batches:
        for row in zip(batch["_key"].to_pylist(), batch["prompt"].to_pylist(), strict=True):
            rows.append(row)
            if len(rows) == size:
                yield rows
                rows = []
    if rows:
        yield rows


def recorded(call: Callable[[str], str], ledger: str, attempts: int = ATTEMPTS, together: int = TOGETHER, rate: float | None = None, tasks: int | None = None) -> Scorer:
    """A scorer that asks a service through the ledger at a path that all nodes see; adds response and attempts (those of the
    time when the prompt was asked). together: calls at a time in a task; rate: calls a second of all tasks together; tasks:
    how many ask. A null prompt is not asked; where all attempts failed, the response is null and the ledger has none."""

    def score(df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        n = tasks or spark.sparkContext.defaultParallelism
        keyed = df.withColumn("_key", F.sha2(F.encode("prompt", "UTF-8"), 256))
        wanted = keyed.where("prompt IS NOT NULL").groupBy("_key").agg(F.first("prompt").alias("prompt"))
        had = _read(df, ledger)
        new = wanted.join(had, "_key", "left_anti").repartition(n, "_key").sortWithinPartitions("_key")
        told = new.mapInArrow(_asks(call, ledger, attempts, together, n / rate if rate else 0.0), ANSWERS)
        known = had.join(wanted.select("_key"), "_key", "left_semi")
        answers, _ = store(told.unionByName(known), "answers")
        out = keyed.join(answers, "_key", "left").drop("_key")
        return out.select(*df.columns, "response", F.coalesce("attempts", F.lit(0).cast("long")).alias("attempts"))

    return score


def _read(df: DataFrame, ledger: str) -> DataFrame:
    """The ledger's answers, one for each key (two runs at once may both have asked)."""
    spark = df.sparkSession
    fs, top = _filesystem(ledger)
    fs.create_dir(top, recursive=True)
    rows = spark.read.schema(ANSWERS).parquet(ledger)
    return rows.groupBy("_key").agg(F.min_by(F.struct("response", "attempts"), "response").alias("a")).select("_key", "a.response", "a.attempts")
