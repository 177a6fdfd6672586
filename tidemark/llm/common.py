"""Shared pieces of the llm operators: Arrow batches and byte-wise word rules."""

from __future__ import annotations

import contextlib
import ctypes
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: A-Z lower-cased; digits, letters and every byte of a non-ASCII character stay, other ASCII becomes a space.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
LOWER_BYTES = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def text_bytes(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text of an Arrow string column; null is empty."""
    for x in column.cast(pa.large_binary()).to_pylist():
        yield x or b""


def pieces_of(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows: what a worker makes of one at once stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def release() -> None:
    """Gives back what earlier tasks of this Python worker left: remembered units of texts, and memory that the allocators
    hold. Workers outlive tasks, and an executor's memory is shared by its workers and the JVM."""
    made = getattr(sys.modules.get("tidemark.llm.tokens"), "_made", None)
    if made:
        made.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def per_batch(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, encodes: bool = False) -> DataFrame:
    """mapInArrow with a function of one batch; unless it encodes, what encoding has remembered goes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not encodes:
            release()
        for batch in pieces_of(batches):
            if (out := f(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def words(text: bytes) -> list[bytes]:
    """Lower-cased words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a UTF-8 text."""
    return text.translate(WORD_BYTES).split()
