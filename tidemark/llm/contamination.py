"""Benchmark decontamination: one Aho-Corasick automaton over all windows of the normalised benchmark texts, run once
over each whole document; hits are mapped back to words and to code points of the original text.

Words are runs of digits, a-z (A-Z lower-cased) and non-ASCII characters. A window is ``width`` consecutive words of an
item; an item of fewer words, but not none, is one window. The benchmark's words are numbered,
and the automaton's letters are those numbers (two for a word); a document's words become letters too, so a window has
``2 * width`` states however long its words are, and a match always covers whole words. An automaton holds at most ``MOST_STATES`` states and ``block_bytes`` of benchmark text, a checked bound on a
worker's memory; a larger benchmark is taken in blocks, one automaton at a time, each of which scans some MB of documents
before the next is built; hit words are united.

Null or wordless documents have no words and are clean; null or wordless items have no windows; items that repeat an id
count once; documents that repeat an id each get a row. Items with a null id have windows like any other: their hit words
count, and only the list of items leaves them out. Empty tables give empty results (an empty benchmark hits nothing);
other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import pieces_of, release, text_bytes, words
from tidemark.sources.shared import spread

WIDTH = 13
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
DOC_SCHEMA = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
#: States of one automaton (50 to 100 bytes each), and MB of documents that a task scans with each of several automata.
MOST_STATES, SCAN_MB = 4_000_000, 32
#: Letters that stand for a word.
LETTERS = 2


class Scanner:
    """The automaton; built where it is used, from the (item id, text) pairs that were shipped.

    A known word is two letters of as many as the root of the number of words, so few edges leave a state; first and
    second letters differ, so a match begins at a word. No window holds an unknown word: what lies between those is
    scanned, where it is as long as the shortest window.
    """

    def __init__(self, items: list[tuple[str | None, bytes]], width: int = WIDTH):
        import ahocorasick

        texts = [(item, words(text)) for item, text in items]
        known = dict.fromkeys(x for _, w in texts for x in w)
        base = math.isqrt(len(known)) + 1
        self.letters = {x: chr(1 + k // base) + chr(1 + base + k % base) for k, x in enumerate(known)}
        owners: dict[str, set[str]] = {}
        for item, w in texts:
            line = "".join(map(self.letters.__getitem__, w))
            for i in range(max(1, len(w) - width + 1) if w else 0):
                who = owners.setdefault(line[LETTERS * i : LETTERS * (i + width)], set())
                if item is not None:
                    who.add(item)
        self.automaton = ahocorasick.Automaton()
        for window, who in owners.items():
            self.automaton.add_word(window, (len(window) // LETTERS, tuple(who)))
        self.empty = not owners
        if not self.empty:
            self.automaton.make_automaton()
            self.runs = re.compile("[^\0]{%d,}" % min(map(len, owners)))

    def scan(self, text: bytes) -> tuple[int, np.ndarray, set[str]]:
        """Words, indexes of hit words, items."""
        w = words(text)
        if not w or self.empty:
            return len(w), np.zeros(0, np.int64), set()
        starts: dict[int, int] = {}
        items: set[str] = set()
        letters = self.letters.get
        line = "".join([letters(x, "\0") for x in w])
        for run in self.runs.finditer(line):
            first = None
            for end, (n, who) in self.automaton.iter(run[0]):
                if first is None:  # unknown words are one letter
                    unknown = line.count("\0", 0, run.start())
                    first = unknown + (run.start() - unknown) // LETTERS
                at = first + (end + 1) // LETTERS - n
                starts[at] = max(starts.get(at, 0), n)
                items.update(who)
        if not starts:
            return len(w), np.zeros(0, np.int64), items
        edge = np.zeros(len(w) + 1, np.int64)
        first = np.fromiter(starts, np.int64, len(starts))
        np.add.at(edge, first, 1)
        np.add.at(edge, first + np.fromiter(starts.values(), np.int64, len(starts)), -1)
        return len(w), np.flatnonzero(np.cumsum(edge[:-1]) > 0), items


def spans_of(text: bytes, hit: np.ndarray) -> list[dict[str, int]]:
    """Code-point spans in the original text of each run of consecutive hit words."""
    if not len(hit):
        return []
    at = [m.span() for m in WORD.finditer(text)]
    chars = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    before = lambda i: int(chars[i - 1]) if i else 0
    runs = np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1)
    return [{"start": before(at[r[0]][0]), "end": before(at[r[-1]][1])} for r in runs]


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, width: int, block_bytes: int, most_states: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """The benchmark, streamed to the driver a partition at a time, in blocks of at most block_bytes and most_states
    states. A longer item is taken in parts that overlap by a window less one word."""
    block: list[tuple[str | None, bytes]] = []
    used = states = 0
    step = max(1, most_states // (LETTERS * width))
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("binary").alias("t"))
    for row in rows.where("t IS NOT NULL").toLocalIterator():
        w = words(bytes(row.t))
        for at in range(0, max(1, len(w) - width + 1) if w else 0, step):
            part = w[at : at + step + width - 1]
            text, own = b" ".join(part), LETTERS * width * max(1, len(part) - width + 1)
            if block and (used + len(text) > block_bytes or states + own > most_states):
                yield block
                block, used, states = [], 0, 0
            block.append((row.i, text))
            used += len(text)
            states += own
    yield block


def _shipped(documents: DataFrame, benchmark: DataFrame, item_id: str, item_text: str, width: int, block_bytes: int, most_states: int):
    """A function from an iterator of batches and their text column to (batch, words, hit word indexes, items), with the
    benchmark's blocks broadcast. With one block its automaton serves the whole task; with more, some MB of documents are
    held and each block's automaton is built, used and dropped in turn."""
    shipped = [documents.sparkSession.sparkContext.broadcast(b) for b in item_blocks(benchmark, item_id, item_text, width, block_bytes, most_states)]

    def scan(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple]:
        release()
        held: list[pa.RecordBatch] = []
        size = 0
        scanner = Scanner(shipped[0].value, width) if len(shipped) == 1 else None

        def judged() -> Iterator[tuple]:
            texts = [list(text_bytes(b[column])) for b in held]
            found = [([0] * len(ts), [np.zeros(0, np.int64)] * len(ts), [set() for _ in ts]) for ts in texts]
            for part in shipped:
                now = scanner or Scanner(part.value, width)
                for ts, (n, hits, items) in zip(texts, found, strict=True):
                    for i, text in enumerate(ts):
                        n[i], hit, who = now.scan(text)
                        if len(hit):
                            hits[i] = np.union1d(hits[i], hit)
                            items[i] |= who
            for b, ts, x in zip(held, texts, found, strict=True):
                yield b, ts, *x

        for batch in pieces_of(batches):
            held.append(batch)
            size += batch.nbytes
            if scanner or size > SCAN_MB << 20:
                yield from judged()
                held, size = [], 0
        if held:
            yield from judged()

    return scan


def contaminated_words(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, block_bytes: int = 4 << 20, most_states: int = MOST_STATES) -> DataFrame:
    """id, n_words, n_hit, items (ids as sorted strings) and spans (of hit words in the original) of each document."""
    scan = _shipped(documents, benchmark, item_id, item_text, width, block_bytes, most_states)

    def judge(batches):
        for batch, texts, n, hits, items in scan(batches, "t"):
            yield pa.RecordBatch.from_arrays(
                [batch["i"], pa.array(n, pa.int64()), pa.array(list(map(len, hits)), pa.int64()), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array([spans_of(t, h) for t, h in zip(texts, hits, strict=True)], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                ["i", "n_words", "n_hit", "items", "spans"],
            )

    doc = spread(documents.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")))
    return doc.mapInArrow(judge, f"i {dict(documents.dtypes)[id_col]}, {DOC_SCHEMA}").withColumnRenamed("i", id_col)


def decontaminate(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, block_bytes: int = 4 << 20, most_states: int = MOST_STATES) -> DataFrame:
    """The documents that are not contaminated, with all their columns whatever their names; one pass without a join."""
    scan = _shipped(documents, benchmark, item_id, item_text, width, block_bytes, most_states)

    def keep(batches):
        for batch, _, n, hits, _ in scan(batches, text_col):
            yield batch.filter(pa.array([not (len(h) and 20 * len(h) >= k) for k, h in zip(n, hits, strict=True)], pa.bool_()))

    return spread(documents).mapInArrow(keep, documents.schema)


def is_contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    """At least one hit word, and hit words are a twentieth of all words or more."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contaminated_words(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), is_contaminated().alias("contaminated"))


ORACLE = {
    "op4_decontamination": r"""
WITH dw AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
iw AS (SELECT item_id, row_number() OVER () AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
pats AS (SELECT DISTINCT item_id, least(len(ws), 13) AS k, array_to_string(ws[i:i + 12], ' ') AS pattern, ws[i] AS first FROM (SELECT *, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM iw WHERE len(ws) > 0)),
d AS (SELECT row, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS pos FROM dw),
g AS (SELECT row, pos, w, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o, lead(w, 5) OVER o, lead(w, 6) OVER o, lead(w, 7) OVER o, lead(w, 8) OVER o, lead(w, 9) OVER o, lead(w, 10) OVER o, lead(w, 11) OVER o, lead(w, 12) OVER o) AS whole FROM d WINDOW o AS (PARTITION BY row ORDER BY pos)),
hits AS (SELECT row, pos, k, item_id FROM g JOIN pats ON k = 13 AND whole = pattern
  UNION ALL SELECT row, pos, k, item_id FROM g JOIN pats ON k < 13 AND w = first AND starts_with(whole || ' ', pattern || ' ')),
marked AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(pos, pos + k)) AS p FROM (SELECT DISTINCT row, pos, k FROM hits)) GROUP BY row),
own AS (SELECT row, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT row, item_id::VARCHAR AS i FROM hits WHERE item_id IS NOT NULL) GROUP BY row)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated FROM dw LEFT JOIN marked USING (row) LEFT JOIN own USING (row)""",
}
