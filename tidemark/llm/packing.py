"""Mixture-controlled packing: deficit round-robin over source queues fills every window to target token proportions.

Each source is a queue of its documents' ids, at any number of sources. In every window of ``size`` tokens a queue is
served its share of the tokens, in whole tokens; what is missing to its exact share is its deficit, carried to the next
window. The queues are the leaves of a Huffman tree over their tokens: of the first v tokens of a node, its left child
gives ``floor(v * left / whole)`` and its right child the others, so both only grow and add up exactly. No inner node
holds more than two thirds of its parent, so a deficit stays under four tokens however many queues there are. The
schedule is known for any window without the ones before, and tasks cut their documents independently: deficits carry
across windows and partitions alike. With targets other than the corpus's own mixture, the schedule has phases: when a
queue cannot fill its share of another window, the others go on in their proportions.

The tokens that do not fill a window come first, cut into sequences of powers of two, so nothing is padded.

A null text is empty and still has its end id; a null source is the queue ``""``, and so is all of a table without a
source column. Only where a caller sets
``max_queues`` do more sources than that share queues by hash; a queue's target is then the sum of its sources' targets.
Repeated ids stay apart as rows; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import pieces_of, release, text_bytes
from tidemark.llm.tokens import CACHE, encoder
from tidemark.sources.shared import materialize, spread

SIZE = 2048


def part_of(x: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Quotient and remainder of x * a / b, all under 2^47, in 64 bits: long division by 16 bits of x at a time."""
    if int(x.max(initial=0)) * a < 1 << 62:
        return np.divmod(x * a, b)
    x, a, b = x.astype(np.uint64), np.uint64(a), np.uint64(b)
    q, r = np.zeros(len(x), np.uint64), np.zeros(len(x), np.uint64)
    for shift in (32, 16, 0):
        r = (r << np.uint64(16)) + (x >> np.uint64(shift) & np.uint64(0xFFFF)) * a
        q = (q << np.uint64(16)) + r // b
        r %= b
    return q.astype(np.int64), r.astype(np.int64)


class Phase:
    """Windows over which each queue gives a fixed amount: the first of ``first`` tokens (or none), then full ones."""

    def __init__(self, amounts: list[int], taken: list[int], first: int, size: int, window: int):
        self.amounts, self.taken, self.first, self.size, self.window = amounts, taken, first, size, window
        self.length = sum(amounts)
        if self.length >= 1 << 47:
            raise ValueError("a schedule takes fewer than 2^47 tokens")
        # of each node but the root: its parent, whether it is the right child, the tokens of the left one and of both
        self.parent, self.right, self.left, self.whole = ([0] * len(amounts) for _ in range(4))
        heap = [(n, i) for i, n in enumerate(amounts) if n]
        heapq.heapify(heap)
        while len(heap) > 1:
            (n, i), (m, k), node = heapq.heappop(heap), heapq.heappop(heap), len(self.parent)
            for child, right in ((i, 0), (k, 1)):
                self.parent[child], self.right[child], self.left[child], self.whole[child] = node, right, n, n + m
            for column in (self.parent, self.right, self.left, self.whole):
                column.append(0)
            heapq.heappush(heap, (n + m, node))
        self.parent, self.right, self.left, self.whole = (np.array(c, np.int64) for c in (self.parent, self.right, self.left, self.whole))

    def edges(self, j: np.ndarray) -> np.ndarray:
        """Tokens of the phase before its window j."""
        return np.maximum(self.first + (j - 1) * self.size, 0) if self.first else j * self.size

    def windows(self) -> int:
        return (self.length - self.first) // self.size + (self.first > 0)

    def path(self, q: int) -> list[tuple[int, int, int]]:
        """(is right, tokens of the left child, of both) from the queue up to the root."""
        out = []
        while self.whole[q]:
            out.append((int(self.right[q]), int(self.left[q]), int(self.whole[q])))
            q = int(self.parent[q])
        return out

    def served(self, path: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of a queue among the first u of the phase, and those of the queues to its left."""
        lead = np.zeros(len(u), np.int64)
        for right, part, whole in reversed(path):
            left = part_of(u, part, whole)[0]
            lead, u = (lead + left, u - left) if right else (lead, left)
        return u, lead

    def find(self, path: list, x: np.ndarray) -> np.ndarray:
        """The windows that hold tokens x of a queue."""
        for right, part, whole in path:
            if right:
                x = part_of(x, whole, whole - part)[0]
            else:
                x, over = part_of(x + 1, whole, part)
                x = x - (over == 0)
        return np.where(x < self.first, 0, (x - self.first) // self.size + (self.first > 0)).astype(np.int64)


class Schedule:
    """Which window and offset each token of each queue goes to."""

    def __init__(self, totals: dict[str, int], targets: dict[str, float] | None = None, size: int = SIZE):
        self.names = sorted(totals)
        self.index = {q: i for i, q in enumerate(self.names)}
        left = [totals[q] for q in self.names]
        self.size, self.rest = size, sum(left) % size
        taken, first, window = [0] * len(left), self.rest, 0
        self.phases: list[Phase] = []
        held: set[int] = set()
        while targets and sum(left):
            goal = [0 if i in held or not left[i] else max(0.0, float(targets.get(q, 0))) for i, q in enumerate(self.names)]
            whole, spare = sum(goal), sum(g > 0 for g in goal)
            short = [i for i, g in enumerate(goal) if g and left[i] < g / whole * (size + first) + spare]
            if short or not whole:
                held.update(short)
                if not short:
                    break
                continue
            count = min(int((left[i] - spare) * whole / g - first) // size for i, g in enumerate(goal) if g)
            length = first + max(1, count) * size
            amounts = [int(length * g / whole) for g in goal]
            amounts[int(np.argmax(goal))] += length - sum(amounts)
            self._add(amounts, left, taken, first, window)
            window, first = window + self.phases[-1].windows(), 0
        if sum(left):
            self._add(list(left), left, taken, first, window)
        #: Sequences of the rest: powers of two, largest first.
        self.powers = [1 << b for b in range(self.rest.bit_length() - 1, -1, -1) if self.rest >> b & 1]

    def _add(self, amounts: list[int], left: list[int], taken: list[int], first: int, window: int) -> None:
        self.phases.append(Phase(amounts, list(taken), first, self.size, window))
        for i, n in enumerate(amounts):
            left[i] -= n
            taken[i] += n

    def cut(self, queue: str, x: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, sequence, offset) of the pieces of the n tokens from x on of a queue."""
        q, parts = self.index[queue], []
        for p in self.phases:
            a, b = max(x, p.taken[q]), min(x + n, p.taken[q] + p.amounts[q])
            if a < b:
                parts.append(self._in(p, q, a - p.taken[q], b - p.taken[q], a - x))
        if len(parts) == 1:
            return parts[0]
        return tuple(np.concatenate(c) for c in zip(*parts, strict=True))

    def _in(self, p: Phase, q: int, a: int, b: int, start: int):
        path = p.path(q)
        j, last = p.find(path, np.array([a, b - 1])).tolist()
        # a queue that is rarer than windows is not in most of them
        j = np.arange(j, last + 1) if last - j <= b - a else np.unique(p.find(path, np.arange(a, b)))
        (mine, before), (mine_next, before_next) = p.served(path, p.edges(j)), p.served(path, p.edges(j + 1))
        low, high = np.maximum(mine, a), np.minimum(mine_next, b)
        some = high > low
        low, high = low[some], high[some]
        offset = (before_next - before)[some] + low - mine[some]
        cut = [(low - a + start).astype(np.int64), (high - low).astype(np.int64), (j[some] + p.window).astype(np.int64), offset.astype(np.int64)]
        return self._powers(*cut) if self.rest else cut

    def _powers(self, start, length, window, offset):
        """Pieces of the first window are cut where its sequences end; later windows come behind those."""
        rows = []
        for s, n, o in zip(start[window == 0], length[window == 0], offset[window == 0], strict=True):
            edge = 0
            for k, size in enumerate(self.powers):
                a, b = max(o, edge), min(o + n, edge + size)
                if a < b:
                    rows.append((s + a - o, b - a, k, a - edge))
                edge += size
        later = window > 0
        early = np.array(rows, np.int64).reshape(-1, 4).T
        return tuple(np.concatenate([e, x[later]]) for e, x in zip(early, (start, length, window + len(self.powers) - 1, offset), strict=True))


PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokenizer: str | None = None, end_id: int = 1, size: int = SIZE, targets: dict[str, float] | None = None, max_queues: int | None = None, with_ids: bool = False, units: int = CACHE) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset and (with_ids) token_ids. units:
    how many units of text a worker remembers the ids of; fewer take less memory and more time."""
    file = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    source = F.coalesce(F.col(source_col).cast("string"), F.lit("")) if source_col.lower() in [c.lower() for c in df.columns] else F.lit("")
    queue = lambda c: c
    if max_queues is not None and df.select(source.alias("q")).distinct().limit(max_queues + 1).count() > max_queues:
        queue = lambda c: F.concat(F.lit("#"), F.pmod(F.xxhash64(c), F.lit(max_queues)).cast("string"))
        if targets:
            wanted = df.sparkSession.createDataFrame([(q, max(0.0, float(g))) for q, g in targets.items()], "q string, g double")
            targets = {r.q: r.g for r in wanted.groupBy(queue(F.col("q")).alias("q")).agg(F.sum("g").alias("g")).collect()}
    doc = spread(df.select(F.col(id_col).alias("i"), queue(source).alias("q"), F.col(text_col).alias("t")))
    kind = dict(df.dtypes)[id_col]

    dtype = encoder(file).dtype

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc, at = TaskContext.get().partitionId(), encoder(file, units), {}
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in pieces_of(batches):
            ids = [enc.encode(t) + end for t in text_bytes(batch["t"])]
            x = []
            for q, b in zip(batch["q"].to_pylist(), ids, strict=True):
                x.append(at.get(q, 0))
                at[q] = x[-1] + len(b) // enc.width
            yield pa.RecordBatch.from_arrays([batch["i"], batch["q"], pa.array([part] * len(ids), pa.int64()), pa.array(x, pa.int64()), pa.array([len(b) // enc.width for b in ids], pa.int64()), pa.array(ids, pa.binary())], ["i", "q", "part", "x", "n", "ids"])

    coded = materialize(doc.mapInArrow(encode, f"i {kind}, q string, part long, x long, n long, ids binary"), "pack-ids")
    by_part = materialize(coded.groupBy("q", "part").agg(F.sum("n").alias("tokens")), "pack-parts")
    before = Window.partitionBy("q").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("q", "part", F.coalesce(F.sum("tokens").over(before), F.lit(0).cast("long")).alias("base"))
    # one row for each queue
    schedule = Schedule({r.q: r.tokens for r in by_part.groupBy("q").agg(F.sum("tokens").alias("tokens")).collect()}, targets, size)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        names = ["i", *(c.split()[0] for c in PIECE.split(", ")), *["token_ids"] * with_ids]
        for whole in batches:
            for k in range(0, whole.num_rows, 2000):
                batch = whole.slice(k, 2000)
                x, n, ids = batch["x"].to_numpy(), batch["n"].to_numpy(), batch["ids"].to_pylist()
                rows: dict[str, list[int]] = {}
                for i, q in enumerate(batch["q"].to_pylist()):
                    rows.setdefault(q, []).append(i)
                for q, mine in rows.items():
                    at = np.array(mine)[np.argsort(x[mine], kind="stable")]
                    # documents that follow each other in their queue are cut as one
                    for run in np.split(at, np.flatnonzero(x[at[1:]] != x[at[:-1]] + n[at[:-1]]) + 1):
                        first = np.cumsum(n[run]) - n[run]
                        start, _, sequence, offset = schedule.cut(q, int(x[run[0]]), int(n[run].sum()))
                        edges = np.union1d(start, first)
                        length = np.diff(np.append(edges, n[run].sum()))
                        piece, doc = np.searchsorted(start, edges, "right") - 1, np.searchsorted(first, edges, "right") - 1
                        wide = np.frombuffer(b"".join([ids[i] for i in run.tolist()]), dtype).astype("<u4")
                        data = memoryview(wide).cast("B")
                        crcs = [zlib.crc32(data[4 * e : 4 * (e + m)]) for e, m in zip(edges.tolist(), length.tolist(), strict=True)]
                        out = [edges - first[doc], length, np.array(crcs, np.int64), n[run][doc], sequence[piece], offset[piece] + edges - start[piece]]
                        own = [pa.array([wide[e : e + m] for e, m in zip(edges, length, strict=True)], pa.list_(pa.int64()))] if with_ids else []
                        yield pa.RecordBatch.from_arrays([batch["i"].take(pa.array(run[doc])), *(pa.array(c) for c in out), *own], names)

    # The bases have a row for each queue and task: Spark broadcasts them only under its size threshold.
    rows = coded.join(bases, ["q", "part"]).select("i", "q", (F.col("x") + F.col("base")).alias("x"), "n", "ids")
    return rows.mapInArrow(cut, f"i {kind}, {PIECE}" + ", token_ids array<long>" * with_ids).withColumnRenamed("i", id_col)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE: dict[str, str] = {}
