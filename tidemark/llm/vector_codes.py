"""Vector code compression: product codes whose codebooks are fitted by Hamerly's form of Lloyd's rounds, in whole numbers.

A component x becomes floor(4096 x); a vector is cut into 8 equal consecutive parts, and each part position has a codebook
of 16 entries that starts as that part of the first vectors. A round assigns every part to its nearest entry and replaces
each entry by its parts' floored mean. For each part two bounds are kept beside its code: an upper one of the distance to
its own entry and one lower bound of the distance to the second nearest. After a round the upper one grows by the way its
entry moved, the lower one shrinks by the farthest way that another entry moved; only where the upper bound is not strictly
under the lower one (first as it is, then made exact) is the part compared with all entries, in whole numbers, and the lower
index wins ties. Bounds are rounded outwards at each step, so the codes are those of full scans.

A round is one pass: each task reads its vectors with codes and bounds, writes them anew to the shared folder, and adds one
row of sums for each part, entry and component; the sums are added up by Spark, and only the codebooks (16 numbers for each
component) come to the driver and go out again. The table of the round before is deleted then. Every vector takes part.

Rows whose vector is null or holds null or non-finite components are dropped. Ties of the smallest ids (repeated rows) are
settled by the vectors; null ids come last, and a null id's row is kept. Where there are fewer than 16 vectors, there are as
many entries. The length is that of the first vector by id; a vector of another length, and every vector where it cannot be
cut into 8, has a null code and error. Numbers too large for 64-bit distances are worked out in exact Python integers; an
error beyond 64 bits raises. An empty table gives an empty result; other columns are not looked at, and no id or label
column may be called code, error, label_error or codebooks (ValueError).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import pieces_of
from tidemark.sources.shared import discard, store

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Whole numbers up to this size have distances (of up to 2^20 components) and sums that fit in 64 bits.
SMALL = 1 << 20


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, np.inf)


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, -np.inf)


def _root_above(squares: np.ndarray) -> np.ndarray:
    return _up(np.sqrt(_up(squares.astype(float))))


def _root_below(squares: np.ndarray) -> np.ndarray:
    return np.maximum(_down(np.sqrt(np.maximum(_down(squares.astype(float)), 0))), 0)


def _squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x to rows of entries (broadcast), as whole numbers."""
    gap = x - entries
    return (gap * gap).sum(axis=-1)


def _fitting(*arrays: np.ndarray) -> tuple[np.ndarray, ...]:
    """The arrays as they are, or as Python integers where 64 bits might not do."""
    if all(a.dtype != object and (not a.size or max(int(a.max()), -int(a.min())) <= SMALL) for a in arrays):
        return arrays
    return tuple(a.astype(object) for a in arrays)


@dataclass
class Bounds:
    """Codes, upper and lower bounds of parts (rows x parts each), and how many were compared with all entries."""

    code: np.ndarray
    upper: np.ndarray
    lower: np.ndarray
    scans: int = 0


def assign(x: np.ndarray, books: np.ndarray, before: Bounds | None = None, moved: np.ndarray | None = None) -> Bounds:
    """Nearest entries of parts. x: rows x parts x width; books: parts x entries x width; moved: parts x entries, at least
    how far each entry went since ``before``."""
    x, books = _fitting(x, books)
    n, parts = x.shape[:2]
    if before is None:
        out, open_ = Bounds(np.zeros((n, parts), np.int64), np.zeros((n, parts)), np.zeros((n, parts))), np.ones((n, parts), bool)
    else:
        out = Bounds(before.code.copy(), before.upper.copy(), before.lower.copy())
        each = np.arange(parts)
        most = moved.argmax(axis=1)
        rest = np.partition(moved, -2, axis=1)[:, -2] if moved.shape[1] > 1 else np.zeros(parts)
        others = np.where(out.code == most, rest, moved[each, most])  # the farthest way of any entry but one's own
        out.upper = _up(out.upper + moved[each, out.code])
        out.lower = _down(out.lower - others)
        open_ = ~(out.upper < out.lower)
        r, p = np.nonzero(open_)
        out.upper[r, p] = _root_above(_squares(x[r, p], books[p, out.code[r, p]]))
        open_ = ~(out.upper < out.lower)
    for p in range(parts):
        r = np.flatnonzero(open_[:, p])
        if len(r):
            far = _squares(x[r, p][:, None, :], books[p])
            own = far.argmin(axis=1)  # the lower index of equal ones
            out.code[r, p] = own
            out.upper[r, p] = _root_above(far[np.arange(len(r)), own])
            out.lower[r, p] = _root_below(np.sort(far, axis=1)[:, 1]) if far.shape[1] > 1 else np.inf
            out.scans += len(r)
    return out


def sums(x: np.ndarray, code: np.ndarray, entries: int) -> np.ndarray:
    """Counts and componentwise sums by part and entry: parts x entries x (1 + width)."""
    n, parts, width = x.shape
    (x,) = _fitting(x)
    out = np.zeros((parts, entries, 1 + width), x.dtype)
    for p in range(parts):
        np.add.at(out[p, :, 0], code[:, p], 1)
        np.add.at(out[p, :, 1:], code[:, p], x[:, p])
    return out


def whole(values: np.ndarray) -> np.ndarray:
    """floor(4096 x) of doubles as whole numbers; Python integers where they are large."""
    scaled = np.floor(values * float(SCALE))
    if not scaled.size or np.abs(scaled).max() < 2.0**62:
        return scaled.astype(np.int64)
    return np.array([int(np.floor(v)) if np.isfinite(v) else int(x) * SCALE for v, x in zip(scaled.ravel(), values.ravel(), strict=True)], object).reshape(scaled.shape)


def digest(books: np.ndarray) -> str:
    """Hash of all entries' components by part, entry and place, as decimals with commas between."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def _packed(rows: np.ndarray) -> pa.Array:
    """The bytes of each row: a state's numbers as plain bytes take the JVM far less than arrays."""
    flat = np.ascontiguousarray(rows).reshape(len(rows), -1)
    return pa.Array.from_buffers(pa.binary(flat.shape[1] * flat.itemsize), len(flat), [None, pa.py_buffer(flat.tobytes())]).cast(pa.binary())


def _unpacked(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _vectors(column: pa.Array, size: int, kind: str) -> np.ndarray:
    """Rows x parts x width of a batch's vectors, as they come or packed by the round before."""
    flat = column.flatten().to_numpy(zero_copy_only=False) if pa.types.is_list(column.type) else _unpacked(column, kind)
    return flat.astype(kind).reshape(-1, PARTS, size // PARTS)


def _bounds(batch: pa.RecordBatch) -> Bounds:
    both = _unpacked(batch["bounds"], "<f8").reshape(-1, 2, PARTS)
    return Bounds(_unpacked(batch["code"], "u1").reshape(-1, PARTS).astype(np.int64), both[:, 0], both[:, 1])


#: A round's table: vectors with codes and bounds, and rows of sums (decimal strings: they may outgrow 64 bits).
STATE = "id {id}, label {label}, v binary, code binary, bounds binary, scans long, at array<int>, total array<string>"


def _round(books: np.ndarray, moved: np.ndarray | None, size: int, kind: str, names: list[str]):
    """One task of a round: vectors with new codes and bounds, and rows of the task's sums at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, scans, last = None, 0, None
        for batch in pieces_of(batches, 4000):
            v = _vectors(batch["v"], size, kind)
            x = whole(v.astype(float))
            now = assign(x, books, None if moved is None else _bounds(batch), moved)
            mine = sums(x, now.code, books.shape[1]).astype(object)
            total, scans, last = mine if total is None else total + mine, scans + now.scans, batch
            state = [_packed(v), _packed(now.code.astype(np.uint8)), _packed(np.stack([now.upper, now.lower], 1))]
            none = [pa.nulls(len(v), t) for t in (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], *state, *none], names)
        if total is not None:
            parts, entries, width = total.shape
            at = [[p, e] for p in range(parts) for e in range(entries)]
            told = [[str(t) for t in total[p, e].tolist()] for p, e in at]
            n = len(at)
            none = [pa.nulls(n, last.schema.field(c).type) for c in ("id", "label")] + [pa.nulls(n, pa.binary())] * 3
            yield pa.RecordBatch.from_arrays([*none, pa.array([scans] + [0] * (n - 1), pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(told, pa.list_(pa.string()))], names)

    return run


def _next(state: DataFrame, books: np.ndarray) -> tuple[np.ndarray, int]:
    """Codebooks of floored means from a round's sums, and how many parts were compared with all entries."""
    rows = state.where("at IS NOT NULL").select("at", F.posexplode("total").alias("place", "t"), "scans")
    added = rows.groupBy("at", "place").agg(F.sum(F.col("t").cast("decimal(38,0)")).alias("t"), F.sum("scans").alias("scans")).collect()
    parts, entries, width = books.shape
    total, scans = np.zeros((parts, entries, 1 + width), object), 0
    for r in added:
        total[r.at[0], r.at[1], r.place] = int(r.t)
        scans += r.scans if r.place == 0 else 0
    count = total[:, :, :1]
    means = np.where(count == 0, books.astype(object), total[:, :, 1:] // np.where(count == 0, 1, count))
    small = not means.size or max(abs(int(means.max())), abs(int(means.min()))) < 1 << 62
    return means.astype(np.int64) if small else means, scans


def vector_codes(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS, told: list[int] | None = None) -> DataFrame:
    """id, label, code (a byte for each part), error (squared distances in whole numbers), label_error (errors added up over
    equal labels, nulls together) and codebooks (hash of all entries). told, a list, gets how many parts each pass compared
    with all entries."""
    spark, kinds = df.sparkSession, dict(df.dtypes)
    single = kinds[vector_col] == "array<float>"
    kind = "<f4" if single else "<f8"
    if {id_col, label_col} & {"code", "error", "label_error", "codebooks"}:
        raise ValueError("no id or label column may be called code, error, label_error or codebooks")
    v = F.col(vector_col)
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), (v if single else v.cast("array<double>")).alias("v"))
    rows = rows.where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(1).select(F.size("v").alias("n")).collect()
    size = first[0].n if first else 0
    fits = (F.size("v") == size) & F.lit(size > 0 and size % PARTS == 0)
    used = rows.where(fits)
    start = [r.v for r in used.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(ENTRIES).collect()]
    names = [c.split()[0] for c in STATE.split(", ")]
    schema = STATE.format(id=kinds[id_col], label=kinds[label_col])
    out = "id {id}, label {label}, code binary, error long".format(id=kinds[id_col], label=kinds[label_col])
    books, state, path, moved = None, used, None, None
    if start:
        books = np.ascontiguousarray(whole(np.array(start, float).reshape(len(start), PARTS, -1)).transpose(1, 0, 2))
        for _ in range(rounds):
            state, before = (stored := store(state.mapInArrow(_round(books, moved, size, kind, names), schema), "vector-codes"))[0], path
            path = stored[1]
            if before:
                discard(spark, before)
            new, scans = _next(state, books)
            if told is not None:
                told.append(scans)
            old, now = _fitting(books, new)
            moved, books = _root_above(_squares(old, now)), new
            state = state.where("at IS NULL")
    final, whole_books = moved, books

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, 4000):
            x = whole(_vectors(batch["v"], size, kind).astype(float))
            now = assign(x, whole_books, None if final is None else _bounds(batch), final)
            a, b = _fitting(x, whole_books)
            error = _squares(a, b[np.arange(PARTS), now.code]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], _packed(now.code.astype(np.uint8)), pa.array([int(e) for e in error], pa.int64())], ["id", "label", "code", "error"])

    if books is None:
        done = used.select("id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"))
        own = F.lit(None).cast("string")
    else:
        done, _ = store(state.mapInArrow(coded, out), "vector-codes-done")
        discard(spark, path) if path else None
        own = F.lit(digest(books))
    others = rows.where(~fits).select("id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"))
    every = done.unionByName(others)
    # joined on a hash of the label, so that neither side is the aggregate's own exchange and a common label is split
    by_label = every.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.xxhash64("label").alias("of"), F.col("label").alias("l"), "label_error")
    joined = every.join(by_label, (F.xxhash64("label") == F.col("of")) & F.col("label").eqNullSafe(F.col("l")), "left")
    return joined.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error", own.alias("codebooks"))


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    found = vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.col("codebooks").alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds one after another, each with every part compared with all entries. floor() of a quotient of whole numbers."""
    floor_div = "((s - ((s % c) + c) % c) // c)"
    books = "b0 AS MATERIALIZED (SELECT p, e, w, x FROM (SELECT p, w, x, dense_rank() OVER (ORDER BY vec_id) - 1 AS e FROM x) WHERE e < 16)"
    steps = [books]
    for r in range(ROUNDS + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, p, min_by(e, d * 16 + e) AS e, min(d) AS d FROM (SELECT vec_id, p, e, sum((x.x - b.x) * (x.x - b.x)) AS d FROM x JOIN b{r} b USING (p, w) GROUP BY ALL) GROUP BY ALL)")
        if r < ROUNDS:
            steps.append(f"m{r} AS MATERIALIZED (SELECT p, e, w, {floor_div} AS x FROM (SELECT p, e, w, sum(x) AS s, count(*) AS c FROM x JOIN a{r} USING (vec_id, p) GROUP BY ALL))")
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT p, e, w, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN m{r} m USING (p, e, w))")
    return f"""
WITH k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda v: floor(4096 * v::DOUBLE)::HUGEINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
x AS MATERIALIZED (SELECT vec_id, i // (n // 8) AS p, i % (n // 8) AS w, v AS x FROM (SELECT vec_id, len(v) AS n, unnest(range(len(v))) AS i, unnest(v) AS v FROM k)),
{", ".join(steps)},
f AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, w)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM f JOIN k USING (vec_id), h"""


ORACLE = {"op11_vector_codes": _sql()}
