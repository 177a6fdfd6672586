"""N-gram Jaccard join: a blocked sparse matrix product of document by n-gram incidence.

A document's set is its distinct 5-word shingles as 64-bit hashes; equal sets are one class, known by a 64-bit hash of
the set. The incidence matrix is dealt out in blocks of shingles (by hash), not of documents, so no group is gathered:

1. each block counts how many classes hold each of its shingles; shingles of one class alone can overlap with nothing.
   Shingles that are frequent in a bounded sample are known to be shared: they go straight to their classes, so no
   block gathers all classes of one shingle (the sample decides the way only, never the result);
2. by class, with the shared shingles rarest first: two sets of similarity s or more share a shingle among the first
   ``n - ceil(s * n) + 1`` of either. Classes whose first shingles are all their own are done;
3. of the others, each first shingle has a list of classes (equal lists count once); classes that share a list are
   joined into candidate groups (links to the smallest only);
4. a group is multiplied whole or list by list, whichever has fewer products, in blocks of at most ``ROWS`` rows and
   about ``PART_MB``: overlap counts accumulate over shared shingles, pairs below the size-derived bound are discarded,
   and only a spanning forest of the links leaves the block.

No pair is listed, nothing is capped and the result is exact up to collisions of hashes: 64 bits for a set; for a shingle
48 bits and the block's number (64 bits or fewer in all: 50 with four blocks).

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. Fewer than five words are one shingle; a null, empty or blank
text has an empty set and links with nothing. Repeated rows and ids each get a row; a null id takes part, and a component
of null ids alone has a null id. An empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.llm.common import LOWER_BYTES, pieces_of, release, text_bytes
from tidemark.llm.graph import components, local_roots, other
from tidemark.sources.shared import discard, materialize, spread, store

N = 5
SIMILARITY = 75  # per cent
#: Rows of a candidate group that one task multiplies with as many others.
ROWS = 1024
#: MB of shingles that one block aims at, MB of a part of a candidate group, and MB of text that are shingled at once.
BLOCK_MB, PART_MB, TEXT_MB = 16, 8, 1
#: The sample that finds frequent shingles: tasks, documents and shingles of each; how many classes of the sample hold a
#: frequent one; how many are kept at most (the most frequent).
SAMPLE_TASKS, SAMPLE_DOCS, SAMPLE_SHINGLES, FREQUENT, MOST_FREQUENT = 16, 512, 1 << 16, 16, 1 << 16

BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_rng = np.random.default_rng(20240229)
_PLACE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A, _B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
LOW = np.uint64((1 << 48) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: shifts and odd multiplications."""
    x = (x ^ (x >> np.uint64(33))) * _A
    x = (x ^ (x >> np.uint64(33))) * _B
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: list[bytes], n: int = N) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data = b"\n".join(texts) + b"\n"
    codes = np.frombuffer(data.translate(LOWER_BYTES), np.uint8)
    inside = ~BLANK[codes]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return [np.zeros(0, np.uint64) for _ in texts]
    at = np.flatnonzero(inside)
    sizes = ends - starts
    place = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    value = (codes[at].astype(np.uint64) + np.uint64(1)) * _PLACE[place & 255]
    if sizes.max() > 256:
        value *= _STEP[(place >> 8) & 63] * (place.astype(np.uint64) >> np.uint64(14) | np.uint64(1))
    word = _mix(np.add.reduceat(value, np.cumsum(sizes) - sizes) + sizes.astype(np.uint64))
    first = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    whole = np.zeros(max(0, len(word) - n + 1), np.uint64)
    for k in range(n):
        whole = _mix(whole + word[k : k + len(whole)] * _STEP[k])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            s = np.sort(whole[a : b - n + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            h = np.array([b - a], np.uint64)
            for k in range(a, b):
                h = _mix(h * _A + word[k : k + 1] * _STEP[k - a : k - a + 1])
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """The class of each shingle set: equal sets have equal ones."""
    return np.array([int(np.bitwise_xor.reduce(_mix(s ^ _STEP[60]))) ^ int(np.add.reduce(_mix(s + _STEP[61]))) for s in sets], np.uint64)


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of some MB, with the place of the first."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size < TEXT_MB << 20):
            size += len(texts[end])
            end += 1
        yield at, texts[at:end]
        at = end


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(x).astype(np.uint64).view(np.int64))


def _rows(kind: pa.DataType, b, ids, n, f, payload) -> pa.RecordBatch:
    size = len(b)
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.nulls(size, kind) if ids is None else ids, pa.nulls(size, pa.int64()) if n is None else pa.array(n, pa.int64()), pa.nulls(size, pa.int64()) if f is None else _long(f), pa.array(payload, pa.binary())], ["b", "i", "n", "f", "payload"])


def _frequent(docs: DataFrame) -> np.ndarray:
    """Sorted shingles that many classes of a bounded sample hold: the first documents of tasks spread over the input."""

    def some(rows: Iterator) -> list[bytes]:
        found: dict[bytes, np.ndarray] = {}
        size = 0
        for row in islice(rows, SAMPLE_DOCS):
            x = shingle_sets([(row.t or "").encode()])[0][: SAMPLE_SHINGLES - size]
            found.setdefault(x.tobytes(), x)
            size += len(x)
            if size >= SAMPLE_SHINGLES:
                break
        return [x.tobytes() for x in found.values()]

    # an RDD, as only it can run some tasks and leave off in the middle of each
    texts = docs.select("t").rdd
    n = texts.getNumPartitions()
    tasks = sorted({i * n // SAMPLE_TASKS for i in range(SAMPLE_TASKS)}) if n else []
    got = docs.sparkSession.sparkContext.runJob(texts, some, tasks) if tasks else []
    h, k = np.unique(np.frombuffer(b"".join(got), "<u8"), return_counts=True)
    most = np.argsort(-k, kind="stable")[:MOST_FREQUENT]
    return np.sort(h[most[k[most] >= FREQUENT]])


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of h are in the sorted known ones."""
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)


def _deal(bits: int, kind: pa.DataType, frequent: np.ndarray):
    """Documents to rows: one for each document (no payload, anywhere), one for each class with its frequent shingles (at
    the class's block), and for each block the other shingles and their classes of a batch (no n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        seen: set[int] = set()
        turn = 0
        for batch in pieces_of(batches):
            texts = list(text_bytes(batch["t"]))
            for at, part in _chunks(texts):
                sets = shingle_sets(part)
                f = _fingerprints(sets)
                n = np.array([len(s) for s in sets])
                ids = batch["i"].slice(at, len(part))
                yield _rows(kind, _mix(np.arange(turn, turn + len(part), dtype=np.uint64)).astype(np.int64) & ((1 << bits) - 1), ids, n, f, [None] * len(part))
                turn += len(part)
                new = []
                for k, x in enumerate(f.tolist()):
                    if n[k] and x not in seen:
                        new.append(k)
                        if len(seen) < 1 << 20:
                            seen.add(x)
                for lo in range(0, len(new), 1 << 16):
                    some = new[lo : lo + (1 << 16)]
                    fs, h = f[some], np.concatenate([sets[k] for k in some])
                    who = np.repeat(np.arange(len(some)), n[some])
                    often = _among(h, frequent)
                    own = np.split(h[often], np.cumsum(np.bincount(who[often], minlength=len(some)))[:-1])
                    yield _rows(kind, (_mix(fs) & np.uint64((1 << bits) - 1)).astype(np.int64), None, n[some], fs, [x.tobytes() for x in own])
                    h, who = h[~often], who[~often].astype(np.uint16)
                    block = (h >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
                    order = np.argsort(block, kind="stable")
                    h, who, block = h[order], who[order], block[order]
                    cut = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(h)]]) if len(h) else np.zeros(1, np.int64)
                    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                        mine, local = np.unique(who[a:b], return_inverse=True)
                        low = np.ascontiguousarray(h[a:b]).view(np.uint8).reshape(-1, 8)[:, :6]
                        blob = np.array([len(mine), b - a], "<u8").tobytes() + fs[mine].tobytes() + low.tobytes() + local.astype("<u2").tobytes()
                        yield _rows(kind, [int(block[a])], None, None, None, [blob])

    return run


def _shared(bits: int, kind: pa.DataType):
    """Blocks to rows by class: its shingles that other classes hold too, with the number of classes."""

    def block_rows(b: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        hs, who, fs, base = [], [], [], 0
        for blob in blobs:
            m, k = np.frombuffer(blob, "<u8", 2).tolist()
            at = 16 + 8 * m
            wide = np.zeros((k, 8), np.uint8)
            wide[:, :6] = np.frombuffer(blob, np.uint8, 6 * k, at).reshape(-1, 6)
            hs.append(wide.view("<u8")[:, 0])
            who.append(np.frombuffer(blob, "<u2", k, at + 6 * k).astype(np.int32) + base)
            fs.append(np.frombuffer(blob, "<u8", m, 16))
            base += m
        h, w, f = np.concatenate(hs), np.concatenate(who), np.concatenate(fs)
        _, first, inverse = np.unique(f, return_index=True, return_inverse=True)
        own = first[inverse] == np.arange(len(f))  # of copies, the first is as good as all
        keep = own[w]
        h, w = h[keep], w[keep]
        order = np.argsort(h)
        h, w = h[order], w[order]
        start = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1, [len(h)]])
        df = np.repeat(np.diff(start), np.diff(start))
        some = df > 1
        h, w, df = h[some] | np.uint64(b << (64 - bits)), w[some], df[some]
        place = (_mix(f) & np.uint64((1 << bits) - 1)).astype(np.int64)
        order = np.lexsort((w, place[w]))
        h, w, df, to = h[order], w[order], df[order], place[w[order]]
        cut = np.concatenate([[0], np.flatnonzero(np.diff(to)) + 1, [len(to)]]) if len(to) else np.zeros(1, np.int64)
        out = []
        for a, c in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            mine, size = np.unique(w[a:c], return_counts=True)
            out.append((int(to[a]), np.array([len(mine)], "<u8").tobytes() + f[mine].tobytes() + size.astype("<u4").tobytes() + h[a:c].tobytes() + np.minimum(df[a:c], 65535).astype("<u2").tobytes()))
        if out:
            yield _rows(kind, [x[0] for x in out], None, None, None, [x[1] for x in out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            blob = batch["n"].is_null()
            yield batch.filter(pc.invert(blob))
            some = batch.filter(blob)
            for b, x in zip(some["b"].to_pylist(), some["payload"].to_pylist(), strict=True):
                held.setdefault(b, []).append(x)
        for b in list(held):
            yield from block_rows(b, held.pop(b))

    return run


def _classes(kind: pa.DataType, similarity: int):
    """Rows by class to classes that may link: shared shingles rarest first; b is how many of them come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        size: dict[int, int] = {}
        own: dict[int, bytes] = {}
        parts = []
        for batch in batches:
            doc, blob = batch["payload"].is_null(), batch["n"].is_null()
            yield batch.filter(doc)
            known = batch.filter(pc.and_(pc.invert(doc), pc.invert(blob)))
            for x, n, h in zip(known["f"].to_pylist(), known["n"].to_pylist(), known["payload"].to_pylist(), strict=True):
                size[x] = n
                if h:
                    own[x] = h
            for x in batch.filter(blob)["payload"].to_pylist():
                m = int(np.frombuffer(x, "<u8", 1)[0])
                f, k = np.frombuffer(x, "<u8", m, 8), np.frombuffer(x, "<u4", m, 8 + 8 * m)
                at, total = 8 + 12 * m, int(k.sum())
                parts.append((f, k, np.frombuffer(x, "<u8", total, at), np.frombuffer(x, "<u2", total, at + 8 * total)))
        if own:  # frequent shingles come last, in the order of their hashes
            f, h = np.array(list(own), np.int64).view(np.uint64), np.frombuffer(b"".join(own.values()), "<u8")
            parts.append((f, np.array([len(x) // 8 for x in own.values()], "<u4"), h, np.full(len(h), 65535, "<u2")))
            own.clear()
        if not parts:
            return
        f, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        owner = np.repeat(inverse, np.concatenate([p[1] for p in parts]))
        h, df = np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])
        parts.clear()
        count = np.bincount(owner, minlength=len(f))
        n = np.array([size[x] for x in f.view(np.int64).tolist()])
        need = -(-n * similarity // 100)  # overlap that a link takes at least
        rows = np.flatnonzero(count >= need)
        keep = (count >= need)[owner]
        owner, h, df = owner[keep], h[keep], df[keep]
        order = np.lexsort((h, df, owner))
        h = h[order]
        end = np.cumsum(count[rows])
        for a in range(0, len(rows), 256):
            part = rows[a : a + 256]
            yield _rows(kind, count[part] - need[part] + 1, None, n[part], f[part], [h[e - count[r] : e].tobytes() for r, e in zip(part.tolist(), end[a : a + 256].tolist(), strict=True)])

    return run


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        k = batch["b"].to_numpy()
        h = [np.frombuffer(x, "<u8", m) for x, m in zip(batch["payload"].to_pylist(), k.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([_long(np.concatenate(h)), _long(np.repeat(batch["f"].to_numpy(), k))], ["h", "f"])


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """Overlap counts of all pairs of two lists of shingle sets (of one with itself): the product of their incidences.

    Common shingles are multiplied densely, a few hundred at a time; rare ones add up pair by pair.
    """
    rows = left if right is None else left + right
    h = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    who = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    order = np.argsort(h, kind="stable")
    h, who = h[order], who[order]
    start = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1]).astype(np.int64) if len(h) else np.zeros(0, np.int64)
    df = np.diff(np.append(start, len(h)))
    a, b = len(left), len(rows) - (0 if right is None else len(left))
    out = np.zeros((a, b), np.int32)
    common = np.flatnonzero(df >= max(8, len(rows) // 32))
    for lo in range(0, len(common), 512):
        part = common[lo : lo + 512]
        dense = np.zeros((len(rows), len(part)), np.float32)
        column = np.repeat(np.arange(len(part)), df[part])
        dense[who[np.concatenate([np.arange(start[c], start[c] + df[c]) for c in part])], column] = 1
        out += (dense[:a] @ (dense if right is None else dense[a:]).T).astype(np.int32)
    rare = (df >= 2) & (df < max(8, len(rows) // 32))
    for d in np.unique(df[rare]).tolist():
        at = start[rare & (df == d)]
        for lo in range(0, len(at), max(1, 200_000 // (d * d))):
            lists = who[at[lo : lo + max(1, 200_000 // (d * d)), None] + np.arange(d)]
            x, y = np.repeat(lists, d, axis=1).ravel(), np.tile(lists, (1, d)).ravel()
            if right is not None:
                cross = (x < a) & (y >= a)
                x, y = x[cross], y[cross] - a
            np.add.at(out, (x, y), 1)
    return out


def _multiply(similarity: int):
    """One block product of a candidate group to a spanning forest of its links."""

    def run(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        f = table["f"].to_numpy()
        n = table["n"].to_numpy()
        sets = [np.frombuffer(x, "<u8") for x in table["payload"].to_pylist()]
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        alone = not len(right)
        if alone and table["cross"][0].as_py():
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        count = overlaps([sets[i] for i in left], None if alone else [sets[i] for i in right])
        other = left if alone else right
        # the size-derived bound: overlap >= s / (1 + s) * (n + m)
        x, y = np.nonzero(count * (100 + similarity) >= similarity * (n[left][:, None] + n[other][None, :]))
        root = local_roots(len(f), left[x], other[y])
        some = np.flatnonzero(root != np.arange(len(f)))
        return pa.table({"a": pa.array(f[some], pa.int64()), "b": pa.array(f[root[some]], pa.int64())})

    return run


def _linked(df: DataFrame, id_col: str, text_col: str, similarity: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """(i, n, f) of each document, and (node, root) of each linked class: the smallest class reachable."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    doc = spread(df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")))
    if size >= 1 << 60:  # the plan does not know its size: measure it
        size = doc.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(1 << 20, 2 * size // (BLOCK_MB << 20)))
    bits = max(1, min(20, (parts - 1).bit_length()))
    schema = f"b long, i {dict(df.dtypes)[id_col]}, n long, f long, payload binary"
    kind = _arrow_type(doc, "i")
    dealt = doc.mapInArrow(_deal(bits, kind, _frequent(doc)), schema).repartition(parts, "b").mapInArrow(_shared(bits, kind), schema)
    held = materialize(dealt.repartition(parts, "b").mapInArrow(_classes(kind, similarity), schema), "jaccard-classes")
    docs, classes = held.where("payload IS NULL").select("i", "n", "f"), held.where("payload IS NOT NULL").select("b", "n", "f", "payload")

    # the list of each first shingle; of equal lists (same classes: same number, smallest and sum of hashes) one is enough
    firsts = classes.select("b", "f", "payload").mapInArrow(_firsts, "h long, f long")
    every = firsts.groupBy("h").agg(F.min("f").alias("a"), F.count("*").alias("k"), F.sum(F.xxhash64("f").cast("decimal(20,0)")).alias("sum")).where("k > 1")
    lists, lists_path = store(every.groupBy("a", "k", "sum").agg(F.min("h").alias("h")).select("h", "a", "k"), "jaccard-lists")
    members = firsts.join(lists, "h")
    groups = components(members.where("a <> f").select("a", F.col("f").alias("b")), "jaccard-candidates")

    # a group is multiplied whole, or list by list where that has fewer products (rows of a block at least for each list)
    bytes_ = classes.select("f", F.octet_length("payload").alias("bytes")).join(groups, F.col("f") == F.col("node"))
    whole = bytes_.groupBy("root").agg(F.count("*").alias("k"), F.sum("bytes").alias("bytes"))
    apart = lists.join(groups, F.col("a") == F.col("node")).groupBy("root").agg(F.sum(F.col("k") * F.greatest("k", F.lit(rows // 4))).alias("products"))
    sizes, sizes_path = store(whole.join(apart, "root").select("root", "k", "bytes", ((F.col("k") > rows) & (F.col("products") < F.col("k") * F.col("k"))).alias("apart")), "jaccard-sizes")
    parts_of = lambda k, b: F.greatest(F.ceil(F.col(k) / rows), F.ceil(F.col(b) / (PART_MB << 20))).cast("int")
    placed = groups.join(sizes.where("NOT apart"), "root").select(F.lit(0).alias("kind"), F.col("root").alias("key"), F.col("node").alias("f"), parts_of("k", "bytes").alias("g"))
    if sizes.where("apart").limit(1).count():
        some = members.join(groups.join(sizes.where("apart"), "root").select(F.col("node").alias("f")), "f", "left_semi")
        some = some.join(classes.select("f", F.octet_length("payload").alias("bytes")), "f")
        split = materialize(some.groupBy("h").agg(F.count("*").alias("k"), F.sum("bytes").alias("bytes")), "jaccard-split")
        placed = placed.unionByName(some.select("h", "f").join(split, "h").select(F.lit(1).alias("kind"), F.col("h").alias("key"), "f", parts_of("k", "bytes").alias("g")))
    # the blocks of a group or list: every two of its parts meet once
    marked = placed.withColumn("p", F.pmod(F.xxhash64("f"), F.col("g")).cast("int")).join(classes.select("n", "f", "payload"), "f")
    pairs = marked.select("*", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("q"))
    blocks = pairs.select("kind", "key", F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"), (F.col("p") > F.col("q")).cast("int").alias("side"), (F.col("p") != F.col("q")).alias("cross"), "n", "f", "payload")
    links = blocks.groupBy("kind", "key", "x", "y").applyInArrow(_multiply(similarity), "a long, b long")
    linked = components(links, "jaccard-links")
    discard(spark, lists_path)
    discard(spark, sizes_path)
    return docs, linked


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: int = SIMILARITY, rows: int = ROWS) -> DataFrame:
    """id, n_shingles and component_id (the smallest id reachable by links) of each document. Smallest ids are taken by
    class, then by component, and joined back so that a class or component of very many rows is split over tasks."""
    docs, linked = _linked(df, id_col, text_col, similarity, rows)
    own = docs.where("n > 0").groupBy("f").agg(F.min("i").alias("least")).join(linked, F.col("f") == F.col("node"), "left").select("f", F.coalesce("root", "f").alias("root"), "least")
    by_root = own.groupBy("root").agg(F.min("least").alias("component_id")).select(other("root").alias("key"), "component_id")
    by_class = own.join(by_root, other("root") == F.col("key")).select(F.col("f").alias("g"), "component_id")
    found = docs.join(by_class, F.col("f") == F.col("g"), "left")
    return found.select(F.col("i").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("i")).alias("component_id"))


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def _with_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, i, t) to (row, i, f), with the class of the text."""
    for batch in batches:
        for k, part in _chunks(list(text_bytes(batch["t"]))):
            yield pa.RecordBatch.from_arrays([batch["row"].slice(k, len(part)), batch["i"].slice(k, len(part)), _long(_fingerprints(shingle_sets(part)))], ["row", "i", "f"])


def keep_representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, the one with the smallest id (a null id only where there is no other); of rows of the
    component that repeat that id, the longest text. Rows of different components all stay, whatever their ids, and so
    does every row without words. Of rows whose id is null or repeated, the class of their set says which component they
    are in; the id alone says it of the others. Columns may have any names: rows travel as one struct."""
    docs, linked = _linked(df, id_col, text_col, SIMILARITY, ROWS)
    some = docs.where("n > 0").join(linked, F.col("f") == F.col("node"), "left").select("i", other("f").alias("g"), F.coalesce("root", "f").alias("root"))
    found = materialize(some.groupBy("root", "i", "g").count().select("root", "i", other("g").alias("f"), "count"), "jaccard-rows")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("i").isNull().alias("none"), F.col("i"))).alias("m")).select(other("root").alias("key"), F.col("m.i").alias("j"))
    best = found.join(first, other("root") == F.col("key")).where(F.col("i").eqNullSafe(F.col("j"))).select("root", "i", "f")
    more = found.groupBy("i").agg(F.sum("count").alias("rows")).where("rows > 1 OR i IS NULL").select(F.col("i").alias("j"))

    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    words = F.coalesce(F.col("t").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    wordless = rows.where(~words).select("row")
    single = best.join(more, F.col("i").eqNullSafe(F.col("j")), "left_anti").select(F.col("i").alias("j"))
    kept = rows.where(words).select("row", "i").join(single, F.col("i") == F.col("j"), "left_semi").select("row")
    others = rows.where(words).join(more, F.col("i").eqNullSafe(F.col("j")), "left_semi")
    marked = others.mapInArrow(_with_class, StructType([rows.schema["row"], rows.schema["i"], StructField("f", LongType())]))
    ours = best.select("root", F.col("i").alias("j"), F.col("f").alias("g"))
    text = F.col("row").getField(text_col)
    order = Window.partitionBy("root").orderBy(F.length(text).desc(), F.xxhash64(text))
    ranked = marked.join(ours, (F.col("f") == F.col("g")) & F.col("i").eqNullSafe(F.col("j"))).withColumn("rank", F.row_number().over(order))
    return wordless.unionByName(kept).unionByName(ranked.where("rank = 1").select("row")).select("row.*")


def op10_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: All pairs of classes that share a shingle: for tables of some thousand documents.
ORACLE = {
    "op10_ngram_jaccard": r"""
WITH RECURSIVE dw AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS row, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
d AS (SELECT row, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS pos, len(ws) AS n FROM dw),
g AS (SELECT row, pos, n, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS s FROM d WINDOW o AS (PARTITION BY row ORDER BY pos)),
sh AS MATERIALIZED (SELECT DISTINCT row, md5(s) AS s FROM g WHERE s IS NOT NULL UNION ALL SELECT row, md5(array_to_string(ws, ' ') || '#') FROM dw WHERE len(ws) BETWEEN 1 AND 4),
sz AS MATERIALIZED (SELECT row, count(*) AS n, md5(string_agg(s, '' ORDER BY s)) AS f FROM sh GROUP BY row),
cls AS MATERIALIZED (SELECT f, min(row) AS c, any_value(n) AS n FROM sz GROUP BY f),
cs AS MATERIALIZED (SELECT c, s FROM sh JOIN sz USING (row) JOIN cls USING (f) WHERE sh.row = c AND s IN (SELECT s FROM sh JOIN sz USING (row) GROUP BY s HAVING count(DISTINCT f) > 1)),
link AS MATERIALIZED (SELECT a, b FROM (SELECT x.c AS a, y.c AS b, count(*) AS k FROM cs x JOIN cs y ON x.s = y.s AND x.c < y.c GROUP BY ALL) JOIN cls p ON p.c = a JOIN cls q ON q.c = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
edges AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT c AS a, c AS b FROM cls UNION SELECT r.a, t.b FROM reach r JOIN edges t ON r.b = t.a),
root AS (SELECT a AS c, min(b) AS r FROM reach GROUP BY a),
ids AS (SELECT r, min(doc_id) AS component_id FROM dw JOIN sz USING (row) JOIN cls USING (f) JOIN root USING (c) GROUP BY r)
SELECT doc_id, coalesce(sz.n, 0)::BIGINT AS n_shingles, CASE WHEN sz.n > 0 THEN component_id ELSE doc_id END AS component_id FROM dw LEFT JOIN sz USING (row) LEFT JOIN cls USING (f) LEFT JOIN root USING (c) LEFT JOIN ids USING (r)""",
}
