"""Embedding near-dedup: a pivot-permutation index.

Every vector is described by its nearest reference points (pivots) in order. Inverted lists hold, for each label and
pivot, the vectors that have it among their nearest ``DEPTH``; two vectors that share ``SHARED`` pivots or more are a
candidate, counted in the list of their first shared pivot alone, and verified by cosine in double precision. Pivots are
numbered from the rarest; two vectors that share that many pivots share one of the first ``DEPTH - SHARED + 1`` of either,
so a vector is not in the lists of its commonest ones.

Equal vectors of a label are one class (by 128 bits of hashes), so copies cost nothing and only ids are joined back. A
long list is split into parts of about ``ROWS`` by hash, of which every two meet in one task; a task multiplies its part
in numpy, counts links and lets out only counts and a spanning forest, never pairs. There are as many pivots as the root of
the number of vectors, so lists grow with the root too; the pivots are a sample of at most ``PIVOT_MB`` (shipped to all
executors), every vector is indexed, and recall against brute force is measured in the tests.

Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label or id, link with
nothing; only vectors of one length are compared. A null id has a null component. Repeated rows are copies of each other.
An empty table gives an empty result; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import pieces_of
from tidemark.llm.graph import components, local_roots
from tidemark.sources.shared import discard, materialize, store

COSINE = 0.93
DEPTH, SHARED = 10, 3
#: Pivots: a multiple of the root of the number of vectors, within bounds (MB of them in single precision).
LEAST_PIVOTS, PIVOT_MB, PER_ROOT = 64, 64, 1.0
ROWS = 512


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _rows(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """i, v, label of each row, and two hashes of v, null where it links with nothing. -0.0 counts as 0.0."""
    rows = df.select(F.col(id_col).alias("i"), F.transform(F.col(vector_col), lambda x: x + F.lit(0).cast(x_type(df, vector_col))).alias("v"), F.col(label_col).alias("label"))
    v = F.col("v")
    fine = F.col("label").isNotNull() & F.col("i").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.withColumn("h1", F.when(fine, F.xxhash64("v"))).withColumn("h2", F.when(fine, F.xxhash64(F.lit(1), "v")))


def x_type(df: DataFrame, column: str):
    """The type of an array column's elements."""
    return df.schema[column].dataType.elementType


def _classes(rows: DataFrame) -> DataFrame:
    """label, h1, h2, v (the vector), id (smallest of its rows), k (rows) of each distinct usable vector."""
    return rows.where("h1 IS NOT NULL").groupBy("label", "h1", "h2").agg(F.min("i").alias("id"), F.count("*").alias("k"), F.first("v").alias("v"))


def _pivots(classes: DataFrame) -> dict[int, np.ndarray]:
    """Unit pivots of each vector length in single precision: a bounded sample by hash."""
    size = classes.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    most = (PIVOT_MB << 20) // (4 * max(1, size.d or 1))
    sample = classes.select("v", F.size("v").alias("d")).orderBy("h1", "h2").limit(int(min(most, max(LEAST_PIVOTS, PER_ROOT * size.n**0.5)))).collect()
    return {d: _unit(np.array([r.v for r in sample if r.d == d], float)).astype(np.float32) for d in {r.d for r in sample}}


def _describe(pivots: dict[int, np.ndarray], depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            sizes = batch["v"].value_lengths().to_numpy()
            flat, ends = batch["v"].flatten().to_numpy(), np.cumsum(sizes)
            sign: list[list[int]] = [[0]] * len(sizes)
            for d in np.unique(sizes).tolist():
                if d in pivots:
                    rows = np.flatnonzero(sizes == d)
                    x = _unit(flat[(ends[rows] - d)[:, None] + np.arange(d)].astype(float)).astype(np.float32)
                    near = -(x @ pivots[d].T)
                    k = min(depth, near.shape[1])
                    best = np.argpartition(near, k - 1, axis=1)[:, :k]
                    for i, r in zip(rows.tolist(), best.tolist(), strict=True):
                        sign[i] = r
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("id", "k", "label", "v")), pa.array(sign, pa.list_(pa.int32()))], ["id", "k", "label", "v", "sign"])

    return run


def _verify(cosine: float, shared: int):
    """One part of an inverted list: links of each class (rows of the other side) and a spanning forest."""

    def run(table: pa.Table) -> pa.Table:
        side, cross = table["side"].to_numpy(), table["cross"][0].as_py()
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if cross else left
        ids, k = table["id"].to_numpy(), table["k"].to_numpy()
        out = {"id": [], "other": [], "links": []}
        if len(left) and len(right):
            pivot = table["pivot"][0].as_py()
            sign = table["sign"].combine_chunks()
            owner, flat = np.repeat(np.arange(len(sign)), sign.value_lengths().to_numpy()), sign.flatten().to_numpy()
            _, column = np.unique(flat, return_inverse=True)
            has = np.zeros((len(sign), int(column.max()) + 1), np.float32)
            has[owner, column] = 1
            low = np.zeros_like(has)
            before = flat < pivot
            low[owner[before], column[before]] = 1
            x = _unit(table["v"].combine_chunks().flatten().to_numpy().astype(float).reshape(len(sign), -1))
            depth = np.minimum(has.sum(axis=1)[left][:, None], has.sum(axis=1)[right][None, :])
            some = (has[left] @ has[right].T >= np.minimum(shared, depth)) & (low[left] @ low[right].T == 0)
            hit = some & (x[left] @ x[right].T >= cosine)
            if not cross:
                np.fill_diagonal(hit, False)
            links = np.zeros(len(ids), np.int64)
            links[left] += hit @ k[right]
            if cross:
                links[right] += hit.T @ k[left]
            a, b = np.nonzero(hit)
            root = local_roots(len(ids), left[a], right[b])
            rows = np.flatnonzero(links)
            out = {"id": ids[rows], "other": ids[root[rows]], "links": links[rows]}
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    return run


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, depth: int = DEPTH, shared: int = SHARED, rows: int = ROWS) -> DataFrame:
    """id, n_links, component_id and kept of each row."""
    spark = df.sparkSession
    source = _rows(df, id_col, vector_col, label_col)
    classes, _ = store(_classes(source), "neardup-classes")
    label_type, vector_type = dict(classes.dtypes)["label"], dict(classes.dtypes)["v"]
    described = classes.select("id", "k", "label", "v").mapInArrow(_describe(_pivots(classes), depth), f"id long, k long, label {label_type}, v {vector_type}, sign array<int>")
    index, index_path = store(described, "neardup-index")
    # pivots by falling rarity: as many rows as pivots
    order = [r.pivot for r in index.select(F.explode("sign").alias("pivot")).groupBy("pivot").count().orderBy("count", "pivot").collect()]
    rank = np.zeros(max(order, default=0) + 1, np.int32)
    rank[order] = np.arange(len(order))

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sign = [sorted(rank[s].tolist()) for s in batch["sign"].to_pylist()]
            first = [s[: len(s) - min(shared, len(s)) + 1] for s in sign]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("id", "k", "label", "v")), pa.array(sign, kind), pa.array(first, kind)], ["id", "k", "label", "v", "sign", "first"])

    entries = index.mapInArrow(ranked, f"id long, k long, label {label_type}, v {vector_type}, sign array<int>, first array<int>").withColumn("d", F.size("v")).withColumn("pivot", F.explode("first")).drop("first")
    sizes, sizes_path = store(entries.groupBy("label", "d", "pivot").count(), "neardup-sizes")
    placed = entries.join(sizes, ["label", "d", "pivot"]).withColumn("g", F.ceil(F.col("count") / rows).cast("int")).withColumn("p", F.pmod(F.xxhash64("id"), F.col("g")).cast("int"))
    pairs = placed.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    key = ["label", "d", "pivot", "x", "y"]
    blocks = pairs.select("label", "d", "pivot", F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"), (F.col("p") > F.col("q")).cast("int").alias("side"), (F.col("p") != F.col("q")).alias("cross"), "id", "k", "v", "sign")
    found = materialize(blocks.groupBy(*key).applyInArrow(_verify(cosine, shared), "id long, other long, links long"), "neardup-links")
    for path in (index_path, sizes_path):
        discard(spark, path)
    linked = components(found.select(F.col("id").alias("a"), F.col("other").alias("b")), "neardup-components")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    own = classes.select("label", "h1", "h2", "id", "k").join(counts, "id", "left").join(linked, F.col("id") == F.col("node"), "left")
    each = own.select(F.col("label").alias("of"), F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.coalesce("root", "id").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("k") - 1).alias("n_links"))
    whole = source.select("i", "label", "h1", "h2").join(each, (F.col("label") == F.col("of")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left")
    component = F.coalesce("root", "i")
    return whole.select(F.col("i").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("i") == component, F.lit(True)).alias("kept"))


def op7_embedding_neardup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All pairs of vectors: for tables of some thousand. The index may miss links (recall 0.9 or more); none were at 0.01.
ORACLE = {
    "op7_embedding_neardup": r"""
WITH RECURSIVE e AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
ok AS MATERIALIZED (SELECT * FROM e WHERE vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM ok x JOIN ok y ON x.label = y.label AND len(x.v) = len(y.v) AND x.vec_id <> y.vec_id WHERE list_dot_product(x.v, y.v) / sqrt(list_dot_product(x.v, x.v)) / sqrt(list_dot_product(y.v, y.v)) >= 0.93::DOUBLE),
reach AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT r.a, t.b FROM reach r JOIN link t ON r.b = t.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM e JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id""",
}
