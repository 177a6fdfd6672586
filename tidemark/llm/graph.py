"""Connected components of a link table, and union-find within one task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.shared import discard, store



def other(key: str) -> Column:
    """A one-to-one image of a whole-number key. A join on it does not take an aggregate's exchange on the key for its
    own: both its sides are plain exchanges then, which the adaptive skew join can split where one key has very many rows."""
    return F.bitwise_not(F.col(key))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of each node of the links (a, b): root is the smallest node reachable.

    Large-star and small-star rounds until nothing changes: each links a node's larger (smaller) neighbours to the
    smallest one known. Smallest neighbours are partial aggregates and joined back so that a node with very many links is
    split over tasks; each round is written to the shared folder and the one before deleted.
    """
    spark = edges.sparkSession
    links, path = store(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    mark = _mark(links)
    while mark[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(other("a").alias("key"), "m")
        large = both.where("b > a").join(least, other("a") == F.col("key")).select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        key = small.select(other("a").alias("key"), "m")
        moved = large.join(key, other("a") == F.col("key")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before = path
        links, path = store(moved.unionByName(small.select("a", F.col("m").alias("b"))).distinct(), name)
        discard(spark, before)
        now = _mark(links)
        if now == mark:
            break
        mark = now
    roots = links.select("b").distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select(F.col("b").alias("node"), F.col("b").alias("root")))


def _mark(links: DataFrame) -> tuple:
    """Number of links and a sum of their hashes: equal for equal sets of links."""
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
    return row.n, row.h


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the links (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(root, before):
            break
    return root
