"""Toxicity: a cumulative-link ordinal regression on sparse text features gives grades and expected severity.

P(grade > k) = sigmoid(w.x - theta_k) with one weight vector for all thresholds theta_0 < theta_1 < theta_2. Features are
logarithmic counts of words and word beginnings that tell toxic labels apart (beginnings catch inflected and compound
forms that no labelled document has). The labels are 0/1, so the grades are a construct: among toxic documents the grade is
1 to 3 by how many words have a feature that is toxic-labelled by majority (1-2, 3-7, 8 or more). Severity is therefore a
scale of how much toxic wording there is, not of an outside judgement; toxic or not is what the labels say.

The fit reads at most ``FIT_ROWS`` labelled documents, chosen by hash of their id (of documents that repeat an id, one, by
hash of its text), and keeps at most ``TERMS`` features, those furthest from chance; term statistics are of that sample.
Scoring reads every whole text. A null or empty text has no terms and is scored by the thresholds alone; rows with a
null id are scored too; of contradicting labels of one id the higher counts; without labels of both kinds, nothing is
toxic. Repeated rows each get a row.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import per_batch, text_bytes, words
from tidemark.sources.shared import materialize, spread

#: Bounds of the fit: labelled rows, terms.
FIT_ROWS, TERMS = 6000, 512
#: Code points of the word beginnings that are features.
STEMS = (4, 5, 6, 7)
#: Words that one worker remembers the features of.
CACHE = 400_000
#: A term must be in this many sampled documents and this far, in standard deviations, from chance.
LEAST_DOCS, LEAST_Z = 5, 5.0
GRADES = (1, 3, 8)


def features(word: bytes) -> list[bytes]:
    """The word, and its beginnings marked by ^ where it is as long."""
    if len(word) < STEMS[0]:
        return [word]
    text = word.decode("utf-8", "ignore")
    return [word, *(b"^" + text[:k].encode("utf-8") for k in STEMS if len(text) >= k)]


class _Index(dict):
    """Feature numbers of words, computed once each."""

    def __init__(self, terms: dict[bytes, int]):
        super().__init__()
        self.terms = terms

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        found = tuple(self.terms[f] for f in features(word) if f in self.terms)
        if len(self) < CACHE and len(word) < 60:
            self[word] = found
        return found


def _counts(text: bytes, index: _Index) -> Counter:
    """How many words have each feature."""
    return Counter(k for found in map(index.__getitem__, words(text)) if found for k in found)


@dataclass
class OrdinalModel:
    terms: dict[bytes, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def __post_init__(self):
        self.index = _Index(self.terms)

    def __reduce__(self):
        return OrdinalModel, (self.terms, self.weights, self.thresholds)

    def above(self, texts: list[bytes]) -> np.ndarray:
        """P(grade > k) of each text (rows) and threshold (columns)."""
        s = np.array([self.raw(t) for t in texts]) if texts else np.zeros(0)
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - s[:, None], -60, 60)))

    def raw(self, text: bytes) -> float:
        return sum(self.weights[i] * math.log2(1 + n) for i, n in _counts(text, self.index).items())


def fit_ordinal(x: np.ndarray, y: np.ndarray, grades: int = 4, ridge: float = 0.05, steps: int = 600, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rising thresholds that maximise the penalised likelihood (Adam on all rows)."""
    n, d = x.shape
    share = np.array([(y > k).mean() for k in range(grades - 1)]).clip(1e-3, 1 - 1e-3)
    first = -np.log(share / (1 - share))
    p = np.concatenate([np.zeros(d), [first[0]], np.log(np.maximum(np.diff(first), 0.05))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    low, high = np.maximum(y - 1, 0), np.minimum(y, grades - 2)
    for t in range(1, steps + 1):
        gaps = np.exp(p[d + 1 :])
        theta = p[d] + np.append(0, np.cumsum(gaps))
        s = x @ p[:d]
        cdf = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        upper = np.where(y == grades - 1, 1.0, cdf(theta[high] - s))
        lower = np.where(y == 0, 0.0, cdf(theta[low] - s))
        mass = np.maximum(upper - lower, 1e-9)
        by_theta = np.zeros(grades - 1)
        np.add.at(by_theta, high, np.where(y == grades - 1, 0, upper * (1 - upper) / mass))
        np.add.at(by_theta, low, np.where(y == 0, 0, -lower * (1 - lower) / mass))
        grad = np.concatenate([x.T @ (upper + lower - 1) - ridge * p[:d], [by_theta.sum()], gaps * np.array([by_theta[k:].sum() for k in range(1, grades - 1)])]) / n
        m += 0.1 * (grad - m)
        v += 0.001 * (grad * grad - v)
        p += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return p[:d], p[d] + np.append(0, np.cumsum(np.exp(p[d + 1 :])))


def fit_toxicity(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> OrdinalModel:
    """The model, fitted on the driver from sparse counts of the sampled documents."""
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("i")).agg((F.max(label_col) > 0).alias("y"))
    sample = marked.orderBy(F.xxhash64("i"), "i").limit(fit_rows)  # the documented bound of the fit
    # at most fit_rows ids are broadcast
    rows = documents.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(sample), "i")
    one = F.max(F.struct(F.xxhash64("t").alias("h"), F.col("t"))).alias("x")  # of documents that repeat an id
    rows = materialize(rows.groupBy("i", "y").agg(one).select("x.t", "y"), "toxicity-fit")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for text, y in zip(text_bytes(batch["t"]), batch["y"].to_pylist(), strict=True):
            seen[y].update({f for w in set(words(text)) for f in features(w)})
        terms = list(seen[0] | seen[1])
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.binary()), pa.array([seen[1][w] for w in terms], pa.int64()), pa.array([seen[0][w] for w in terms], pa.int64())], ["w", "yes", "no"])

    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("y").cast("long")), F.lit(0)).alias("yes")).first()
    if not 0 < size.yes < size.n:
        return OrdinalModel({}, np.zeros(0), np.array([1.0, 2.0, 3.0]) * 60)
    share = size.yes / size.n
    terms = per_batch(rows, count, "w binary, yes long, no long").groupBy("w").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    both = F.col("yes") + F.col("no")
    z = (F.col("yes") - both * share) / F.sqrt(both * (share * (1 - share)))
    best = terms.where((both >= LEAST_DOCS) & (F.abs(z) >= LEAST_Z)).orderBy(F.abs(z).desc(), "w").limit(TERMS).collect()
    index = {bytes(r.w): k for k, r in enumerate(best)}
    major = {index[bytes(r.w)] for r in best if r.yes > r.no}

    def counts(batch: pa.RecordBatch) -> pa.RecordBatch:
        by_word = _Index(index)
        texts = list(text_bytes(batch["t"]))
        found = [_counts(t, by_word) for t in texts]
        uses = [sum(any(k in major for k in by_word[w]) for w in words(t)) for t in texts]
        return pa.RecordBatch.from_arrays([batch["y"], pa.array(uses, pa.int64()), pa.array([list(c) for c in found], pa.list_(pa.int32())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))], ["y", "uses", "k", "n"])

    got = per_batch(rows, counts, "y boolean, uses long, k array<int>, n array<int>").collect()
    x, y = np.zeros((len(got), len(index))), np.zeros(len(got), np.int64)
    for i, r in enumerate(got):
        x[i, r.k] = np.log2(1 + np.array(r.n, float)) if r.k else 0
        if r.y:
            y[i] = max(1, sum(r.uses >= g for g in GRADES))
    return OrdinalModel(index, *fit_ordinal(x, y))


def score_toxicity(df: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, severity (expected grade), p_toxic, grade (most likely) and toxic (p_toxic of a half or more)."""

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        above = model.above(list(text_bytes(batch["t"])))
        each = -np.diff(np.hstack([np.ones((len(above), 1)), above, np.zeros((len(above), 1))]), axis=1)
        return pa.RecordBatch.from_arrays([batch["i"], pa.array(above.sum(axis=1)), pa.array(above[:, 0]), pa.array(each.argmax(axis=1).astype(np.int64)), pa.array(above[:, 0] >= 0.5)], ["i", "severity", "p_toxic", "grade", "toxic"])

    doc = spread(df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")))
    return per_batch(doc, score, f"i {dict(df.dtypes)[id_col]}, severity double, p_toxic double, grade long, toxic boolean").withColumnRenamed("i", id_col)


def drop_toxic(df: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """The rows that are not toxic, with all columns."""

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(model.above(list(text_bytes(batch[text_col])))[:, 0] < 0.5))

    return per_batch(spread(df), keep, df.schema)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_toxicity(documents, fit_toxicity(documents, spark.read.parquet(f"{sf_dir}/labels.parquet")))


ORACLE: dict[str, str] = {}
