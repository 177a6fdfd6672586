"""Token counts: exact counts at every prefix of every text by prefix dynamic programming (see tokens.PrefixCounter).

``token_counts`` answers totals, limits and truncation points from each text's table; ``prefix_tables`` stores the count at every prefix as a
compact column, which ``tokens_at`` and ``chars_within`` read, so later budgets need neither the text nor the tokenizer.

Null and empty texts have 0 bytes and 0 tokens; repeated rows each get a row; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import per_batch, text_bytes
from tidemark.llm.tokens import prefix_counter
from tidemark.sources.shared import spread

LIMIT = 1024


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit, fit_chars (code points of the longest prefix within the limit) and prefix_crc32 (of
    the whole prefix table: the count at every code-point prefix, the empty one first, as little-endian 32-bit integers).
    All are read off the table."""
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        dp = prefix_counter(path)
        texts = list(text_bytes(batch["t"]))
        rows = []
        for t in texts:
            counts, fit = dp.counts_and_fit(t, limit)
            n = int(counts[-1])
            rows.append((len(t), n, n > limit, fit, zlib.crc32(counts.astype("<u4").tobytes())))
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([batch["i"], *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["i", "n_bytes", "n_tokens", "over_limit", "fit_chars", "prefix_crc32"])

    doc = spread(df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")))
    return per_batch(doc, count, f"i {dict(df.dtypes)[id_col]}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long, prefix_crc32 long", encodes=True).withColumnRenamed("i", id_col)


def prefix_tables(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """id and ``prefix_counts``: the exact token count of every code-point prefix, as compressed differences."""
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")

    def table(batch: pa.RecordBatch) -> pa.RecordBatch:
        dp = prefix_counter(path)
        packed = [zlib.compress(np.diff(dp.counts(t)).astype("<i4").tobytes(), 1) for t in text_bytes(batch["t"])]
        return pa.RecordBatch.from_arrays([batch["i"], pa.array(packed, pa.binary())], ["i", "prefix_counts"])

    doc = spread(df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")))
    return per_batch(doc, table, f"i {dict(df.dtypes)[id_col]}, prefix_counts binary", encodes=True).withColumnRenamed("i", id_col)


def _unpacked(table: bytes) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.frombuffer(zlib.decompress(table), "<i4"))])


def tokens_at(table: Column, chars: Column | int) -> Column:
    """Tokens of the prefix of ``chars`` code points (of the whole text, if it is shorter)."""

    @F.pandas_udf("long")
    def at(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or k is None else int((c := _unpacked(x))[min(max(int(k), 0), len(c) - 1)]) for x, k in zip(t, n, strict=True)], dtype="Int64")

    return at(table, chars if isinstance(chars, Column) else F.lit(chars).cast("long"))


def chars_within(table: Column, budget: Column | int) -> Column:
    """Code points of the longest prefix of at most ``budget`` tokens."""

    @F.pandas_udf("long")
    def within(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or k is None else int(np.flatnonzero(_unpacked(x) <= max(int(k), 0))[-1]) for x, k in zip(t, n, strict=True)], dtype="Int64")

    return within(table, budget if isinstance(budget, Column) else F.lit(budget).cast("long"))


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE: dict[str, str] = {}
