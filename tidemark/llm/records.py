"""Token-ID output: length-delimited binary records with masked checksums, and an offset index for shuffled reads.

A shard is a file of records in ascending id order; shards are in ascending order too. A record is
``length:u64 masked_crc(length):u32 payload masked_crc(payload):u32``, little-endian; the payload is
``flags:u8 width:u8 id:i64`` and the token ids as unsigned integers of ``width`` bytes (flag 1: the id is null). The
checksum is crc32, masked by a rotation and an offset so that a checksum of checksums does not collapse. Beside each
shard lies an index of ``offset:u64`` for each record. Each task writes files under names of its own attempt; the
manifest, written by Spark's committer after the tasks, lists the files that count, so lost executors and repeated
tasks leave only files that nothing refers to.

Null texts are empty; a document without tokens still has its end id. Null ids sort first. Repeated ids stay as they are.
An empty table gives an empty manifest; other columns are not looked at. Ids that are not whole numbers are refused.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import text_bytes
from tidemark.llm.tokens import encoder
from tidemark.sources.shared import scratch

MASK_DELTA = 0xA282EAD8
MANIFEST = "shard long, file string, index string, n_records long, n_tokens long, n_bytes long"


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, width: int) -> bytes:
    """One record."""
    payload = struct.pack("<BBq", doc_id is None, width, doc_id or 0) + ids
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked_crc(head)), payload, struct.pack("<I", masked_crc(payload))))


def unframe(data: memoryview | bytes, at: int) -> tuple[int | None, np.ndarray, int]:
    """Document id, token ids and the next record's offset; ValueError where a checksum or the length is wrong."""
    head = bytes(data[at : at + 8])
    if len(head) < 8 or struct.unpack("<I", data[at + 8 : at + 12])[0] != masked_crc(head):
        raise ValueError(f"record at {at}: bad length")
    end = at + 12 + struct.unpack("<Q", head)[0]
    payload = bytes(data[at + 12 : end])
    if len(data) < end + 4 or struct.unpack("<I", data[end : end + 4])[0] != masked_crc(payload):
        raise ValueError(f"record at {at}: bad payload")
    null, width, doc_id = struct.unpack("<BBq", payload[:10])
    return None if null else doc_id, np.frombuffer(payload, f"<u{width}", offset=10), end + 4


#: Schemes of Hadoop's file systems, and what pyarrow calls them.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "hdfs": "hdfs", "viewfs": "viewfs", "abfs": "abfs", "abfss": "abfss", "wasb": "abfs", "wasbs": "abfss"}


def filesystem(uri: str):
    """pyarrow's file system for a path or URI as Spark writes it, and the path in it. Credentials are those that pyarrow
    finds; ValueError for a scheme that it does not know."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    scheme, rest = uri.split("://", 1)
    rest = rest.replace(".blob.core.windows.net", ".dfs.core.windows.net", 1) if scheme.startswith("wasb") else rest
    try:
        return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")
    except pa.ArrowInvalid as e:
        raise ValueError(f"no file system for {scheme}://: {e}") from None


def write_records(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 2, shard_bytes: int = 64 << 20) -> DataFrame:
    """Encodes whole texts, writes shards, indexes and the manifest under path; returns the manifest as read back.

    Shards are ranges of ids of about ``shard_bytes`` of text (smaller ones where there would be fewer than cores, but not
    under a megabyte); one task writes, and later reads, a shard."""
    file = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    if dict(df.dtypes)[id_col] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"records take whole numbers as ids; {id_col} is {dict(df.dtypes)[id_col]}")
    filesystem(path)  # an unknown scheme shows here, not in the tasks

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, enc = TaskContext.get().partitionId(), encoder(file)
        fs, top = filesystem(path)
        name, out, offsets, at, tokens = f"shard-{shard:06d}-{uuid.uuid4().hex}", None, [], 0, 0
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            if out is None and batch.num_rows:
                fs.create_dir(top, recursive=True)
                out = fs.open_output_stream(f"{top}/{name}.records", compression=None)
            for doc_id, text in zip(batch["i"].to_pylist(), text_bytes(batch["t"]), strict=True):
                record = frame(doc_id, (ids := enc.encode(text)) + end, enc.width)
                offsets.append(at)
                out.write(record)
                at += len(record)
                tokens += len(ids) // enc.width + 1
        if out is not None:
            out.close()
            with fs.open_output_stream(f"{top}/{name}.index", compression=None) as f:
                f.write(np.array(offsets, "<u8").tobytes())
            row = [[shard], [f"{name}.records"], [f"{name}.index"], [len(offsets)], [tokens], [at]]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string() if isinstance(x[0], str) else pa.int64()) for x in row], [x.split()[0] for x in MANIFEST.split(", ")])

    spark = df.sparkSession
    doc = df.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    size = doc.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes), min(4 * spark.sparkContext.defaultParallelism, size >> 20))
    rows = doc.repartitionByRange(shards, "i").sortWithinPartitions("i").mapInArrow(write, MANIFEST)
    rows.repartition(1 + shards // 10_000).write.parquet(f"{path}/manifest")  # a row for each shard
    return read_manifest(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row for each shard, with the number of ids in all shards before it (a shard is one row: few rows to order)."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest").withColumn("before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))


def read_records(spark: SparkSession, path: str, id_col: str = "doc_id", shuffle_seed: int | None = None, with_ids: bool = True) -> DataFrame:
    """doc id, start (ids of all documents before it), n_tokens, ids_crc32 and (with_ids) token_ids, from the files.

    With shuffle_seed, each shard's records come in a random order, found by the offset index.
    """
    manifest = read_manifest(spark, path)
    names = [id_col, "start", "n_tokens", "ids_crc32", *["token_ids"] * with_ids]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = filesystem(path)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(f"{top}/{row['index']}") as f:
                    offsets = np.frombuffer(f.read(), "<u8").astype(np.int64)
                edges = np.append(offsets, row["n_bytes"])
                with fs.open_input_file(f"{top}/{row['file']}") as f:
                    for part in _shard(f, edges, row["before"], shuffle_seed, row["shard"]):
                        kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k, _ in zip(part, kinds, names, strict=False)], names)

    shards = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").count()
    schema = f"`{id_col}` long, start long, n_tokens long, ids_crc32 long" + ", token_ids array<long>" * with_ids
    return manifest.repartition(max(1, shards)).mapInArrow(read, schema)


def _shard(f, edges: np.ndarray, before: int, seed: int | None, shard: int) -> Iterator[tuple[list, ...]]:
    """Columns of the records of one shard: runs of a few MB in file order, or single records in a random order."""
    n = len(edges) - 1
    if seed is None:
        runs = np.unique(np.append(np.searchsorted(edges[:-1], np.arange(0, edges[-1], 4 << 20)), n))
        runs = runs if len(runs) and runs[0] == 0 else np.append(0, runs)
        order = [(int(a), int(b)) for a, b in zip(runs[:-1], runs[1:], strict=True)]
    else:
        order = [(int(i), int(i) + 1) for i in np.random.default_rng((seed, shard)).permutation(n)]
    starts = None
    if seed is not None:  # a record's width is in its payload; all records of a shard have the same
        f.seek(int(edges[0]) + 13)
        width = f.read(1)[0]
        starts = before + np.append(0, np.cumsum((np.diff(edges) - 26) // width))
    at = before
    for a, b in order:
        f.seek(int(edges[a]))
        data = f.read(int(edges[b] - edges[a]))
        out: tuple[list, ...] = ([], [], [], [], [])
        offset = 0
        for i in range(a, b):
            doc_id, ids, offset = unframe(data, offset)
            begin = at if starts is None else int(starts[i])
            for column, x in zip(out, (doc_id, begin, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids), strict=True):
                column.append(x)
            at += len(ids)
        yield out


def op3_token_records(spark, sf_dir: str) -> DataFrame:
    path = scratch(spark, "op3-records")
    write_records(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_records(spark, path, with_ids=False)


ORACLE: dict[str, str] = {}
