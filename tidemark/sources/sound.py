"""Sound as blocks of samples: a data source that reads and writes PCM WAV files by byte range.

A block is a row: path or video_id, rate, first (number of its first sample in the recording) and samples. No task holds a
recording: reading holds a block, writing a part of bounded length.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tidemark.sources.shared import filesystem

#: Samples of a block (a megabyte), of a written part, and bytes that one task reads.
BLOCK, PART, RANGE = 1 << 18, 1 << 25, 64 << 20
#: Fixed values of the format: tags of whole numbers, of floats, and of a header that has its tag further on.
WHOLE, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE


@dataclass(frozen=True)
class Layout:
    """Where the samples of a file lie, and how they are written."""

    tag: int
    channels: int
    rate: int
    bits: int
    begin: int
    frames: int

    @property
    def width(self) -> int:
        return self.channels * self.bits // 8


def layout(f, size: int) -> Layout:
    """Reads the chunks of a WAV file (RIFF or RF64) up to its samples. A length of 0 or all ones, as streams have, means
    up to the end of the file."""
    head = f.read(12)
    if len(head) < 12 or head[:4] not in (b"RIFF", b"RF64") or head[8:] != b"WAVE":
        raise ValueError("no WAV file")
    form, long = None, None
    while len(head := f.read(8)) == 8:
        name, length = struct.unpack("<4sI", head)
        at = f.tell()
        if name == b"ds64":
            long = struct.unpack("<Q", f.read(16)[8:])[0]
        elif name == b"fmt ":
            body = f.read(min(length, 40))
            tag, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            form = (struct.unpack("<H", body[24:26])[0] if tag == EXTENSIBLE else tag, channels, rate, bits)
        elif name == b"data":
            if form is None or form[:1] + form[3:] not in ((WHOLE, 8), (WHOLE, 16), (WHOLE, 24), (WHOLE, 32), (FLOAT, 32), (FLOAT, 64)) or not form[1]:
                raise ValueError(f"samples of an unknown form {form}")
            held = long if length == 0xFFFFFFFF and long is not None else length
            held = min(size - at, held) if held not in (0, 0xFFFFFFFF) else size - at
            return Layout(*form, at, held // (form[1] * form[3] // 8))
        f.seek(at + length + length % 2)
    raise ValueError("no samples in the file")


def decoded(data: bytes, form: Layout) -> np.ndarray:
    """One channel of floats, the mean of all; whole numbers are brought to -1 up to 1."""
    if form.tag == FLOAT:
        x = np.frombuffer(data, f"<f{form.bits // 8}").astype(np.float64)
    elif form.bits == 8:
        x = (np.frombuffer(data, "u1").astype(np.float64) - 128) / 128
    elif form.bits == 24:
        b = np.frombuffer(data, "u1").reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / float(1 << 23)
    else:
        x = np.frombuffer(data, f"<i{form.bits // 8}") / float(1 << (form.bits - 1))
    return x.reshape(-1, form.channels).mean(axis=1).astype(np.float32)


@dataclass
class Pieces(InputPartition):
    """Byte ranges (path, size, begin, end) for one task."""

    ranges: list[tuple[str, int, int, int]]


class WaveReader(DataSourceReader):
    def __init__(self, path: str, block: int, span: int):
        self.path, self.block, self.span = path, block, span

    def partitions(self) -> list[Pieces]:
        """Files are listed, not opened; large ones are cut, small ones put together."""
        from pyarrow.fs import FileSelector, FileType

        fs, top = filesystem(self.path)
        found = [fs.get_file_info(top)]
        if found[0].type == FileType.Directory:
            found = fs.get_file_info(FileSelector(top, recursive=True))
        out, held = [Pieces([])], 0
        for info in found:
            inside = info.path.removeprefix(top).split("/")
            if info.type != FileType.File or not info.path.lower().endswith(".wav") or any(p.startswith(("_", ".")) for p in inside):
                continue
            for begin in range(0, info.size, self.span):
                end = min(info.size, begin + self.span)
                if held and held + end - begin > self.span:
                    out.append(Pieces([]))
                    held = 0
                out[-1].ranges.append((info.path, info.size, begin, end))
                held += end - begin
        return out

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(self.path)
        for path, size, begin, end in partition.ranges:
            with fs.open_input_file(path) as f:
                try:
                    form = layout(f, size)
                except ValueError as e:
                    raise ValueError(f"{path}: {e}") from None
                step = self.block * form.width
                # a block is read where its first byte lies, so that all but a file's last are whole
                for k in range(max(0, -(-(begin - form.begin) // step)), max(0, -(-(end - form.begin) // step))):
                    first = k * self.block
                    count = min(self.block, form.frames - first)
                    if count <= 0:
                        break
                    f.seek(form.begin + first * form.width)
                    y = decoded(f.read(count * form.width), form)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path]), pa.array([form.rate], pa.int32()), pa.array([form.channels], pa.int32()), pa.array([first]), pa.ListArray.from_arrays(pa.array([0, len(y)], pa.int32()), pa.array(y))],
                        ["path", "rate", "channels", "first", "samples"],
                    )


@dataclass
class Written(WriterCommitMessage):
    folder: str


class WaveWriter(DataSourceArrowWriter):
    """16-bit files of one channel, one for each part. An attempt writes into its own hidden folder; the commit moves the
    files of those attempts that count, so a repeated task leaves no second copy."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, top = filesystem(self.path)
        folder = f"_attempt-{uuid.uuid4().hex}"
        key, rate, first, parts = None, 0, 0, []

        def close() -> None:
            if key is None:
                return
            data = b"".join(parts)
            fs.create_dir(f"{top}/{folder}", recursive=True)
            with fs.open_output_stream(f"{top}/{folder}/{key[0]}_{first}.wav", compression=None) as out:
                out.write(struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, WHOLE, 1, rate, 2 * rate, 2, 16, b"data", len(data)))
                out.write(data)

        for batch in iterator:
            for k, at in enumerate(zip(*(batch[c].to_pylist() for c in ("video_id", "part", "rate", "first")), strict=True)):
                if at[:2] != key:
                    close()
                    key, rate, first, parts = at[:2], at[2], at[3], []
                y = batch["samples"][k].values.to_numpy(zero_copy_only=False).astype(float)
                parts.append(np.clip(np.rint(np.nan_to_num(y) * 32768), -32768, 32767).astype("<i2").tobytes())
        close()
        return Written(folder)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow.fs import FileSelector

        fs, top = filesystem(self.path)
        for m in messages:
            if m is not None:
                for info in fs.get_file_info(FileSelector(f"{top}/{m.folder}", allow_not_found=True)):
                    fs.move(info.path, f"{top}/{info.base_name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow.fs import FileSelector

        fs, top = filesystem(self.path)
        for m in messages:
            if m is not None and fs.get_file_info(FileSelector(f"{top}/{m.folder}", allow_not_found=True)) is not None:
                if fs.get_file_info(f"{top}/{m.folder}").type.name == "Directory":
                    fs.delete_dir(f"{top}/{m.folder}")


class PcmWave(DataSource):
    """spark.read.format("pcm_wave"): WAV files of whole numbers (8 to 32 bits) or floats, native rate, mean of the channels.

    Options: block (samples a row), range (bytes a task). A file that cannot be read stops the query with its name."""

    @classmethod
    def name(cls) -> str:
        return "pcm_wave"

    def schema(self) -> str:
        return "path string, rate int, channels int, first long, samples array<float>"

    def reader(self, schema) -> WaveReader:
        return WaveReader(self.options["path"], int(self.options.get("block", BLOCK)), int(self.options.get("range", RANGE)))

    def writer(self, schema, overwrite: bool) -> WaveWriter:
        if overwrite:
            raise ValueError("wave files are written into a new folder, or added (mode append)")
        return WaveWriter(self.options["path"])


def write_waves(blocks: DataFrame, path: str, part: int = PART) -> None:
    """Writes blocks (video_id, rate, first, samples) as <video_id>_<first sample>.wav. A file holds the blocks that begin in
    one part of the recording, and a task holds one part at a time, so a long recording is written by many tasks. Rows
    without samples are left out; other numbers than -1 up to 1 are cut to that, what is no number is 0."""
    blocks.sparkSession.dataSource.register(PcmWave)
    rows = blocks.where("video_id IS NOT NULL AND size(samples) > 0").select("video_id", F.expr(f"first div {part}").alias("part"), F.col("rate").cast("int").alias("rate"), "first", "samples")
    rows.repartition("video_id", "part").sortWithinPartitions("video_id", "part", "first").write.format("pcm_wave").mode("append").save(path)


def read_waves(spark: SparkSession, path: str, block: int = BLOCK, span: int = RANGE) -> DataFrame:
    """video_id, rate, first, samples of files named as ``write_waves`` names them, parts counted from the recording's
    beginning."""
    spark.dataSource.register(PcmWave)
    rows = spark.read.format("pcm_wave").option("block", block).option("range", span).load(path)
    named = lambda k: F.regexp_extract("path", r"([0-9]+)_([0-9]+)\.wav$", k).cast("long")
    return rows.select(named(1).alias("video_id"), "rate", (named(2) + F.col("first")).alias("first"), "samples")
