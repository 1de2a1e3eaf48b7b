"""Framed segments, as senders and receivers exchange them and as files hold them one after another.

A frame is a mark, a version, a kind, the shard and segment (in version 2 also the head's name), the
payload's length and CRC-32, and the payload. Numbers are varints. What carries frames (a socket, a queue, a
folder of files) is a source of rows with bytes; here bytes become rows and rows bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .remote_write import read_varint, varint

MARK = 0xA5
KINDS = ("segment", "response", "end")
#: Rows in a batch of frames, and bytes beyond which it ends.
ROWS = 256
BYTES = 4 << 20
FRAME = pa.struct([("position", pa.int64()), ("version", pa.int32()), ("kind", pa.string()), ("head", pa.string()), ("shard", pa.int32()), ("segment", pa.int64()), ("samples", pa.int64()), ("payload", pa.binary()), ("corrupted", pa.bool_())])
SCHEMA = "position long, version int, kind string, head string, shard int, segment long, samples long, payload binary, corrupted boolean"


def encode(kind: str, head: str | None, shard: int, segment: int, samples: int, payload: bytes, version: int = 2) -> bytes:
    name = (head or "").encode()
    out = bytes((MARK, version, KINDS.index(kind))) + varint(shard) + varint(segment) + varint(samples)
    if version == 2:
        out += varint(len(name)) + name
    return out + varint(len(payload)) + varint(zlib.crc32(payload)) + payload


def decode(data: bytes) -> Iterator[tuple]:
    """Rows as FRAME has them, in order. A payload with a wrong checksum is a corrupted row; what can't be parted ends the data with one."""
    at, position = 0, 0
    while at < len(data):
        try:
            mark, version, kind = data[at], data[at + 1], data[at + 2]
            if mark != MARK or version not in (1, 2) or kind >= len(KINDS):
                raise ValueError
            shard, at = read_varint(data, at + 3)
            segment, at = read_varint(data, at)
            samples, at = read_varint(data, at)
            head = None
            if version == 2:
                size, at = read_varint(data, at)
                head, at = data[at : at + size].decode(), at + size
            size, at = read_varint(data, at)
            crc, at = read_varint(data, at)
            payload = data[at : at + size]
            if len(payload) < size:
                raise ValueError
        except (ValueError, IndexError):
            yield position, None, None, None, None, None, None, None, True
            return
        at += size
        good = zlib.crc32(payload) == crc
        yield position, version, KINDS[kind], head, shard, segment, samples, payload if good else None, not good
        position += 1


def encode_frames(segments: DataFrame, version: int = 2) -> DataFrame:
    """segments(head, shard, segment, samples, payload) as (head, shard, segment, frame)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, frames, size = 0, [], 0
            rows = zip(*(batch.column(c).to_pylist() for c in ("head", "shard", "segment", "samples")), batch.column("payload"), strict=True)
            for i, (h, s, k, n, p) in enumerate(rows, 1):
                frames.append(encode("segment", h, s, k, n, p.as_py() or b"", version))
                size += len(frames[-1])
                if i == batch.num_rows or size >= BYTES:
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, i - at) for c in range(3)), pa.array(frames, pa.binary())], names=["head", "shard", "segment", "frame"])
                    at, frames, size = i, [], 0

    return segments.select("head", "shard", "segment", "samples", "payload").mapInArrow(run, "head string, shard int, segment long, frame binary")


def decode_frames(received: DataFrame) -> DataFrame:
    """received(source, bytes), each some frames one after another, as (source, position, version, kind, head, shard, segment, samples, payload, corrupted).

    Null and empty bytes have no frames. Works on streams as on tables.
    """
    kind = received.schema["source"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, data in zip(batch.column("source"), batch.column("bytes"), strict=True):
                rows: list[tuple] = []
                size = 0
                for row in decode(data.as_py() or b""):
                    rows.append(row)
                    size += len(row[7] or b"")
                    if len(rows) == ROWS or size >= BYTES:
                        yield _rows(source, rows)
                        rows, size = [], 0
                if rows:
                    yield _rows(source, rows)

    return received.select("source", "bytes").mapInArrow(run, f"source {kind}, {SCHEMA}")


def _rows(source: pa.Scalar, rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(FRAME)]
    return pa.RecordBatch.from_arrays([pa.array([source.as_py()] * len(rows), source.type), *columns], names=["source", *(f.name for f in FRAME)])


def read_files(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Frames of the files in a folder; as a stream, of files as they come."""
    if stream:
        files = spark.readStream.format("binaryFile").schema(spark.read.format("binaryFile").load(path).schema).load(path)
    else:
        files = spark.read.format("binaryFile").load(path)
    return decode_frames(files.select(F.col("path").alias("source"), F.col("content").alias("bytes")))


def received_segments(frames: DataFrame) -> DataFrame:
    """segments(head, shard, segment, samples, crc, payload) of whole segment frames; one that came twice comes once."""
    whole = frames.where("kind = 'segment' and not corrupted").dropDuplicates(["head", "shard", "segment"])
    return whole.select("head", "shard", "segment", "samples", F.crc32("payload").alias("crc"), "payload")


def responses(frames: DataFrame, dest: str) -> DataFrame:
    """(dest, shard, segment, ok): what a receiver answers to each segment frame; frames that can't be told apart get no answer."""
    return frames.where("kind = 'segment'").select(F.lit(dest).alias("dest"), "shard", "segment", (~F.col("corrupted")).alias("ok"))
