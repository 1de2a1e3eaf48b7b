"""Checksummed segment files: a length, a CRC-32, a sample count and a payload, one after another."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .remote_write import read_varint, varint

#: Segments in a batch of rows.
ROWS = 256
SEGMENTS = "path string, segment long, samples long, payload binary, corrupted boolean"


def write_segment(samples: int, payload: bytes) -> bytes:
    return varint(len(payload)) + varint(zlib.crc32(payload)) + varint(samples) + payload


def read_segments(data: bytes) -> Iterator[tuple[int, bytes, bool]]:
    """(samples, payload, corrupted) in order; reading ends at the first segment that is cut or damaged."""
    at = 0
    while at < len(data):
        try:
            size, at = read_varint(data, at)
            crc, at = read_varint(data, at)
            samples, at = read_varint(data, at)
        except (IndexError, ValueError):
            yield 0, b"", True
            return
        payload = data[at : at + size]
        at += size
        if len(payload) < size or zlib.crc32(payload) != crc:
            yield samples, b"", True
            return
        yield samples, payload, False


def load(spark: SparkSession, path: str) -> DataFrame:
    """Segments of all files under path; a damaged one is a row with `corrupted`, and ends its file.

    A file is one value, so this is for files that were cut at some hundred MB; a log as a table
    (operators/wal.py) has no such bound.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    schema = pa.schema([("path", pa.string()), ("segment", pa.int64()), ("samples", pa.int64()), ("payload", pa.binary()), ("corrupted", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                found = ({"path": name, "segment": k, "samples": n, "payload": p, "corrupted": c} for k, (n, p, c) in enumerate(read_segments(content)))
                while rows := list(islice(found, ROWS)):
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.mapInArrow(run, SEGMENTS)
