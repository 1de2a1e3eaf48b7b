"""Dropping documents by id, and a bitmap that spares most rows a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written

#: Broadcast ids up to so many, else shuffle.
BROADCAST_IDS = 1_000_000
#: Ids below this one stand for the text of a row without an id.
LEAST_ID = -(1 << 62)
#: Bits of the bitmap: 8 MB, whatever the number of keys. When it fills up, it only lets more rows pass.
BITS = 1 << 26


def spare(df: DataFrame, name: str) -> str:
    """name, or a longer one that no column of df has in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def without_rows(documents: DataFrame, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """documents without the rows that judge names.

    judge gets (doc_id, text) and returns the doc_id of what must go; rows of one doc_id go together. A row
    without doc_id stands for its text: it gets an id below LEAST_ID that is a hash of the text, so it is
    judged like any other, and texts that are equal are judged alike. Ids below LEAST_ID are thus reserved.
    """
    row = spare(documents, "row_id")
    stands_for = F.lit(LEAST_ID - 1) - F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1))
    named = documents.withColumn(row, F.coalesce(F.col("doc_id").cast("long"), stands_for))
    bad = written(judge(named.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row)).distinct(), "dropped")
    return named.join(F.broadcast(bad) if bad.count() <= BROADCAST_IDS else bad, row, "left_anti").drop(row)


def bitmap(keys: DataFrame) -> np.ndarray:
    """Which values of key (a hash), modulo BITS, occur in keys(key): at most BITS / 64 words come to the driver."""
    bit = F.pmod("key", F.lit(BITS))
    words = keys.select((bit / 64).cast("long").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int")).alias("mask"))
    got = words.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(BITS // 64, np.uint64)
    out[got.column("word").to_numpy()] = got.column("mask").to_numpy().view(np.uint64)
    return out


def hits(bits: np.ndarray, keys: pa.Array) -> np.ndarray:
    """For each key whether it may be in the bitmap; never false for one that is."""
    at = keys.to_numpy(zero_copy_only=False).astype(np.int64) & (64 * len(bits) - 1)
    return (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


def maybe_in(rows: DataFrame, bits: np.ndarray) -> DataFrame:
    """rows(key, ...) of which the key may be in the bitmap."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(hits(shared.value, batch.column("key"))))

    return rows.mapInArrow(passed, rows.schema)
