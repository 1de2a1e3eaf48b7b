"""Vectorised words and shingles of an Arrow column of texts.

A word is a run of bytes other than space and \\x09-\\x0D, unchanged. Everything is computed on the
column's bytes with numpy, so that a word costs tens of nanoseconds and no Python object.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Longer words are hashed one at a time.
LONG_WORD = 512
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit numbers (xor-shift and multiply, twice)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and len + 1 offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]."""
    n = len(starts)
    size = (ends - starts).astype(np.int64)
    out = mix(size.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(1))
    if not n:
        return out
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    live = np.flatnonzero((size > 0) & (size <= LONG_WORD))
    done = 0
    while len(live):
        left = np.minimum(size[live] - done, 8).astype(U64)
        part = eight[starts[live] + done]
        part = part & (U64(0xFFFFFFFFFFFFFFFF) >> (U64(64) - left * U64(8)))
        out[live] = mix((out[live] ^ part) * U64(0xD6E8FEB86659FD93) + U64(done + 1))
        done += 8
        live = live[size[live] > done]
    for i in np.flatnonzero(size > LONG_WORD):
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
        out[i] = np.frombuffer(digest, "<u8")[0]
    return out


@dataclass
class Words:
    """Words of many documents: word w has bytes data[start[w]:end[w]]; document d has words first[d]:first[d + 1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return slice_hashes(self.data, self.start, self.end)

    def document_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def split_words(column: pa.Array) -> Words:
    data, offsets = column_bytes(column)
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(offsets), np.int64))
    inside = ~SPACE[data]
    cut = np.unique(offsets[(offsets > 0) & (offsets < len(data))])
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[cut] = False
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cut - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(data, start, end, np.searchsorted(start, offsets))


def window_hashes(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows that lie in one document, and the word at which each starts."""
    w = words.hashes()
    if len(w) < n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    h = w[: len(w) - n + 1].copy()
    for k in range(1, n):
        h = h * U64(0x9FB21C651E98DF25) + w[k : len(w) - n + 1 + k]
    last = np.repeat(words.first[1:], words.counts)  # the end of each word's document
    at = np.flatnonzero(np.arange(len(h)) + n <= last[: len(h)])
    return mix(h[at]), at


def shingle_sets(column: pa.Array, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-word shingles of each document as (hashes, len + 1 offsets).

    A document of fewer than n words, but at least one, has one shingle: all of its words.
    """
    words = split_words(column)
    docs = len(words.first) - 1
    h, at = window_hashes(words, n)
    owner = words.document_of_word()
    doc = owner[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < n))
    if len(short):
        w = words.hashes()
        extra = np.zeros(len(short), U64)
        for k in range(n - 1):
            has = words.counts[short] > k
            extra[has] = extra[has] * U64(0x9FB21C651E98DF25) + w[words.first[short[has]] + k]
        extra = mix(extra ^ (words.counts[short].astype(U64) << U64(56)))
        h, doc = np.concatenate([h, extra]), np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[keep], doc[keep]
    return h, np.searchsorted(doc, np.arange(docs + 1))
