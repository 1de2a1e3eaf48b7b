"""Toxicity severity by cumulative-link (proportional-odds) regression on sparse text features.

P(grade >= k) = sigmoid(score - cut[k]) for k = 1..K: one weight vector is shared by all thresholds,
and the cuts increase. Features are the presence of hashed words and of their beginnings (the first 5
and 6 bytes, which stand for a stem in compounds), and whether they come twice or four times, so a
text's length does not dilute them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .filters import spare
from .scratch import text_chunks
from .words import U64, Words, column_bytes, mix, slice_hashes, split_words

#: Rows that the model is fitted on at most, chosen by a hash of their doc_id.
FIT_ROWS = 6_000
BITS = 18
#: Texts whose features are made at once.
ROWS = 96
STEMS = (5, 6)
#: A word or stem that comes so often in a text is a feature of its own.
REPEATS = (2, 4)
#: Grades above 0: thirds of toxic texts by the number of markers in them.
GRADES = 3
#: How many features may get a weight by chance, expected over all features that are tested.
FALSE_FEATURES = 0.01
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[*b".,;:!?\"'()[]{}<>-_*"]] = True


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    cuts: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1..K, a column each."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.cuts[None, :], -30, 30)))


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashed features, len + 1 offsets): distinct ones of each text. A text is lowered in A-Z only."""
    data, offsets = column_bytes(column)
    lowered = pa.Array.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(LOWER[data])])
    words: Words = split_words(lowered)
    start, end = words.start.copy(), words.end.copy()
    for _ in range(3):  # signs around a word
        start += (start < end) & PUNCTUATION[words.data[np.minimum(start, len(words.data) - 1)]] if len(start) else 0
        end -= (start < end) & PUNCTUATION[words.data[np.maximum(end - 1, 0)]] if len(start) else 0
    doc = words.document_of_word()
    parts, owners = [slice_hashes(words.data, start, end)], [doc]
    for k in STEMS:
        long = np.flatnonzero(end - start >= k)
        parts.append(mix(slice_hashes(words.data, start[long], start[long] + k) + U64(k)))
        owners.append(doc[long])
    code = (np.concatenate(parts) >> U64(64 - BITS)).astype(np.int64)
    both, times = np.unique((np.concatenate(owners).astype(np.int64) << BITS) | code, return_counts=True)
    parts = [both]
    for k in REPEATS:
        often = both[times >= k]
        parts.append((often >> BITS << BITS) | (mix(often.astype(U64) % U64(1 << BITS) + U64(k << BITS)) >> U64(64 - BITS)).astype(np.int64))
    both = np.unique(np.concatenate(parts))
    return (both & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(both >> BITS, np.arange(len(column) + 1))


def _counts(x: np.ndarray, at: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner of each feature, toxic texts that have a feature, other texts that have it)."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    return owner, np.bincount(x[toxic[owner]], minlength=1 << BITS), np.bincount(x[~toxic[owner]], minlength=1 << BITS)


def informative(x: np.ndarray, at: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Which features are evidence: they occur in toxic texts more often than chance explains.

    By Chernoff's bound, n texts of which a share s is toxic by chance hold c or more toxic ones with
    a probability of at most exp(-n KL(c / n || s)). A feature counts if that, times the number of
    features tested, is at most FALSE_FEATURES. So the more toxic texts there are, the more of them must
    agree: at a share of a tenth some 7, at a half some 24. Most words are too rare to tell; weights
    for them would only fit the sample's noise.
    """
    _, c1, c0 = _counts(x, at, toxic)
    n, s = c1 + c0, float(toxic.mean())
    tested = int((n >= 3).sum())
    if not tested or s in (0.0, 1.0):
        return np.zeros(1 << BITS, bool)
    rate = np.divide(c1, n, out=np.zeros(len(n)), where=n > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = np.where(rate > 0, rate * np.log(rate / s), 0) + np.where(rate < 1, (1 - rate) * np.log((1 - rate) / (1 - s)), 0)
    return (c1 >= 3) & (rate > s) & (n * kl >= np.log(tested / FALSE_FEATURES))


def _marking(x: np.ndarray, at: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Which features are markers: far commoner in toxic texts than in others."""
    _, c1, c0 = _counts(x, at, toxic)
    odds = np.log((c1 + 0.5) / (max(1, toxic.sum()) + 1)) - np.log((c0 + 0.5) / (max(1, (~toxic).sum()) + 1))
    return (odds > 2.5) & (c1 >= 3)


def distinct_rows(x: np.ndarray, at: np.ndarray, keys: int = 16, hashes: int = 12) -> np.ndarray:
    """Which rows to fit on: near copies, which would pass off their chance words as evidence, count once.

    Rows are copies if they agree in all min-hashes of some key: nearly sure at 9 tenths of common
    features, and out of the question at 3 tenths.
    """
    keep = np.ones(len(at) - 1, bool)
    full = np.flatnonzero(np.diff(at) > 0)
    if not len(full):
        return keep
    low = (mix(x.astype(U64) + U64(1)) >> U64(32)).astype(np.uint32)
    rng = np.random.default_rng(17)
    odd, flip = rng.integers(0, 2**31, (keys, hashes), dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, (keys, hashes), dtype=np.uint32)
    for k in range(keys):
        key = np.zeros(len(full), U64)
        for j in range(hashes):
            key = mix(key * U64(0x9FB21C651E98DF25) + np.minimum.reduceat((low ^ flip[k, j]) * odd[k, j], at[full]))
        first = np.zeros(len(full), bool)
        first[np.unique(key, return_index=True)[1]] = True
        keep[full] &= first
    return keep


def _part(x: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of some rows, given as a mask."""
    size = np.diff(at)
    return x[np.repeat(rows, size)], np.append(0, np.cumsum(size[rows]))


def grades(x: np.ndarray, at: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """0 for texts that are not toxic, 1..GRADES for the others, by how many markers they hold.

    Labels have no grades. Markers of one half of the rows grade the other half, so that no row's grade
    is a function of its own label. Texts with equal numbers of markers get equal grades.
    """
    n, half = np.zeros(len(toxic)), np.arange(len(toxic)) % 2 == 0
    for own in (half, ~half):
        marks = _marking(*_part(x, at, ~own), toxic[~own])
        xs, ats = _part(x, at, own)
        n[own] = np.bincount(np.repeat(np.arange(own.sum()), np.diff(ats)), weights=marks[xs], minlength=int(own.sum()))
    out = np.zeros(len(toxic), np.int64)
    if toxic.any():
        out[toxic] = 1 + np.searchsorted(np.quantile(n[toxic], np.arange(1, GRADES) / GRADES), n[toxic], side="left")
    return out


def fit(x: np.ndarray, at: np.ndarray, grade: np.ndarray, ridge: float = 1e-4, rounds: int = 200) -> Model:
    """Maximum likelihood with a small ridge, by full-batch Adam; deterministic.

    All rows weigh the same, so that probabilities are those of texts as common as the fitted ones.
    """
    rows = len(at) - 1
    owner = np.repeat(np.arange(rows), np.diff(at))
    chosen = informative(x, at, grade > 0)[x]
    owner, (used, x) = owner[chosen], np.unique(x[chosen], return_inverse=True)
    base = np.array([(grade >= k).mean().clip(1e-4, 1 - 1e-4) for k in range(1, GRADES + 1)])
    cuts = np.log((1 - base) / base)
    gaps = np.log(np.maximum(np.diff(cuts), 1e-2))
    theta = np.concatenate([np.zeros(len(used)), cuts[:1], gaps])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    weight = 1 / max(1, rows)
    for t in range(1, rounds + 1):
        w, first, gap = theta[: len(used)], theta[len(used)], np.exp(theta[len(used) + 1 :])
        cuts = first + np.append(0, np.cumsum(gap))
        score = np.bincount(owner, weights=w[x], minlength=rows)
        s = 1 / (1 + np.exp(-np.clip(score[:, None] - cuts[None, :], -30, 30)))
        full = np.concatenate([np.ones((rows, 1)), s, np.zeros((rows, 1))], axis=1)
        slope = np.concatenate([np.zeros((rows, 1)), s * (1 - s), np.zeros((rows, 1))], axis=1)
        r = np.arange(rows)
        p = np.maximum(full[r, grade] - full[r, grade + 1], 1e-9)
        d_score = -weight * (slope[r, grade] - slope[r, grade + 1]) / p
        d_cut = np.zeros(GRADES)
        np.add.at(d_cut, np.maximum(grade - 1, 0), np.where(grade > 0, weight * slope[r, grade] / p, 0))
        np.add.at(d_cut, np.minimum(grade, GRADES - 1), np.where(grade < GRADES, -weight * slope[r, grade + 1] / p, 0))
        g_gap = np.cumsum(d_cut[::-1])[::-1][1:] * gap
        g = np.concatenate([np.bincount(x, weights=d_score[owner], minlength=len(used)) + ridge * w / 10, [d_cut.sum()], g_gap])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = theta[: len(used)]
    return Model(weights, theta[len(used)] + np.append(0, np.cumsum(np.exp(theta[len(used) + 1 :]))))


def _featurizer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_chunks(batches, rows=ROWS):
        x, at = features(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x))], names=["toxic", "x"])


def train(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model | None:
    """A model from at most `rows` labelled documents; None if labels(doc_id, toxic) have no toxic or no other ones."""
    chosen = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    some = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    got = some.select("toxic", "text").mapInArrow(_featurizer, "toxic int, x array<int>").toArrow()
    toxic = got.column("toxic").to_numpy() > 0
    if not toxic.any() or toxic.all():
        return None
    lists = got.column("x").combine_chunks()
    at = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
    x = lists.flatten().to_numpy()
    keep = distinct_rows(x, at)
    if toxic[keep].any() and not toxic[keep].all():
        (x, at), toxic = _part(x, at, keep), toxic[keep]
    return fit(x, at, grades(x, at, toxic))


def judged(text: pa.Array, model: Model | None) -> np.ndarray:
    """P(grade >= k) for k = 1..GRADES of each text: 0 for one without any feature that is evidence."""
    p = np.zeros((len(text), GRADES))
    if model is not None and len(text):
        x, at = features(text)
        owner = np.repeat(np.arange(len(text)), np.diff(at))
        p = model.above(np.bincount(owner, weights=model.weights[x], minlength=len(text)))
        p[np.bincount(owner, weights=model.weights[x] != 0, minlength=len(text)) == 0] = 0
    return p


def severity(documents: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, severity, p_toxic, toxic), a row for each row of documents.

    severity: the expected grade, 0 to GRADES; p_toxic: the probability of grade 1 or more; toxic:
    whether that is at least one half. A text without any feature that is evidence gets 0, 0 and false,
    and so null, empty and wordless texts do, and all texts where there is no model or no evidence.
    Repeated rows and rows without doc_id are judged like any other.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, rows=ROWS):
            p = judged(batch.column("text"), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p.sum(axis=1)), pa.array(p[:, 0]), pa.array(p[:, 0] >= 0.5)], names=["doc_id", "severity", "p_toxic", "toxic"])

    source = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    return source.mapInArrow(judge, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, severity double, p_toxic double, toxic boolean")


def not_toxic(documents: DataFrame, model: Model | None) -> DataFrame:
    """The rows of documents that severity does not call toxic, with all their columns, whatever their names."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    plain = isinstance(documents.schema["text"].dataType, StringType)
    name = "text" if plain else spare(documents, "judged_text")
    source = documents if plain else documents.withColumn(name, F.col("text").cast("string"))
    at, width = source.columns.index(name), len(documents.columns)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, name, ROWS):
            kept = judged(batch.column(at), shared.value)[:, 0] < 0.5
            yield batch.select(range(width)).filter(pa.array(kept))

    return source.mapInArrow(passed, documents.schema)
