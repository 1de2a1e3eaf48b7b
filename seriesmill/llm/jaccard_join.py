"""Near-duplicate join: an LSH forest of MinHash signatures finds candidates, exact Jaccard decides.

1. Each distinct shingle set gets a path of min-hashes in each of `trees` tries. A path is one sortable
   number, so that sorted paths are a trie: sets with a common prefix are neighbours, and a prefix is shortened
   by a shift.
2. Sets that share a prefix of the present length in some trie are in a bucket. Within a bucket, sketches
   (a byte of many min-hashes) tell apart what chance brought together; what may be similar is tied.
3. Tied sets form a group, and in it every pair is verified exactly, in blocks of bounded size. Classes are
   the connected components of verified links only.
4. Prefixes start at the full depth. The similarities of the links found say how many links prefixes of each
   length miss (each link found stands for one over its probability of being found), and prefixes are
   shortened as far as the target recall needs: at most to the length at which even sets that are only just
   similar enough share a prefix with the target recall, whatever the data.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .groups import consecutive
from .scratch import split_hot_keys, text_chunks, written
from .words import mix, shingle_sets

#: Broadcast group membership (some 24 bytes a row) up to this many documents, else shuffle.
BROADCAST_ROWS = 1_000_000
#: Bytes of a sketch for each tree, and bits of a path for each min-hash below the shortest prefix.
SKETCHED, STEP = 2, 8
#: Members of a bucket that one task compares; a larger bucket is split.
PART = 4096
#: Shares of equal bytes in two sketches. From INTERIOR on, one set stands for the other: what is similar to
#: one (0.8) shares 0.65 with the other, and from TIED on sets are tied. Both are several deviations (0.04) off.
INTERIOR, TIED = 0.88, 0.45
#: A block of the exact step holds about so many documents or shingles at most.
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 2_000_000
#: Cells of the dense document by shingle matrix held at once.
CELLS = 8_000_000


@dataclass(frozen=True)
class Forest:
    words: int = 5
    threshold: float = 0.8
    trees: int = 64
    depth: int = 10
    recall: float = 0.999999

    def found(self, similarity: np.ndarray | float, depth: int) -> np.ndarray | float:
        """The probability that sets share a prefix of this length in some tree."""
        return 1 - (1 - similarity**depth) ** self.trees

    def shortest(self) -> int:
        """The longest prefix at which a pair at the threshold is a candidate with the target recall."""
        return next((d for d in range(self.depth, 1, -1) if self.found(self.threshold, d) >= self.recall), 1)

    def lengths(self) -> list[int]:
        """Lengths of prefixes from the full depth to the shortest; a path has room for three steps."""
        low = self.shortest()
        return list(range(min(self.depth, low + 3), low - 1, -1))

    def at_least(self, both: np.ndarray, either: np.ndarray) -> np.ndarray:
        """both / either >= threshold, on integers."""
        return both.astype(np.int64) * 1_000_000 >= either.astype(np.int64) * round(self.threshold * 1_000_000)


SIGNATURES = "doc_id long, set_id string, size long, paths array<long>, sketch binary"


def _signer(forest: Forest):
    full, low_depth = forest.lengths()[0], forest.lengths()[-1]
    rng = np.random.default_rng(7)
    odd = (rng.integers(0, 2**31, (forest.trees, full), dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
    flip = rng.integers(0, 2**32, (forest.trees, full), dtype=np.uint32)
    schema = pa.schema([("doc_id", pa.int64()), ("set_id", pa.string()), ("size", pa.int64()), ("paths", pa.list_(pa.int64())), ("sketch", pa.binary())])
    step, width = np.uint64(STEP), forest.trees * SKETCHED

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            h, at = shingle_sets(batch.column("text"), forest.words)
            size = np.diff(at)
            filled = np.flatnonzero(size > 0)
            low = (h >> np.uint64(32)).astype(np.uint32)
            paths = np.zeros((batch.num_rows, forest.trees), np.uint64)
            sketch = np.zeros((batch.num_rows, width), np.uint8)
            if len(filled):
                for t in range(forest.trees):
                    k = np.full(len(filled), t + 1, np.uint64)
                    for d in range(full):
                        least = mix(np.minimum.reduceat((low ^ flip[t, d]) * odd[t, d], at[filled]).astype(np.uint64))
                        if d < SKETCHED:
                            sketch[filled, t * SKETCHED + d] = (least & np.uint64(255)).astype(np.uint8)
                        if d < low_depth:
                            k = mix(k * np.uint64(0x9FB21C651E98DF25) + least)
                        else:
                            if d == low_depth:
                                k >>= step * np.uint64(full - low_depth)
                            k = (k << step) | (least & np.uint64((1 << STEP) - 1))
                    paths[filled, t] = k
            raw = h.tobytes()
            ids = [hashlib.md5(raw[a * 8 : b * 8]).hexdigest() if b > a else None for a, b in zip(at[:-1], at[1:], strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * forest.trees, pa.int32()), pa.array(paths.view(np.int64).ravel()))
            sketches = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(np.arange(batch.num_rows + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(sketch.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(ids, pa.string()), pa.array(size, pa.int64()), lists, sketches], schema=schema)

    return sign


def tied(sketches: np.ndarray) -> tuple[list[tuple[int, int]], list[int]]:
    """(ties, leaders) of the rows of one bucket: ties that connect all rows that may be similar, at most one a row.

    Each row is compared with the leaders so far. One that none of them stands for becomes a leader.
    """
    root = list(range(len(sketches)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    leaders, rows, ties = [0], np.empty_like(sketches), []
    rows[0] = sketches[0]
    for i in range(1, len(sketches)):
        alike = (rows[: len(leaders)] == sketches[i]).mean(axis=1)
        for j in np.flatnonzero(alike >= TIED).tolist():
            a, b = find(i), find(leaders[j])
            if a != b:
                root[a] = b
                ties.append((i, leaders[j]))
        if alike.max() < INTERIOR:
            rows[len(leaders)] = sketches[i]
            leaders.append(i)
    return ties, leaders


def _tier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ties (a, b) of ids in each part of a bucket; leaders of a split bucket are tied to its first member."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    out: list[tuple[int, int]] = []
    for group in consecutive(batches, ["bucket", "part"]):
        ids, head = group.column("id").to_pylist(), group.column("head")[0].as_py()
        sketches = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(len(ids), -1)
        ties, leaders = tied(sketches)
        out += [(ids[i], ids[j]) for i, j in ties]
        if group.column("parts")[0].as_py() > 1:
            out += [(ids[i], head) for i in leaders if ids[i] != head]
        if len(out) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], schema=schema)


def _ties(texts: DataFrame, forest: Forest, length: int) -> DataFrame:
    """(a, b): pairs that connect all sets that share a prefix of this length and may be similar."""
    prefix = F.shiftrightunsigned("path", STEP * (forest.lengths()[0] - length))
    prefixes = texts.select("id", F.posexplode("paths").alias("tree", "path")).select("id", F.xxhash64("tree", prefix).alias("bucket"))
    shared = prefixes.groupBy("bucket").agg(F.min("id").alias("head"), F.max("id").alias("last")).where("head < last").select("bucket")
    held = written(prefixes.join(shared, "bucket"), "buckets")
    # Tries often agree in a bucket's members: each set of members is looked at once.
    alike = held.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("head"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    once = alike.groupBy("n", "head", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "head", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    members = held.join(once, "bucket").join(texts.select("id", "sketch"), "id")
    parted = members.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("long"))
    dealt = parted.select("bucket", "part", "parts", "head", "id", "sketch").repartition("bucket", "part").sortWithinPartitions("bucket", "part", "id")
    return dealt.mapInArrow(_tier, "a long, b long")


def _links(forest: Forest, length: int):
    """Exact links inside a block pair: for each row its block's links, the smallest id that they lead to, and how
    many links its own stand for (`weight`) and prefixes of each length are expected to miss of these."""
    shorter = [d for d in forest.lengths() if d <= length]
    schema = pa.schema([("id", pa.int64()), ("other", pa.int64()), ("links", pa.int64()), ("weight", pa.float64()), *((f"missed{d}", pa.float64()) for d in shorter)])

    def linked(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, size = len(at) - 1, np.diff(at)
        owner = np.repeat(np.arange(n), size)
        _, code, times = np.unique(h, return_inverse=True, return_counts=True)
        shared = times[code] > 1  # a shingle of one document adds to no intersection
        _, code = np.unique(code[shared], return_inverse=True)
        owner = owner[shared]
        both = np.zeros((n, n), np.float32)
        order = np.argsort(code, kind="stable")
        code, owner = code[order], owner[order]
        width = max(1, CELLS // max(1, n))
        for low in range(0, int(code[-1]) + 1 if len(code) else 0, width):
            a, b = np.searchsorted(code, [low, low + width])
            cell = np.zeros((n, min(width, int(code[-1]) + 1 - low)), np.float32)
            cell[owner[a:b], code[a:b] - low] = 1
            both += cell @ cell.T
        either = size[:, None] + size[None, :] - both
        out = forest.at_least(both, either)
        np.fill_diagonal(out, False)
        return out, np.where(out, both / np.maximum(either, 1), 0)

    def roots(near: np.ndarray, ids: np.ndarray) -> np.ndarray:
        label = ids.copy()
        while True:
            best = np.minimum(label, np.where(near, label[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max))
            if (best == label).all():
                return label
            label = best

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list[np.ndarray]] = []
        rows = 0
        for group in consecutive(batches, ["comp", "i", "j"]):
            ids, block, copies = (group.column(c).to_numpy() for c in ("id", "block", "copies"))
            i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
            near, similarity = linked(*shingle_sets(group.column("text").combine_chunks(), forest.words))
            if i != j:  # pairs of one block are counted where it meets itself
                near &= block[:, None] != block[None, :]
            a, b = np.nonzero(near)
            weight = 1 / forest.found(similarity[a, b], length)
            sums = [np.bincount(a, weights=w, minlength=len(ids)) for w in (weight, *(weight * (1 - forest.found(similarity[a, b], d)) for d in shorter))]
            out.append([ids, roots(near, ids), (near * copies[None, :]).sum(axis=1), *sums])
            rows += len(ids)
            if rows >= 10_000:
                yield finished(out)
                out, rows = [], 0
        if out:
            yield finished(out)

    def finished(out: list[list[np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)).cast(t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return verify


def _verified(docs: DataFrame, texts: DataFrame, forest: Forest, length: int, repeats: bool) -> DataFrame:
    """(id, other, links, weight, missed...): exact links of each set with those it is grouped with, by blocks."""
    groups = connected_components(_ties(texts, forest, length))
    sized = groups.join(texts.groupBy("id").agg(F.sum("copies").alias("copies"), F.sum("size").alias("size")), "id")
    blocks = sized.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / BLOCK_DOCS, F.sum("size") / BLOCK_SHINGLES)).alias("blocks"))
    members = sized.join(blocks, "component").select(F.col("id"), F.col("component").alias("comp"), "copies", F.col("blocks").cast("int").alias("blocks"))
    members = written(members.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")), "members")
    few = members.count() <= BROADCAST_ROWS

    source = docs.where("doc_id is not null").join(F.broadcast(members) if few else members, docs.doc_id == members.id)
    if repeats:
        source = source.dropDuplicates(["id", "text"])
    pairs = (
        source.select("id", "comp", "copies", "block", "text", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
        .select("id", "comp", "copies", F.col("block").cast("long").alias("block"), F.least("block", "with").cast("long").alias("i"), F.greatest("block", "with").cast("long").alias("j"), "text")
        .repartition("comp", "i", "j")
        .sortWithinPartitions("comp", "i", "j")
    )
    missed = ", ".join(f"missed{d} double" for d in forest.lengths() if d <= length)
    return pairs.mapInArrow(_links(forest, length), f"id long, other long, links long, weight double, {missed}")


def enough(found: DataFrame, forest: Forest, length: int) -> int:
    """The longest prefix that misses no more than the target recall allows, by the links found with `length`."""
    lengths = [d for d in forest.lengths() if d <= length]
    total, *missed = found.agg(F.sum("weight"), *(F.sum(f"missed{d}") for d in lengths)).first()
    return next((d for d, m in zip(lengths, missed, strict=True) if (m or 0) <= (1 - forest.recall) * (total or 0)), lengths[-1])


def jaccard_join(documents: DataFrame, forest: Forest = Forest()) -> DataFrame:  # noqa: B008
    """(doc_id, text_id, class_id, n_links), a row for each row of documents(doc_id, text).

    text_id: the smallest doc_id with the same shingle set; class_id: the smallest doc_id that is
    reached over links, which are pairs of documents with Jaccard similarity >= threshold on sets of
    `words`-word shingles; n_links: the number of documents linked with this one, copies included.

    A null or empty text, or one of white space, has no shingles and so no links: its class is its
    own. Texts of fewer than `words` words have one shingle, all their words. Rows without doc_id come
    back with nulls and no links. Rows that repeat a doc_id are copies of one document: their texts
    share a class. No cap is set on any group; a group larger than a block is compared block by block.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with split_hot_keys(documents.sparkSession):
        signed = written(docs.mapInArrow(_signer(forest), SIGNATURES), "signatures")
        known = signed.where("doc_id is not null and set_id is not null")
        texts = written(known.groupBy("set_id").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("paths").alias("paths"), F.first("sketch").alias("sketch")), "sets")
        repeats = known.count() != known.select("doc_id").distinct().count()  # a repeated row must not count as a partner
        lengths = forest.lengths()
        found = written(_verified(docs, texts, forest, lengths[0], repeats), "links")
        needed = enough(found, forest, lengths[0])
        if needed < lengths[0]:
            found = written(_verified(docs, texts, forest, needed, repeats), "links")
        counted = found.groupBy("id").agg(F.sum("links").alias("links"))
        classes = written(connected_components(found.select(F.col("id").alias("a"), F.col("other").alias("b"))), "components")

    by_text = (
        texts.select("set_id", "id", "copies")
        .join(counted, "id", "left")
        .join(classes, "id", "left")
        .select("set_id", F.col("id").alias("text_id"), F.coalesce("component", "id").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    )
    alone = signed.where("doc_id is null or set_id is null").select("doc_id", F.col("doc_id").alias("text_id"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return known.select("doc_id", "set_id").join(by_text, "set_id").select("doc_id", "text_id", "class_id", "n_links").union(alone)


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id
  JOIN sizes p ON p.doc_id = x.doc_id JOIN sizes q ON q.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING count(*) * 10 >= (p.n + q.n - count(*)) * 8
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), sets AS (
  SELECT doc_id, list_sort(list(s)) AS k FROM shingles GROUP BY doc_id
), firsts AS (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS text_id FROM sets
)
SELECT d.doc_id, coalesce(f.text_id, d.doc_id) AS text_id, c.class_id, coalesce(l.n, 0) AS n_links
FROM documents d LEFT JOIN firsts f USING (doc_id)
JOIN (SELECT a, min(b) AS class_id FROM reach GROUP BY a) c ON c.a = d.doc_id
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = d.doc_id
"""
