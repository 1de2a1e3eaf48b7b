"""Repeated long passages: compacted paths of a de Bruijn graph over word k-mers.

The graph's edges are the `window`-word k-mers of the corpus, each with the coordinates (document,
word) where it occurs. As in minimiser-partitioned compaction, a document is read as a chain of paths:
maximal runs of consecutive edges that share one anchor, the `anchor`-word gram of least hash inside
each of them. Equal k-mers have equal anchors, so k-mers meet inside one anchor's part of the graph.

1. Every path is listed with its coordinates and a digest of all its k-mers (a path has some 20).
   An aggregate keeps anchors that occur in two documents, and a join keeps their paths: all other
   k-mers are unique.
2. Equal paths are one node of the compacted graph, with the smallest document that holds it. Where every
   occurrence of a path is followed by the same path, and that one always follows it, the two do not branch;
   runs of such pairs are maximal nonbranching paths. All of a maximal path is in each of its occurrences, so
   it is compacted in the first one, and from here on it is one span, joined to the others by its first part
   (very common ones by broadcast, since there can only be few of those).
3. Where an anchor has several different paths (branches, or passages that end), these are read again at their
   source coordinates and opened into single k-mers, which meet in an aggregate and a join on (anchor,
   k-mer digest). K-mers found so are removed in the path's own smallest document alone, as step 2 removes
   all of the path elsewhere; so they are joined by path and document.
4. Spans are mapped back to every coordinate of every path. Before words are removed, the span at each
   coordinate is verified: a second, cryptographic digest of its text must be that of the span at the source
   coordinate.

Paths meet by 64-bit digests of the anchor and of all k-mers. Texts are only shuffled for documents that a
bitmap of fixed size can't rule out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .filters import bitmap, hits, maybe_in
from .scratch import split_hot_keys, text_chunks, written
from .words import U64, Words, column_bytes, mix, split_words

#: Paths with more than this share of all rows are joined by broadcast.
COMMON = 1_000
P1, P2 = U64(0x9FB21C651E98DF25), U64(0xC2B2AE3D27D4EB4F)


def rolling(w: np.ndarray, n: int, p: np.uint64) -> np.ndarray:
    """A hash of every n consecutive numbers, by doubling: n need not be small."""
    out, have, power, block, step = None, 0, 1, w, p
    todo = n
    while todo:  # block[i] covers w[i:i + power]
        if todo & 1:
            out = block if out is None else out[: len(out) - power] * step + block[have : have + len(out) - power]
            have += power
        todo >>= 1
        if todo:
            block = block[: len(block) - power] * step + block[power:]
            power *= 2
            step = mix(np.array([step + U64(power)], U64))[0] | U64(1)
    return mix(out)


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    have = 1
    while have * 2 <= n:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (n - have)], x[n - have :]) if n > have else x


def paths(words: Words, hashes: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, anchor's word, first k-mer's word, number of k-mers) of each path, in order."""
    n = len(hashes)
    if n < window:
        none = np.zeros(0, np.int64)
        return np.zeros(0, U64), none, none, none
    gram = rolling(hashes, anchor, P1)
    # The least hash decides, then the leftmost place: both depend on the k-mer's own words alone.
    place = (gram & U64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=U64)
    at = (sliding_min(place, window - anchor + 1) & U64(0xFFFFFFFF)).astype(np.int64)
    last = np.repeat(words.first[1:], words.counts)
    here = np.flatnonzero(np.arange(len(at)) + window <= last[: len(at)])
    if not len(here):
        return np.zeros(0, U64), here, here, here
    at = at[here]
    new = np.ones(len(here), bool)
    new[1:] = (here[1:] != here[:-1] + 1) | (at[1:] != at[:-1])
    first = np.flatnonzero(new)
    return gram[at[first]], at[first], here[first], np.diff(np.append(first, len(here)))


def unit_digests(w: np.ndarray, window: int, place: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digest of each path, its k-mers' digests one path after another, their ends)."""
    kmer = rolling(w, window, P2)
    ends = np.cumsum(n)
    order = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)
    each = kmer[order + np.repeat(start, n)]
    # The sum of the k-mers' digests, each times an odd number for its place.
    spot = mix((np.arange(int(n.max()) if len(n) else 0) + 1).astype(U64)) | U64(1)
    shape = mix((place - start).astype(U64) * P1 + n.astype(U64))
    total = np.add.reduceat(each * spot[order], ends - n) if len(n) else np.zeros(0, U64)
    return mix(total ^ shape), each, ends


LISTED = "anchor long, unit long, doc_id long, version long, start int, n int"


def _lister(window: int, anchor: int):
    schema = pa.schema([("anchor", pa.int64()), ("unit", pa.int64()), ("doc_id", pa.int64()), ("version", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            words = split_words(batch.column("text"))
            w = words.hashes()
            a, place, start, n = paths(words, w, window, anchor)
            unit = unit_digests(w, window, place, start, n)[0] if len(n) else np.zeros(0, U64)
            doc = np.searchsorted(words.first, start, side="right") - 1
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a.view(np.int64)), pa.array(unit.view(np.int64)), batch.column("doc_id").take(take), batch.column("version").take(take), pa.array((start - words.first[doc]).astype(np.int32)), pa.array(n.astype(np.int32))],
                schema=schema,
            )

    return listed


OPENED = "anchor long, unit long, low long, check long, kmers array<long>, checks array<long>"


def text_check(words: list[bytes]) -> int:
    """A cryptographic digest of words as they are, in 64 bits."""
    return int.from_bytes(hashlib.blake2b(b" ".join(words), digest_size=8).digest(), "little", signed=True)


def _opener(window: int):
    """Reads paths at their source: a digest of the span and, where `open`, its k-mers and their digests."""
    longs = pa.list_(pa.int64())
    schema = pa.schema([("anchor", pa.int64()), ("unit", pa.int64()), ("low", pa.int64()), ("check", pa.int64()), ("kmers", longs), ("checks", longs)])

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            words = split_words(batch.column("text"))
            kmer = rolling(words.hashes(), window, P2).view(np.int64) if len(words.start) >= window else np.zeros(0, np.int64)
            rows: list[tuple] = []
            for first, low, raw, wanted in zip(words.first.tolist(), *(batch.column(c).to_pylist() for c in ("doc_id", "text", "wanted")), strict=False):
                split = raw.encode().split()
                for x in wanted:
                    at, n = x["start"], x["n"]
                    text = split[at : at + n - 1 + window]
                    more = x["open"]
                    kmers = kmer[first + at : first + at + n].tolist() if more else None
                    rows.append((x["anchor"], x["unit"], low, text_check(text), kmers, [text_check(text[i : i + window]) for i in range(n)] if more else None))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return opened


KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _untouched(bits, with_text: bool):
    """Finishes documents from which nothing can be removed; the others keep their text for the join."""
    schema = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("n_words", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.string())])

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            data, offsets = column_bytes(batch.column("text"))
            raw = data.tobytes()
            open_ = hits(bits.value, batch.column("key")) & batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            n, digest, texts = [], [], []
            for k in range(batch.num_rows):
                part = raw[offsets[k] : offsets[k + 1]]
                words = [] if open_[k] else part.split()
                kept = b" ".join(words)
                n.append(None if open_[k] else len(words))
                digest.append(None if open_[k] else hashlib.sha256(kept).hexdigest())
                texts.append(part.decode() if open_[k] else kept.decode() if with_text else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("version"), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(texts, pa.string())], schema=schema)

    return finished


def _remover(window: int, with_text: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())] + [("kept_text", pa.string())] * with_text)

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            n, gone, digest, texts = [], [], [], []
            for count, done, text, ranges in zip(*(batch.column(c).to_pylist() for c in ("n_words", "kept_sha256", "text", "ranges")), strict=True):
                if done is not None:
                    n.append(count)
                    gone.append(0)
                    digest.append(done)
                    texts.append(text)
                    continue
                words = text.encode().split()
                n.append(len(words))
                spans = [(x["start"], x["start"] + x["n"] - 1 + window, x["check"]) for x in ranges or ()]
                r = np.array([(a, b) for a, b, check in spans if text_check(words[a:b]) == check], np.int64).reshape(-1, 2)
                if len(r):
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, r[:, 0], 1)
                    np.add.at(edge, r[:, 1], -1)
                    out = np.cumsum(edge[:-1]) > 0
                    words = [x for x, o in zip(words, out.tolist(), strict=True) if not o]
                gone.append(n[-1] - len(words))
                kept = b" ".join(words)
                digest.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode() if with_text else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())] + [pa.array(texts, pa.string())] * with_text, schema=schema)

    return removed


def substring_dedup(documents: DataFrame, window: int = 50, anchor: int = 10, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]), a row for each row of documents(doc_id, text).

    Removes each word that is covered by a window of `window` consecutive words which also starts in a
    document of smaller doc_id, on the texts as given. Words are runs of bytes other than space and
    \\x09-\\x0D; kept words are joined by one space. The copy in the smallest document always stays.

    Null, empty and white texts have no words. Rows without doc_id come back unchanged and remove
    nothing elsewhere. Rows that repeat a doc_id are versions of one document and do not affect each
    other. A very long text is one row; no part of it is left out. Needs 1 < anchor < window.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("version", F.xxhash64("text"))
    docs = docs.withColumn("key", F.xxhash64("doc_id", "version"))
    with split_hot_keys(spark):
        removal = _removal(docs.where("doc_id is not null"), window, anchor)
    bits = spark.sparkContext.broadcast(bitmap(removal.select("key")))
    first = docs.mapInArrow(_untouched(bits, with_text), "doc_id long, version long, n_words long, kept_sha256 string, text string")
    both = first.join(removal.drop("key"), ["doc_id", "version"], "left")
    return both.select("doc_id", "n_words", "kept_sha256", "text", "ranges").mapInArrow(_remover(window, with_text), KEPT + (", kept_text string" if with_text else ""))


def _removal(known: DataFrame, window: int, anchor: int) -> DataFrame:
    """(doc_id, version, ranges, key): starts and numbers of k-mers to be removed, and the digest that their text must have."""
    listed = written(known.select("doc_id", "version", "text").mapInArrow(_lister(window, anchor), LISTED), "paths")
    anchors = written(listed.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor"), "anchors")
    found = written(listed.join(anchors, "anchor"), "found")

    units = written(_units(found), "units")
    total = found.count()
    heads = written(_maximal(units), "heads")
    branched = written(units.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor"), "branched")

    whole = heads.select("doc_id", "version", F.struct("start", F.col("span").alias("n"), "anchor", "unit", F.lit(False).alias("open")).alias("x"))
    split = units.join(branched, "anchor").select("doc_id", "version", F.struct("start", "n", "anchor", "unit", F.lit(True).alias("open")).alias("x"))
    sources = written(whole.union(split).groupBy("doc_id", "version").agg(F.collect_list("x").alias("wanted")).withColumn("key", F.xxhash64("doc_id", "version")), "sources")
    texts = maybe_in(known, bitmap(sources.select("key"))).join(sources.drop("key"), ["doc_id", "version"]).dropDuplicates(["doc_id", "version"])
    opened = written(texts.select("doc_id", "text", "wanted").mapInArrow(_opener(window), OPENED), "opened")

    each = opened.where("kmers is not null").select("anchor", "unit", "low", F.posexplode(F.arrays_zip("kmers", "checks")).alias("place", "k")).select("anchor", "unit", "low", "place", F.col("k.kmers").alias("kmer"), F.col("k.checks").alias("check"))
    earliest = each.groupBy("anchor", "kmer").agg(F.min(F.struct(F.col("low").alias("first"), "check")).alias("e")).select("anchor", "kmer", "e.first", F.col("e.check").alias("source"))
    partly = each.join(earliest, ["anchor", "kmer"]).where("first < low").groupBy("anchor", "unit").agg(F.first("low").alias("doc_id"), F.collect_set(F.struct("place", "source")).alias("places"))
    checked = heads.select("anchor", "unit", F.col("doc_id").alias("low"), "span", "rows").join(opened.where("kmers is null").select("anchor", "unit", "check"), ["anchor", "unit"])

    spans = _mapped(found, checked, total).where("doc_id > low").select("doc_id", "version", F.struct("start", F.col("span").alias("n"), "check").alias("r"))
    single = F.transform("places", lambda p: F.struct((F.col("start") + p["place"]).alias("start"), F.lit(1).alias("n"), p["source"].alias("check")))
    singles = found.join(partly, ["anchor", "unit", "doc_id"]).select("doc_id", "version", F.explode(single).alias("r"))
    return written(spans.union(singles).groupBy("doc_id", "version").agg(F.collect_set("r").alias("ranges")).withColumn("key", F.xxhash64("doc_id", "version")), "ranges")


def _units(found: DataFrame) -> DataFrame:
    """A row for each different path: its first coordinates and length, whether another document has it (`again`),
    its number of rows, and the paths that always follow and precede it (null where they differ or are missing)."""
    order = Window.partitionBy("doc_id", "version").orderBy("start")
    own = F.xxhash64("anchor", "unit")
    near = found.withColumn("u", own).dropDuplicates(["doc_id", "version", "start"])
    near = near.withColumns({"next": F.lead(F.struct("u", "start")).over(order), "prev": F.lag(F.struct("u", "start", "n")).over(order)})
    near = near.withColumns({"next": F.when(F.col("next.start") == F.col("start") + F.col("n"), F.col("next.u")), "prev": F.when(F.col("prev.start") + F.col("prev.n") == F.col("start"), F.col("prev.u"))})
    always = lambda c: F.when((F.count(c) == F.count("*")) & (F.min(c) == F.max(c)), F.min(c))
    per = near.groupBy("anchor", "unit", "u").agg(F.min(F.struct("doc_id", "version", "start")).alias("at"), F.max("doc_id").alias("high"), F.first("n").alias("n"), F.count("*").alias("rows"), always("next").alias("next"), always("prev").alias("prev"))
    return per.select("anchor", "unit", "u", "at.*", "n", (F.col("at.doc_id") < F.col("high")).alias("again"), "rows", "next", "prev")


def _maximal(units: DataFrame) -> DataFrame:
    """(anchor, unit, doc_id, version, start, span, rows) of the first part of each maximal nonbranching path that occurs again.

    In every occurrence of a part all other parts are beside it, so the parts' first occurrences are those of
    one occurrence of the whole, one after another in one document: a run of linked rows there.
    """
    order = Window.partitionBy("doc_id", "version").orderBy("start")
    rows = units.where("again").withColumn("before", F.lag(F.struct("u", "next", (F.col("start") + F.col("n")).alias("end"))).over(order))
    linked = (F.col("before.next") == F.col("u")) & (F.col("prev") == F.col("before.u")) & (F.col("before.end") == F.col("start"))
    runs = rows.withColumn("run", F.sum(F.when(linked, 0).otherwise(1)).over(order))
    whole = runs.groupBy("doc_id", "version", "run").agg(F.min(F.struct("start", "anchor", "unit", "rows")).alias("head"), F.sum("n").cast("int").alias("span"))
    return whole.select("head.anchor", "head.unit", "doc_id", "version", "head.start", "span", "head.rows")


def _mapped(found: DataFrame, side: DataFrame, total: int) -> DataFrame:
    """found joined with side on (anchor, unit); of paths with more than a COMMON-th of all rows there are fewer than COMMON."""
    common = side.where(F.col("rows") * COMMON > total).drop("rows")
    rest = found.join(F.broadcast(common.select("anchor", "unit")), ["anchor", "unit"], "left_anti").join(side.where(F.col("rows") * COMMON <= total).drop("rows"), ["anchor", "unit"])
    return found.join(F.broadcast(common), ["anchor", "unit"]).unionByName(rest)


SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, sha256(array_to_string(w[i:i+49], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50)
), seen AS (
  SELECT s, min(doc_id) AS low FROM windows GROUP BY s
), hit AS (
  SELECT doc_id, i FROM windows JOIN seen USING (s) WHERE low < doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM hit
), lost AS (
  SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id
), kept AS (
  SELECT doc_id, len(w) AS n_words, CASE WHEN ps IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda p: NOT list_contains(ps, p)), lambda p: w[p]) END AS k
  FROM words LEFT JOIN lost USING (doc_id)
)
SELECT doc_id, n_words::BIGINT AS n_words, (n_words - len(k))::BIGINT AS n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256 FROM kept
"""
