"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

DataFrame functions only. Windows are all runs of words of a document that are as long as an item, at every
start. A window of n shingles that is similar enough to an item of m shingles shares at least
t (n + m) / (1 + t) of them, whatever their order, so starts at which fewer of the window's shingles occur
in the benchmark at all are passed over; that filter is exact. The windows left get 64-bit SimHash
fingerprints. Fingerprints within the radius agree in at least one of BLOCKS blocks up to
RADIUS // BLOCKS flipped bits, so an index over blocks and their neighbours finds all of them. Candidates
are verified by exact weighted Jaccard similarity of shingles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written

#: A pair at similarity 0.8 has an angle under 0.48 and so differs in 9.7 of 64 bits on average, with a
#: deviation of 2.9: more than RADIUS bits differ in about one such pair of a thousand (simulated: 0.3 to
#: 1.5 per thousand; 10 for a window of four shingles in an item of five).
RADIUS, BLOCKS = 19, 10
#: Rows of the benchmark's tables (shingles and index keys) in one broadcast; a larger benchmark is searched
#: part by part.
BROADCAST_ROWS = 500_000
#: Broadcast the places of windows up to so many, else shuffle.
BROADCAST_STARTS = 1_000_000
WORDS = r"[\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(WORDS), F.lit(0))


def shingles_of(words: Column, n: int) -> Column:
    """Hashes of all runs of n words, in order."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(n))))).otherwise(F.array().cast("array<bigint>"))


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.get(F.transform(F.array(value), then), 0)


def weighted(shingles: Column) -> Column:
    """The multiset as a set: the k-th occurrence of a shingle is an element of its own."""

    def occurrences(s: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(s) - 1)
        first = F.filter(places, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        runs = lambda f: F.zip_with(f, F.array_append(F.slice(f, 2, F.size(f)), F.size(s)), lambda a, b: F.transform(F.sequence(F.lit(1), b - a), lambda k: F.xxhash64(F.get(s, a), k)))
        return F.flatten(bound(first, runs))

    plain = F.transform(shingles, lambda h: F.xxhash64(h, F.lit(1)))
    return F.when(F.size(F.array_distinct(shingles)) == F.size(shingles), plain).otherwise(bound(F.array_sort(shingles), occurrences))


def simhash(elements: Column) -> Column:
    """64 majority bits of distinct elements: one that came r times would pull all bits r-fold.

    Counts of the bits j, j + width, j + 2 width, ... are held in lanes of one number, each below half of
    what its lane can hold; so a comparison of all lanes with half of the elements is one addition.
    """
    n = F.size(elements)

    def majority(width: int) -> Column:
        ones = sum(1 << k for k in range(0, 64, width))
        pairs = sum(1 << k for k in range(0, 64, 2 * width))
        top = 1 << (width - 1)
        short = (F.lit(top - 1) - F.floor(n / 2)).cast("long") * F.lit(pairs)

        def bits(lanes: Column) -> Column:
            return F.shiftrightunsigned((lanes.bitwiseAND(F.lit(pairs * ((1 << width) - 1))) + short).bitwiseAND(F.lit(pairs * top)), width - 1)

        def counted(j: Column) -> Column:
            return F.aggregate(elements, F.lit(0).cast("long"), lambda acc, h: acc + F.call_function("shiftrightunsigned", h, j).bitwiseAND(F.lit(ones)))

        found = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.call_function("shiftleft", bound(counted(j), lambda c: bits(c).bitwiseOR(F.shiftleft(bits(F.shiftrightunsigned(c, width)), width))), j))
        return F.aggregate(found, F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(b))

    return F.when(n < 1 << 7, majority(8)).when(n < 1 << 15, majority(16)).otherwise(majority(32))


def _blocks() -> list[tuple[int, int]]:
    """(first bit, width) of BLOCKS nearly equal blocks of 64 bits."""
    edges = [64 * k // BLOCKS for k in range(BLOCKS + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _probe(fingerprint: Column, neighbours: bool) -> Column:
    """Block keys of a fingerprint; with neighbours also those at one flipped bit."""
    assert RADIUS // BLOCKS == 1
    keys = []
    for k, (at, width) in enumerate(_blocks()):
        value = F.shiftrightunsigned(fingerprint, at).bitwiseAND(F.lit((1 << width) - 1)).bitwiseOR(F.lit(k << 16))
        keys += [value] + [value.bitwiseXOR(F.lit(1 << b)) for b in range(width) if neighbours]
    return F.array(*keys)


def _first_block(x: Column) -> Column:
    """The first block in which a difference of fingerprints has at most one bit, as the key's prefix."""
    out = F.lit(-1)
    for k, (at, width) in reversed(list(enumerate(_blocks()))):
        out = F.when(F.bit_count(F.shiftrightunsigned(x, at).bitwiseAND(F.lit((1 << width) - 1))) <= 1, F.lit(k)).otherwise(out)
    return out


def contamination(documents: DataFrame, benchmark: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, item_id, start, n_words, similarity): items of benchmark(item_id, text) in documents(doc_id, text).

    A row for each document and item of which some window of the document, as long as the item, has a
    weighted Jaccard similarity of at least `threshold` on shingles of `words` words (weights are
    occurrences); the best window, the first if several are. Words are runs of letters and digits in
    lower case. An item of fewer words than a shingle is one shingle of its own. A document shorter than
    an item is one window.

    Null, empty and wordless texts match nothing, on either side. Rows without doc_id or item_id can't
    be reported and take no part. Repeated rows give one result; of several texts under one id, each is
    searched and the best window of any counts. A benchmark over BROADCAST_ROWS is searched part by part,
    so that what is broadcast stays bounded.
    """
    raw = benchmark.where("item_id is not null").select("item_id", words_of(F.col("text")).alias("w")).where("size(w) > 0").distinct()
    raw = raw.withColumn("k", F.least(F.size("w"), F.lit(words)))
    keys = 64 + BLOCKS
    total, sizes = raw.agg(F.sum(F.size("w") + keys), F.collect_set("k")).first()
    docs = documents.where("doc_id is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    if not total:
        total, sizes = 0, [words]
    parts = max(1, -(-total // BROADCAST_ROWS))
    out = None
    for part in range(parts):
        chosen = raw if parts == 1 else raw.where(F.pmod(F.xxhash64("item_id", "w"), F.lit(parts)) == part)
        for k in sorted(sizes):
            found = _one(docs, chosen.where(F.col("k") == k), k, threshold)
            out = found if out is None else out.union(found)
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n_words")).alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b.back")).alias("start"), "b.n_words", "b.similarity")


def _spots(docs: DataFrame, items: DataFrame, k: int, threshold: float) -> DataFrame:
    """(doc_id, version, spots): starts at which a window may be similar, by its length and in blocks of as many starts as it has shingles."""
    places = items.select("length", F.explode("sh").alias("h")).distinct()
    shingles = docs.select("doc_id", F.xxhash64("text").alias("version"), words_of(F.col("text")).alias("w"))
    shingles = shingles.select("doc_id", "version", F.size("w").alias("total"), F.posexplode(shingles_of(F.col("w"), k)).alias("at", "h"))
    hits = shingles.join(F.broadcast(places), "h").groupBy("doc_id", "version", "total", "length").agg(F.array_sort(F.collect_set("at")).alias("p"))

    n = F.least("total", "length") - (k - 1)
    need = F.greatest(F.lit(1), F.ceil(threshold * (n + F.col("length") - (k - 1)) / (1 + threshold) - 1e-9).cast("int"))
    hits = hits.withColumns({"n": n, "need": need}).where(F.size("p") >= F.col("need"))
    # The window of the j-th hit as the last of `need` starts after the window before it could, so ranges are disjoint.
    ranges = F.transform(F.sequence(F.col("need") - 1, F.size("p") - 1), lambda j: F.struct(
        F.greatest(F.lit(0), F.get("p", j) - F.col("n") + 1, F.coalesce(F.get("p", F.when(j >= F.col("need"), j - F.col("need"))) + 1, F.lit(0))).alias("low"),
        F.least(F.get("p", j - F.col("need") + 1), F.greatest(F.lit(0), F.col("total") - F.col("length"))).alias("high"),
    ))
    starts = hits.select("doc_id", "version", "length", "n", F.explode(F.filter(ranges, lambda r: r["low"] <= r["high"])).alias("r"))
    starts = starts.select("doc_id", "version", "length", "n", F.explode(F.sequence("r.low", "r.high")).alias("start"))
    blocks = starts.groupBy("doc_id", "version", "length", "n", F.floor(F.col("start") / F.col("n")).cast("int").alias("block")).agg(F.collect_list("start").alias("starts"))
    return blocks.groupBy("doc_id", "version").agg(F.collect_list(F.struct("length", "n", "block", "starts")).alias("spots"))


def _one(docs: DataFrame, raw: DataFrame, k: int, threshold: float) -> DataFrame:
    items = raw.select("item_id", F.size("w").alias("length"), shingles_of(F.col("w"), k).alias("sh"))
    spots = written(_spots(docs, items, k, threshold), "spots")
    few = (spots.agg(F.sum(F.aggregate("spots", F.lit(0).cast("long"), lambda a, s: a + F.size(s["starts"]) + 4))).first()[0] or 0) <= BROADCAST_STARTS
    held = docs.withColumn("version", F.xxhash64("text")).join(F.broadcast(spots) if few else spots, ["doc_id", "version"])
    # Each block takes only its part of the document's shingles along. Words and shingles are bound, so that they are not made for each use.
    part = lambda sh: F.transform("spots", lambda s: F.struct(s["n"].alias("n"), s["block"].alias("block"), s["starts"].alias("starts"), F.slice(sh, s["block"] * s["n"] + 1, 2 * s["n"]).alias("sh")))
    cut = bound(bound(words_of(F.col("text")), lambda w: shingles_of(w, k)), part)
    near = held.select("doc_id", F.explode(cut).alias("b")).select("doc_id", "b.*").select("doc_id", "n", "block", "sh", F.explode("starts").alias("start"))
    windows = near.select("doc_id", "start", (F.col("n") + (k - 1)).alias("n_words"), "n", weighted(F.slice("sh", F.col("start") - F.col("block") * F.col("n") + 1, F.col("n"))).alias("ws"))
    prints = windows.withColumn("fp", bound(F.col("ws"), simhash))

    index = items.select("item_id", F.size("sh").alias("item_n"), weighted(F.col("sh")).alias("item_ws")).withColumn("item_fp", bound(F.col("item_ws"), simhash))
    probes = index.select("item_n", "item_fp", "item_id", "item_ws", F.explode(_probe(F.col("item_fp"), True)).alias("key"))
    apart = F.col("fp").bitwiseXOR(F.col("item_fp"))
    close = F.bit_count(apart) <= RADIUS
    sized = (F.col("n") >= threshold * F.col("item_n")) & (F.col("item_n") >= threshold * F.col("n"))
    asked = prints.withColumn("key", F.explode(_probe(F.col("fp"), False)))
    once = F.shiftright("key", 16) == _first_block(apart)  # a pair may agree in several blocks
    pairs = asked.join(F.broadcast(probes), "key").where(close & sized & once)
    both = F.size(F.array_intersect("ws", "item_ws"))
    verified = pairs.withColumn("both", both)
    similarity = F.col("both") / (F.col("n") + F.col("item_n") - F.col("both"))
    return verified.select("doc_id", "item_id", "start", "n_words", similarity.alias("similarity")).where(F.col("similarity") >= threshold)


SQL = r"""
WITH dw AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL),
iw AS (SELECT row_number() OVER () AS i_id, item_id, w, least(5, len(w)) AS k FROM (
  SELECT DISTINCT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0),
dk AS (SELECT row_number() OVER () AS d_id, doc_id, w, k FROM dw, (SELECT DISTINCT k FROM iw)),
ds AS (SELECT d_id, k, len(w) AS total, i, array_to_string(w[i+1:i+k], ' ') AS s FROM (SELECT d_id, k, w, unnest(range(0, len(w) - k + 1)) AS i FROM dk)),
ic AS (SELECT i_id, item_id, k, length, s, count(*) AS c FROM (
  SELECT i_id, item_id, k, len(w) AS length, array_to_string(w[i+1:i+k], ' ') AS s FROM (SELECT i_id, item_id, k, w, unnest(range(0, len(w) - k + 1)) AS i FROM iw)) GROUP BY ALL),
hits AS (SELECT d_id, i_id, length, k, total, i, s, c FROM ds JOIN ic USING (k, s)),
-- every start of a window that holds a hit: windows without one are not similar
win AS (SELECT DISTINCT d_id, i_id, length, k, total, unnest(range(greatest(0, i - least(total, length) + k), 1 + least(i, greatest(0, total - length)))) AS start FROM hits),
shared AS (SELECT d_id, i_id, start, least(count(*), any_value(c)) AS b FROM win JOIN hits USING (d_id, i_id) WHERE hits.i BETWEEN start AND start + least(win.total, win.length) - win.k GROUP BY d_id, i_id, start, s),
sim AS (SELECT d_id, i_id, start, any_value(n) AS n, any_value(n_words) AS n_words, any_value(m) AS m, sum(b) AS b FROM shared JOIN (
  SELECT d_id, i_id, start, least(total, length) AS n_words, least(total, length) - k + 1 AS n, length - k + 1 AS m FROM win) USING (d_id, i_id, start) GROUP BY ALL),
best AS (SELECT doc_id, item_id, start, n_words, b::DOUBLE / (n + m - b)::DOUBLE AS similarity, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY b::DOUBLE / (n + m - b)::DOUBLE DESC, start) AS r
  FROM sim JOIN dk USING (d_id) JOIN (SELECT DISTINCT i_id, item_id FROM iw) USING (i_id) WHERE b::DOUBLE / (n + m - b)::DOUBLE >= 0.8)
SELECT doc_id, item_id, start::INTEGER AS start, n_words::INTEGER AS n_words, similarity FROM best WHERE r = 1
"""
