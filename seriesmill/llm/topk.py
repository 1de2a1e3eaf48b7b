"""Exact top-k inner products: vectors in order of descending length, pruned by Cauchy-Schwarz bounds.

Vectors are rotated onto the singular directions of a sample of the table, so that the first coordinates
hold most of every product; the rotation decides how much is pruned, never what is found. For a query q and a vector v, the product is at most the partial sum over the
first coordinates plus |rest of q| * |rest of v|; what can't reach the query's k-th best score is not
looked at further. Survivors are scored exactly, on integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import written

#: Queries in one pass; more are answered in several passes over the vectors.
QUERY_BLOCK = 4_096
#: About so many of the longest vectors set each query's first bound.
SEEDS = 2_048
#: About so many vectors, chosen by a hash, that the rotation is fitted on.
ROTATION_ROWS = 16_384
ROWS = 2_048
#: Integers up to this are exact as doubles.
EXACT = 2.0**53


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component; null for a vector that is null or has a null or non-finite component."""
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(x, lambda v: F.floor(v * scale).cast("double")))


def _matrix(lists: pa.ListArray, dims: int) -> np.ndarray:
    """Rows of doubles, shorter vectors filled with zeros."""
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(size), dims))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = lists.flatten().to_numpy()
    return out


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products of the paired rows: exact in doubles, or else in Python's integers, held within a long."""
    if not len(q):
        return np.zeros(0, np.int64)
    if np.abs(q).max() * np.abs(v).max() * q.shape[1] < EXACT:
        return np.einsum("ij,ij->i", q, v).astype(np.int64)
    top = 2**63 - 1
    return np.array([max(-top, min(top, sum(int(a) * int(b) for a, b in zip(x, y, strict=True)))) for x, y in zip(q, v, strict=True)], np.int64)


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row; -inf where there are fewer."""
    if scores.shape[1] < k:
        return np.full(len(scores), -np.inf)
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]


def _searcher(ids: np.ndarray, queries: np.ndarray, bound: np.ndarray, rotation: np.ndarray, k: int, head: int):
    dims = queries.shape[1]
    turned = queries @ rotation
    first, rest = turned[:, :head], np.linalg.norm(turned[:, head:], axis=1)
    length = np.linalg.norm(queries, axis=1)
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches come in order of descending length within a partition."""
        least = bound.copy()
        done = False
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)
        for whole in batches:
            if done:  # all that follows is shorter
                break
            for batch in (whole.slice(a, ROWS) for a in range(0, whole.num_rows, ROWS)):
                own = batch.column("vec_id").to_numpy()
                vectors = _matrix(batch.column("v"), dims)
                size = np.linalg.norm(vectors, axis=1)
                slack = 1e-9 * (length * size[0] + 1) * dims  # for rounding: a bound may only err upwards
                live = np.flatnonzero(length * size[0] + slack >= least)
                if not len(live):
                    done = True
                    break
                turn = vectors @ rotation
                reach = first[live] @ turn[:, :head].T + rest[live, None] * np.linalg.norm(turn[:, head:], axis=1)[None, :]
                a, b = np.nonzero((reach + slack[live, None] >= least[live, None]) & (ids[live, None] != own[None, :]))
                a = live[a]
                for at in range(0, len(a), 200_000):
                    x, y = a[at : at + 200_000], b[at : at + 200_000]
                    score = products(queries[x], vectors[y])
                    good = score >= least[x]
                    x, y, score = x[good], y[good], score[good]
                    for q in np.unique(x):
                        i, j = np.searchsorted(x, [q, q + 1])
                        name, s = np.append(best[q][0], own[y[i:j]]), np.append(best[q][1], score[i:j])
                        order = np.lexsort((name, -s))
                        order = order[np.sort(np.unique(name[order], return_index=True)[1])][:k]  # an id counts once
                        best[q] = name[order], s[order]
                        if len(order) == k:
                            least[q] = max(least[q], s[order[-1]])
        n = [len(s) for _, s in best]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(np.concatenate([b[0] for b in best])), pa.array(np.concatenate([b[1] for b in best]))], schema=schema)

    return search


def top_inner_products(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of vectors(vec_id, embedding) with the greatest product for each query.

    Components become floor(scale * x); scores are integer inner products; ties go to the smaller
    vec_id. Queries are the rows where is_query holds; a query's candidates are all rows of another
    vec_id. Vectors that are null or have a null or non-finite component, and rows without vec_id, take
    no part. Repeated rows count once; rows that repeat a vec_id with another vector are queries and
    candidates of one id, of which the best score counts. Shorter vectors are filled with zeros. Scores
    beyond a long are held at its ends. Empty tables give no rows.

    Each pass holds at most QUERY_BLOCK queries, on the driver and in each task; where there are several,
    each pass is written before the next one starts, so memory does not grow with their number.
    """
    spark = vectors.sparkSession
    numbers = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), is_query.alias("q"), integers(F.col("embedding"), scale).alias("v")).where("vec_id is not null and v is not null")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    numbers = numbers.withColumn("norm", norm)
    count, rows, dims = numbers.agg(F.count_if("q"), F.count("*"), F.max(F.size("v"))).first()
    if not count or rows < 2:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims = max(1, dims)
    plain = numbers.select("vec_id", "v")
    sample = _matrix(plain.where(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, rows // ROTATION_ROWS))) == 0).select("v").toArrow().column("v").combine_chunks(), dims)
    gram = sample.T @ sample
    rotation = np.linalg.svd(gram)[0] if np.isfinite(gram).all() else np.eye(dims)
    least = numbers.agg(F.percentile_approx("norm", max(0.0, 1 - SEEDS / rows), 10_000)).first()[0]
    longest = numbers.where(F.col("norm") >= least).limit(2 * SEEDS).select("vec_id", "v").toArrow()
    seeds, seed_ids = _matrix(longest.column("v").combine_chunks(), dims), longest.column("vec_id").to_numpy()
    ordered = plain.withColumn("norm", norm).sortWithinPartitions(F.desc("norm")).select("vec_id", "v")

    passes = max(1, -(-count // QUERY_BLOCK))
    out = None
    for p in range(passes):
        block = numbers.where("q").where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == p).select("vec_id", "v").toArrow()
        if not block.num_rows:
            continue
        ids, queries = block.column("vec_id").to_numpy(), _matrix(block.column("v").combine_chunks(), dims)
        order = np.argsort(ids, kind="stable")
        ids, queries = ids[order], queries[order]
        if len(set(seed_ids.tolist())) == len(seed_ids):
            scores = queries @ seeds.T
            scores[ids[:, None] == seed_ids[None, :]] = -np.inf
            bound = _kth(scores, k)
            bound -= 1e-9 * np.abs(bound) + 1e-6 if np.isfinite(bound).all() else 0
        else:
            bound = np.full(len(ids), -np.inf)
        found = ordered.mapInArrow(_searcher(ids, queries, np.where(np.isfinite(bound), np.floor(bound), -np.inf), rotation, k, max(1, dims // 2)), "query_id long, vec_id long, score long")
        found = written(found, "pass") if passes > 1 else found
        out = found if out is None else out.union(found)
    once = out.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q, v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""
