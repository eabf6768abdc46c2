"""Searches of vectors in blocks: exact top-k by approximation cells, and nearest neighbours by rotated one-bit codes.

Both deal the candidates and the stated queries into blocks of a bounded number of rows and bring each pair of blocks
together by an equi-join on the pair's number (a cogroup), so that no task holds more than two blocks. Each pair gives
the k best of its candidates for its queries; a window over the query's few finalists picks the result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ship_package, table

#: Rows in a block of candidates and in a block of queries: with 64 components about 4 MB and 1 MB of doubles.
BLOCK, QUERY_BLOCK = 8192, 1024
#: Sums that may pass this are taken in numbers of any length, and count as the ends of a long where they leave it.
LARGEST = float(2**62)
#: Bits that a rotated query's components are rounded to for the packed estimates.
PLANES = 6


def valid_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id`` and ``embedding`` of the rows whose id and components are all there and finite."""
    x = F.col(vector_col)
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    return df.select(F.col(id_col).cast("long").alias("vec_id"), x.cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.coalesce(fine, F.lit(False)))


def matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    return np.concatenate([np.asarray(c.flatten(), dtype=np.float64) for c in column.chunks] or [np.zeros(0)]).reshape(-1, dims)


def best(owner: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of each owner's k highest scores, ties to smaller ids."""
    order = np.lexsort((ids, -scores, owner))
    ranked = owner[order]
    starts = np.r_[0, np.flatnonzero(np.diff(ranked)) + 1] if len(ranked) else np.zeros(0, int)
    place = np.arange(len(ranked)) - np.repeat(starts, np.diff(np.r_[starts, len(ranked)]))
    return order[place < k]


def read_in_bound_order(lower: np.ndarray, upper: np.ndarray, k: int, exact: Callable, at_once: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact scores of all candidates that could be among a query's k best: query, candidate, score.

    Candidates come by falling upper bound, ``at_once`` for each query and round; a query ends when its k-th exact score
    exceeds the next upper bound, so that a tie is still read. Pairs to leave out have an upper bound of minus infinity.
    """
    n, m = upper.shape
    floor = np.partition(lower, m - k, axis=1)[:, m - k] if m > k else np.full(n, -np.inf)
    query, cand = np.nonzero((upper >= floor[:, None]) & (upper > -np.inf))
    order = np.lexsort((-upper[query, cand], query))
    query, cand = query[order], cand[order]
    starts = np.searchsorted(query, np.arange(n))
    place = np.arange(len(query)) - starts[query]
    top = np.full((n, k), -np.inf)
    found = []
    for first in range(0, int(place.max(initial=-1)) + 1, at_once):
        now = np.flatnonzero((place >= first) & (place < first + at_once))
        least = np.nextafter(np.nextafter(top[query[now]].min(axis=1), -np.inf), -np.inf)  # the scores may be long integers
        now = now[upper[query[now], cand[now]] >= least]
        if not len(now):
            break
        scores = exact(query[now], cand[now])
        found.append((query[now], cand[now], scores))
        fresh = np.full((n, at_once), -np.inf)
        fresh[query[now], place[now] - first] = scores
        top = np.sort(np.concatenate([top, fresh], axis=1), axis=1)[:, -k:]
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(part) for part in zip(*found))


def cell_bounds(queries: np.ndarray, points: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of inner products from the points' cells: each component is cut into 2**bits equal cells."""
    low, high = points.min(axis=0), points.max(axis=0)
    width = np.maximum((high - low) / 2**bits, 1e-300)
    code = np.minimum((points - low) // width, 2**bits - 1).astype(np.uint8 if bits <= 8 else np.uint16)
    middle = queries @ (low + (code + 0.5) * width).T
    slack = (np.abs(queries) @ (width / 2))[:, None] * (1 + 1e-9) + 1e-12 * (np.abs(queries) @ np.maximum(np.abs(low), np.abs(high)))[:, None] + 1e-9
    return middle - slack, middle + slack


def whole_products(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact inner products, row by row, of whole numbers held as doubles; at the ends of a long where they leave it."""
    out = np.zeros(len(queries), np.int64)
    safe = (np.abs(queries) * np.abs(points)).sum(axis=1) < LARGEST
    out[safe] = (queries[safe].astype(np.int64) * points[safe].astype(np.int64)).sum(axis=1)
    for i in np.flatnonzero(~safe).tolist():
        total = sum(int(a) * int(b) for a, b in zip(queries[i], points[i]))
        out[i] = min(max(total, -(2**63)), 2**63 - 1)
    return out


def rotation(dims: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def packed_words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words."""
    packed = np.packbits(bits, axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def packed_products(queries: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of each query's components where a code has a one, minus where it has a zero, and the queries' rounding step.

    Components are rounded to ``PLANES`` bits, and each plane of bits meets the packed codes by AND and a count of ones.
    """
    low = queries.min(axis=1)
    step = np.maximum((queries.max(axis=1) - low) / (2**PLANES - 1), 1e-300)
    level = np.rint((queries - low[:, None]) / step[:, None]).astype(np.int64)
    ones = np.zeros((len(queries), len(codes)), np.int32)
    for plane in range(PLANES):
        words = packed_words((level >> plane) & 1 == 1)
        for word in range(words.shape[1]):
            ones += np.bitwise_count(words[:, word, None] & codes[None, :, word]).astype(np.int32) << plane
    set_bits = np.bitwise_count(codes).sum(axis=1)
    inside = low[:, None] * set_bits[None, :] + step[:, None] * ones
    return 2 * inside - (low * queries.shape[1] + step * level.sum(axis=1))[:, None], step


def code_bounds(queries: np.ndarray, points: np.ndarray, seed: int, spread: float) -> tuple[np.ndarray, np.ndarray]:
    """Probable bounds of inner products from one-bit codes.

    A point is its block's centre plus a residual; the code holds the signs of the rotated residual in packed words, and
    the correction scalars are its length and its cosine with the code. The estimate divides by that cosine; its error is
    at most ``spread`` standard deviations with high probability, those of the query's rounding among them.
    """
    dims = points.shape[1]
    turn = rotation(dims, seed)
    centre = points.mean(axis=0)
    turned = (points - centre) @ turn
    length = np.linalg.norm(turned, axis=1)
    cosine = np.abs(turned).sum(axis=1) / np.maximum(length * math.sqrt(dims), 1e-300)
    cosine[length == 0] = 1
    rough, step = packed_products(queries @ turn, packed_words(turned > 0))
    scale = length / cosine
    estimate = (queries @ centre)[:, None] + rough * (scale / math.sqrt(dims))
    error = np.linalg.norm(queries, axis=1)[:, None] * (scale * np.sqrt(np.maximum(1 - cosine**2, 0)) * spread / math.sqrt(max(dims - 1, 1)))
    error += (step * spread / math.sqrt(12))[:, None] * scale + 1e-6
    return estimate - error, estimate + error


def search_blocks(points: DataFrame, queries: DataFrame, pair: Callable, k: int, score_type: str, block: int, query_block: int) -> DataFrame:
    """Run ``pair(query vectors, query ids, points, point ids)`` on every pair of blocks and rank the finalists."""
    ship_package(points.sparkSession)
    n, m = points.count(), queries.count()
    blocks, query_blocks = max(1, math.ceil(n / block)), max(1, math.ceil(m / query_block))
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    hashed = lambda count: F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int")
    left = points.select("vec_id", "embedding", F.size("embedding").alias("dims"), hashed(blocks).alias("block"), each(query_blocks).alias("query_block"))
    right = queries.select("vec_id", "embedding", F.size("embedding").alias("dims"), hashed(query_blocks).alias("query_block"), each(blocks).alias("block"))

    def both(candidates: pa.Table, asked: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64 if score_type == "long" else np.float64)]
        if candidates.num_rows and asked.num_rows:
            dims = candidates["dims"][0].as_py()
            ids, query_ids = candidates["vec_id"].to_numpy(), asked["vec_id"].to_numpy()
            x, every = matrix(candidates["embedding"], dims), matrix(asked["embedding"], dims)
            parts = [pair(every[i : i + 256], query_ids[i : i + 256], x, ids) for i in range(0, len(every), 256)]
            out = [np.concatenate(p) for p in zip(*parts)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), out)))

    keys = ["block", "query_block", "dims"]
    finalists = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(both, f"query_id long, vec_id long, score {score_type}")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return finalists.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact_top_k(points: DataFrame, queries: DataFrame, k: int = 5, bits: int = 6, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """Each query's ``k`` highest integer inner products, exactly, by a vector-approximation file.

    ``points`` and ``queries`` have ``vec_id`` and ``embedding``; components count as floor(256 * x). Of each block the
    quantised cells give bounds, and exact vectors are read by falling upper bound (inner product stands for nearness, so
    this is the order of lower distance bounds) until the k-th score is certain. Returns ``query_id``, ``rank`` from 1,
    ``vec_id``, ``score``; ties go to the smaller vec_id; a query meets only vectors of its own length and never its
    own id. Vectors that are null, empty, or hold a null or non-finite component take no part, nor do rows without an
    id. Scores are exact at any size; one that leaves a long counts as its end. Repeated ids are candidates each; a
    repeated query id's results are ranked together. No queries or no points: no rows. Other columns are ignored.
    """
    scaled = lambda df: valid_vectors(df).withColumn("embedding", F.transform("embedding", lambda e: F.floor(e * 256.0).cast("double")))

    def pair(q, query_ids, x, ids):
        lower, upper = cell_bounds(q, x, bits)
        own = query_ids[:, None] == ids[None, :]
        lower[own] = upper[own] = -np.inf
        query, cand, _ = read_in_bound_order(lower, upper, k, lambda i, j: whole_products(q[i], x[j]), 16)
        score = whole_products(q[query], x[cand])
        keep = best(query, ids[cand], score, k)
        return query_ids[query[keep]], ids[cand[keep]], score[keep]

    return search_blocks(scaled(points), scaled(queries), pair, k, "long", block, query_block)


def nearest_by_codes(points: DataFrame, queries: DataFrame, k: int = 20, spread: float = 1.9, seed: int = 7, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """Each query's ``k`` nearest vectors by largest inner product, found by randomly rotated one-bit codes.

    Every row is coded; the codes' error bounds choose what is reranked by the exact inner product in double precision.
    Returns ``query_id``, ``rank`` from 1, ``vec_id``, ``score`` (exact); ties go to the smaller vec_id; never a query's own
    id; only vectors of one length meet. Vectors that are null, empty, zero, or hold a null or non-finite component
    take no part, nor do rows without an id. No queries or no points: no rows. Other columns are ignored.
    """
    nonzero = lambda df: valid_vectors(df).where(F.exists("embedding", lambda e: e != 0))

    def pair(q, query_ids, x, ids):
        lower, upper = code_bounds(q, x, seed, spread)
        own = query_ids[:, None] == ids[None, :]
        lower[own] = upper[own] = -np.inf
        query, cand, score = read_in_bound_order(lower, upper, k, lambda i, j: np.einsum("ij,ij->i", q[i], x[j]), 64)
        keep = best(query, ids[cand], score, k)
        return query_ids[query[keep]], ids[cand[keep]], score[keep]

    return search_blocks(nonzero(points), nonzero(queries), pair, k, "double", block, query_block)


def every_nth(df: DataFrame, n: int, id_col: str = "vec_id") -> DataFrame:
    """The stated query set: rows whose id is divisible by n."""
    return df.where(F.col(id_col) % n == 0)


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest integer inner products of every query among all other vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    return exact_top_k(vectors, every_nth(vectors, 50), 5)


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest vectors of every query among all other vectors, by one-bit codes and reranking."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_by_codes(vectors, every_nth(vectors, 20), 20)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5
"""
