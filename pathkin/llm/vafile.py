"""Exact top-k by vector-approximation files.

Each group of vectors keeps an approximation: every component is replaced by the number of its cell,
and each cell knows the smallest and largest value in it. For a query, a table of dimension and cell
gives the most that a component can add to the inner product; summing it over a vector's cells
bounds its score from above. Exact vectors are read in the order of these bounds until the kth best
exact score is above the next bound (equal bounds are still read, for ties).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .blocks import grid_search, usable
from .common import table


def to_integers(matrix: np.ndarray, scale: int = 256) -> np.ndarray:
    """floor(scale * x); refuses numbers that 64 bits cannot hold."""
    whole = np.floor(scale * matrix)
    if whole.size and np.abs(whole).max() >= 2.0**62:
        raise OverflowError("a component times the scale does not fit 64 bits")
    return whole.astype(np.int64)


class VaFile:
    """The approximation of integer vectors (n x d), in at most ``cells`` cells for each dimension."""

    def __init__(self, vectors: np.ndarray, cells: int = 32):
        self.vectors = vectors
        n, d = vectors.shape
        self.widest = float(np.abs(vectors).max()) * d if vectors.size else 0.0
        self.codes = np.empty((d, n), np.uint8)
        self.low, self.high = np.zeros((d, cells), np.int64), np.zeros((d, cells), np.int64)
        for j in range(d):
            x = vectors[:, j]
            edges = np.unique(np.quantile(x, np.linspace(0, 1, cells + 1)[1:-1], method="nearest")) if n else np.zeros(0)
            self.codes[j] = code = np.searchsorted(edges, x, side="right")
            low, high = np.full(cells, np.iinfo(np.int64).max), np.full(cells, np.iinfo(np.int64).min)
            np.minimum.at(low, code, x)
            np.maximum.at(high, code, x)
            used = low <= high
            self.low[j, used], self.high[j, used] = low[used], high[used]

    def bounds(self, query: np.ndarray) -> np.ndarray:
        """What each vector's inner product with the query can be at most."""
        most = np.maximum(self.low * query[:, None], self.high * query[:, None])
        total = np.zeros(self.codes.shape[1], np.int64)
        for row, code in zip(most, self.codes):
            total += row[code]
        return total

    def search(self, query: np.ndarray, k: int, skip: np.ndarray, step: int = 64) -> tuple[np.ndarray, np.ndarray, int]:
        """Positions and scores of the best k (ties to the smaller position) but those in skip; and how many vectors were read."""
        if query.size and self.widest * float(np.abs(query).max()) >= 2.0**62:
            raise OverflowError("an inner product may not fit 64 bits")
        bounds = self.bounds(query)
        bounds[skip] = -np.iinfo(np.int64).max  # can be negated
        order = np.argsort(-bounds, kind="stable")[: len(bounds) - len(skip)]
        best, scores, at = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        while at < len(order) and (len(scores) < k or bounds[order[at]] >= scores[-1]):
            new = order[at : at + step]
            at += len(new)
            best, scores = np.concatenate((best, new)), np.concatenate((scores, self.vectors[new] @ query))
            top = np.lexsort((best, -scores))[:k]
            best, scores = best[top], scores[top]
        return best, scores, at


def exact_top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, **groups) -> DataFrame:
    """(query_id, rank, vec_id, score) for integer inner products of floor(scale * x); see grid_search for the queries.

    vectors needs vec_id and embedding; other columns are not read. Vectors that are null or hold null
    or non-finite components take no part; an empty vector meets only empty ones, with score 0. Rows with the query's own vec_id are not
    candidates; other repeated rows count each. Products that might not fit 64 bits are an error. Fewer candidates than k: all. No queries: no rows.
    """

    def build(matrix):
        file = VaFile(to_integers(matrix, scale))
        return lambda query, skip: file.search(to_integers(query, scale), k, skip)[:2]

    return grid_search(usable(vectors), every, k, build, "bigint", **groups)


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum([q.e[i] * c.e[i] FOR i IN range(1, len(q.e) + 1)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
