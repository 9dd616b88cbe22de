"""Approximate nearest neighbours by a permutation index.

Each group of vectors (see blocks) has its own index. Its pivots are a bounded sample of the group (``pivots`` vectors, evenly spread over
the order of vec_id, scaled to length 1). Each vector is represented by its ``prefix`` nearest pivots in order, and posted with its rank in the inverted file
of each of them. A query looks only into the files of its own nearest pivots and ranks vectors by the footrule distance
of the two permutations (pivots past the prefix count as rank ``prefix``). The nearest by that distance, a share ``rerank`` of the
group and ``extra`` for each neighbour asked for, are reranked by their exact inner product. Every vector is indexed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .blocks import grid_search, usable
from .common import table


class PermutationIndex:
    """Inverted files of pivots for a group of vectors (n x d)."""

    def __init__(self, vectors: np.ndarray, pivots: np.ndarray, prefix: int):
        self.vectors, self.pivots, self.prefix = vectors, pivots, min(prefix, len(pivots))
        nearest = self.permutation(vectors)
        n = len(vectors)
        flat = nearest.ravel()
        order = np.argsort(flat, kind="stable")
        self.posts = (order // self.prefix).astype(np.int32)  # the vectors of each pivot's file, file after file
        self.ranks = (order % self.prefix).astype(np.int16)
        self.starts = np.searchsorted(flat[order], np.arange(len(pivots) + 1))
        self.n = n

    def permutation(self, vectors: np.ndarray) -> np.ndarray:
        """The nearest pivots of each vector, nearest first; ties to the smaller pivot."""
        return np.argsort(-(vectors @ self.pivots.T), axis=1, kind="stable")[:, : self.prefix]

    def footrule(self, nearest: np.ndarray) -> np.ndarray:
        """The footrule distance of every vector to a query with these nearest pivots.

        Without a common pivot it is the sum of both sides' distances to the end; a common pivot
        at ranks r and s takes away (prefix - r) + (prefix - s) - |r - s|.
        """
        m = self.prefix
        distance = np.full(self.n, m * (m + 1), np.int32)
        for r, pivot in enumerate(nearest):
            a, b = self.starts[pivot], self.starts[pivot + 1]
            s = self.ranks[a:b].astype(np.int32)
            distance[self.posts[a:b]] -= 2 * (m - np.maximum(r, s))
        return distance

    def search(self, query: np.ndarray, nearest: np.ndarray, k: int, skip: np.ndarray, candidates: int) -> tuple[np.ndarray, np.ndarray]:
        distance = self.footrule(nearest)
        distance[skip] = np.iinfo(np.int32).max
        room = min(candidates, self.n - len(skip))
        if room <= 0:
            return np.zeros(0, np.int64), np.zeros(0)
        near = np.argpartition(distance, room - 1)[:room] if room < self.n else np.arange(self.n)
        near = np.sort(near)
        scores = (self.vectors[near] * query).sum(axis=1)
        top = np.lexsort((near, -scores))[:k]
        return near[top], scores[top]


def nearest_neighbours(vectors: DataFrame, every: int = 20, k: int = 20, pivots: int = 256, prefix: int = 64, rerank: float = 0.15, extra: int = 6, **groups) -> DataFrame:
    """(query_id, rank, vec_id, score): score is the exact inner product in double precision; see grid_search for the queries.

    vectors needs vec_id and embedding; other columns are not read. Vectors that are null, zero, empty or
    hold null or non-finite components take no part. Rows with the query's own vec_id are not
    candidates; other repeated rows count each. Fewer candidates than k: all. No queries: no rows.
    """

    def build(matrix):
        chosen = matrix[np.unique(np.linspace(0, len(matrix) - 1, min(pivots, len(matrix))).astype(np.int64))]
        index = PermutationIndex(matrix, chosen / np.linalg.norm(chosen, axis=1, keepdims=True), prefix)
        candidates = int(np.ceil(rerank * len(matrix))) + extra * k
        return lambda query, skip: index.search(query, index.permutation(query[None, :])[0], k, skip, candidates)

    return grid_search(usable(vectors, nonzero=True), every, k, build, "double", **groups)


def op7_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))
