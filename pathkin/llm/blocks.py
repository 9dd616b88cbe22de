"""Searches of a stated query set against all vectors, in blocks.

Vectors are dealt by hash to groups of bounded size, each of one dimension. Each query travels once to each group of its
dimension. One task sorts a group's vectors before its queries, builds the group's index from the first, and then lets the
queries stream through it in batches: an index is built once, and no task holds more than a group and a batch. Each group returns its best ``k`` of
each query, so that what meets in the final ranking is k rows for a query and group.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, durable, if_small, lean, tune

#: Vectors in a group: 64 dimensions of 8 bytes take 4 MB.
GROUP_ROWS = 8192


def usable(vectors: DataFrame, nonzero: bool = False) -> DataFrame:
    """(vec_id, embedding, dim) of the vectors that take part: none that are null or hold null or non-finite components; with nonzero, none that are all zero or empty."""
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.select("vec_id", "embedding").filter(e.isNotNull() & ~bad)
    if nonzero:
        kept = kept.filter(F.exists(e, lambda x: x != 0))
    return kept.withColumn("dim", F.size("embedding"))


def grid_search(vectors: DataFrame, every: int, k: int, build: Callable, score_type: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the best k of each query, higher scores first, ties to the smaller vec_id.

    vectors: (vec_id, embedding, dim). Queries: rows whose vec_id is divisible by ``every``. A query
    meets the vectors of its own dimension but those of its own vec_id. build(matrix) returns a search:
    a function of (query, places to leave out) that gives places and scores. Vectors of a group come in the order of vec_id, null last.
    """
    tune(vectors.sparkSession)
    vectors = durable(vectors.withColumn("vec_id", F.col("vec_id").cast("bigint")), "search-vectors")
    sizes = durable(vectors.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / F.lit(group_rows)).cast("int").alias("groups")), "search-groups")
    sized = vectors.join(if_small(sizes), "dim")
    own = sized.select("dim", F.pmod(F.xxhash64("vec_id", "embedding"), F.col("groups")).cast("int").alias("g"), F.lit(False).alias("asks"), "vec_id", "embedding")
    asks = sized.filter(F.col("vec_id") % every == 0).select("dim", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"), F.lit(True).alias("asks"), "vec_id", "embedding")
    dealt = own.unionByName(asks).repartition("dim", "g").sortWithinPartitions("dim", "g", "asks", F.col("vec_id").asc_nulls_last())
    kind = pa.float64() if score_type == "double" else pa.int64()

    def matrix(column, dim):
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)

    def run(batches):
        group, ids, parts, find = None, [], [], None
        for batch in batches:
            dims, gs, asking = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero((dims[1:] != dims[:-1]) | (gs[1:] != gs[:-1]) | (asking[1:] != asking[:-1])) + 1).tolist(), len(dims)] if len(dims) else []
            for a, b in zip(edges, edges[1:]):
                if group != (dims[a], gs[a]):
                    group, ids, parts, find = (dims[a], gs[a]), [], [], None
                these, rows = batch.column(3).slice(a, b - a).to_pylist(), matrix(batch.column(4).slice(a, b - a), int(dims[a]))
                if not asking[a]:
                    ids += these
                    parts.append(rows)
                    continue
                if find is None and parts:
                    find, names = build(np.concatenate(parts)), np.array([np.iinfo(np.int64).max if i is None else i for i in ids], np.int64)
                out: tuple[list, list, list] = ([], [], [])
                for query_id, query in zip(these, rows) if parts else ():
                    best, scores = find(query, np.arange(*np.searchsorted(names, [query_id, query_id + 1])))
                    out[0].extend([query_id] * len(best))
                    out[1].extend(ids[p] for p in best.tolist())
                    out[2].extend(scores.tolist())
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], kind)], ["query_id", "vec_id", "score"])

    found = durable(dealt.mapInArrow(lean(run), f"query_id bigint, vec_id bigint, score {score_type}"), "search-found")
    discard(vectors, sizes)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
