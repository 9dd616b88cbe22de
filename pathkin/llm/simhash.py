"""SimHash near-duplicates with pigeonring filtering.

Fingerprints: 64 bits, each set if more than half of the shingles' XXH64 hashes (seed 42) have it.

Links (``hamming_links``): the 64 bits form a ring of ``segments`` segments. If two fingerprints differ
in at most t bits, some segment starts a chain in which the first l segments differ in at most
l * t / segments bits together, for every l. With t = 2 and 7 segments the first three segments of such a
chain are equal, the first six differ in one bit at most. So each fingerprint is posted under the 7
runs of three segments; those that meet go through the cumulative budgets, then the full check.
A run that gathers more than ``pairwise`` different fingerprints is not compared pair by pair: two
fingerprints within 2 bits share a word that is within 1 bit of both, so that all members are posted
under themselves and their one-bit neighbours outside the run, where at most 65 can meet, and each is
linked to the smallest there. That finds the same components from a linear number of rows.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, table, tune, words
from .components import components

SEED = 42
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(data: bytes, size: int) -> list[int]:
    """XXH64 of each run of ``size`` words, repeats included; of all words if there are fewer; none without words."""
    w = words(data)
    n = len(w)
    if not n:
        return []
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(w)
    if n <= size:
        return [digest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: n - size + 1].tolist()
    return [digest(joined[s:e], SEED) for s, e in zip(starts, (ends[size - 1 :] - 1).tolist())]


def majority(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The fingerprints of groups of hashes; offsets: where each group starts, and the end. Empty groups get 0.

    Bits are counted eight lanes to a word, in blocks of at most 255 so that no lane runs over.
    """
    sizes = np.diff(offsets)
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    blocks = (sizes[full] + 254) // 255
    first = np.concatenate(([0], np.cumsum(blocks)[:-1]))
    within = np.arange(blocks.sum()) - np.repeat(first, blocks)
    starts = np.repeat(offsets[:-1][full], blocks) + 255 * within
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, starts)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        over = 2 * counts > sizes[full][:, None]
        out[full] |= (over.astype(np.uint64) << (8 * np.arange(8, dtype=np.uint64) + np.uint64(k))).sum(axis=1, dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """(doc_id, fp bigint) for each row of docs (doc_id, text); fp is 0 for null texts and texts without words."""
    import pyarrow as pa

    tune(docs.sparkSession)

    def run(batches):
        for batch in batches:
            parts, sizes = [], []
            for text in batch.column(1).to_pylist():
                got = shingle_hashes((text or "").encode(), shingle_words)
                parts.append(np.array(got, np.uint64))
                sizes.append(len(got))
            fps, low, room = [], 0, 0
            for high in range(1, len(sizes) + 1):  # a few hundred thousand hashes at a time
                room += sizes[high - 1]
                if room >= 200_000 or high == len(sizes):
                    fps.append(majority(np.concatenate(parts[low:high]), np.concatenate(([0], np.cumsum(sizes[low:high])))))
                    low, room = high, 0
            fp = np.concatenate(fps) if fps else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp bigint")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def ring(segments: int) -> list[int]:
    """Masks of the segments of 64 bits, in turn; the first take what is left over."""
    widths = [64 // segments + (k < 64 % segments) for k in range(segments)]
    at, masks = 0, []
    for w in widths:
        masks.append(((1 << w) - 1) << at)
        at += w
    return masks


def hamming_links(fps: DataFrame, distance: int = 2, segments: int = 7, pairwise: int = 64) -> DataFrame:
    """(a, b): links between different fingerprints of fps (fp) that connect all those within ``distance`` bits of each other."""
    masks = ring(segments)
    budget = [(length * distance) // segments for length in range(1, segments + 1)]
    equal = sum(x == 0 for x in budget)
    if not equal or equal == segments or distance > 2:
        raise ValueError("distance must be 1 or 2, and less than the number of segments")

    def chain(start: int, length: int) -> int:
        return sum(masks[(start + k) % segments] for k in range(length))

    def by_start(column: str, values: list) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col(column) + 1)

    runs = fps.select(
        "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(chain(k, equal)))) for k in range(segments)])).alias("start", "run")
    )
    sizes = runs.groupBy("start", "run").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = durable(runs.join(sizes, ["start", "run"]), "simhash-runs")
    few, many = met.filter(F.col("n") <= pairwise).drop("n"), met.filter(F.col("n") > pairwise).drop("n")

    other = few.select(F.col("fp").alias("other"), F.col("start").alias("start2"), F.col("run").alias("run2"))
    differs = F.col("fp").bitwiseXOR(F.col("other"))
    within = (F.col("fp") < F.col("other")) & (F.bit_count(differs) <= distance)
    for length in range(equal + 1, segments):
        if budget[length - 1] < budget[length] or length == segments - 1:  # the longest chain of each budget holds the shorter ones
            within &= F.bit_count(differs.bitwiseAND(by_start("start", [_signed(chain(k, length)) for k in range(segments)]))) <= budget[length - 1]
    same = (F.col("start") == F.col("start2")) & (F.col("run") == F.col("run2"))
    pairs = few.join(other, same & within).select(F.col("fp").alias("a"), F.col("other").alias("b"))

    flips = [[0, *(_signed(1 << bit) for bit in range(64) if not chain(k, equal) >> bit & 1)] for k in range(segments)]
    flip_lists = F.element_at(F.array(*[F.array(*[F.lit(x).cast("bigint") for x in f]) for f in flips]), F.col("start") + 1)
    stars = (
        many.withColumn("flip", F.explode(flip_lists))
        .groupBy("start", "run", F.col("fp").bitwiseXOR(F.col("flip")).alias("middle"))
        .agg(F.collect_list("fp").alias("around"))  # 65 different words at most are within one bit of the middle
        .filter(F.size("around") > 1)
        .select(F.array_min("around").alias("a"), F.explode("around").alias("b"))
        .filter("a != b")
    )
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, shingle_words: int = 3, distance: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id that links of at most ``distance`` bits reach.

    docs needs doc_id and text; other columns are not read. Texts without words (null, empty) have
    fingerprint 0 and link like any other. Equal texts and repeated rows have equal fingerprints.
    A null doc_id never becomes a component_id unless its component has no other. An empty table gives an empty result.
    """
    marked = durable(fingerprints(docs, shingle_words), "simhash-fingerprints")
    lows = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-distinct")
    reached = components(hamming_links(lows.select("fp"), distance), "simhash-links")
    grouped = lows.join(reached.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = grouped.groupBy("component").agg(F.min("low").alias("component_id"))
    named = grouped.join(ids, "component").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
