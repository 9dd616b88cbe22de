"""Near-duplicates by Jaccard similarity of word shingles: SimHash first, an exact join for what it leaves.

A text is the set of its distinct shingles (``shingle_words`` words, A-Z lowered; all words if there are fewer). Texts with
equal sets are one node. Links come in two rounds, and every one is checked on the whole texts.

1. Pairs that SimHash with pigeonring filtering finds (fingerprints within ``distance`` bits), and each text with one text
   of every list that it is in (see below). Both are linear in the number of texts, however large a group of copies is.
2. Prefix filtering. All sets are put in one order, rare shingles first. Two sets of n and m shingles with similarity s or
   more share ceil(s / (1 + s) * (n + m)) of them, so that they share one of the first n - ceil(s * n) + 1 of each; where their
   first common shingle stands at places i and j, min(n - i, m - j) is at least that overlap. Each text is posted under those first
   shingles; texts that meet in a list, are not linked by the first round, and are near enough the front, are compared.

So neither fingerprints nor a bound on lists decides a link: a pair goes uncompared only if both are already in a component, or if
the bound proves that they are not similar. SimHash alone could not do this: at a similarity of 0.8 fingerprints differ in
about 10 of 64 bits, where no segment has to be equal.

Order of shingles: by how often their hash bucket occurs in all texts, in 2**20 buckets (a few MB, whatever the corpus), then by
hash. Any order finds the same pairs; this one keeps common passages out of the lists.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, durable, if_small, lean, tune
from .components import components
from .simhash import hamming_links, majority

#: log2 of the number of buckets in which shingles are counted, and how many counts travel in a row.
COUNT_BITS, CHUNK = 20, 4096
#: Parts that the texts of a list are dealt to in the second round, and bytes of text that are hashed at once.
SALTS, BLOCK = 8, 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _made(n: int, seed: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


#: What a byte is worth in a word's hash (A-Z as a-z, separators nothing), and the odd base of its powers.
_WORTH = _made(256, 1)
_WORTH[65:91] = _WORTH[97:123]
_WORTH[_SPACE] = 0
_BASE = int(_made(1, 2)[0]) | 1
_POWERS = np.array([pow(_BASE, k, 1 << 64) for k in range(64)], np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    while len(_POWERS) < n:
        _POWERS = np.concatenate((_POWERS, _POWERS * np.uint64(pow(_BASE, len(_POWERS), 1 << 64))))
    return _POWERS


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, one text after another, and where each begins, and the end; null texts are empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (no separator in it, none across texts), and how many words lie before each offset."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    first = ~space
    first[1:] &= space[:-1] | begins[1:-1]
    starts = np.flatnonzero(first)
    hashes = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # blocks of whole words
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + BLOCK)))
        low, high = starts[at], starts[to] if to < len(starts) else len(data)
        own = starts[at:to] - low
        place = np.arange(high - low) - np.repeat(own, np.diff(np.append(own, high - low)))
        place[space[low:high]] = 0
        powers = _powers(int(place.max()) + 1)
        hashes[at:to] = np.add.reduceat(_WORTH[data[low:high]] * powers[place], own)
        at = to
    return mixed(hashes), np.searchsorted(starts, offsets)


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, one text after another; and where each text's begin, and the end."""
    words, at = word_hashes(*text_bytes(texts))
    counts = np.diff(at)
    number = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    ends = np.cumsum(number)
    owner = np.repeat(np.arange(len(counts)), number)
    first = np.repeat(at[:-1] - (ends - number), number) + np.arange(len(owner))  # the word that each shingle begins with
    padded, length = np.concatenate((words, np.zeros(size, np.uint64))), np.minimum(counts, size)[owner]
    hashes = length.astype(np.uint64)
    for k, c in enumerate(_made(size, 3)):
        hashes += np.where(k < length, padded[first + k], np.uint64(0)) * (c | np.uint64(1))
    hashes = mixed(hashes)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.searchsorted(owner[new], np.arange(len(counts) + 1))


def set_keys(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A signed 64-bit name of each set."""
    name = xxhash.xxh64_intdigest
    return np.array([name(hashes[a:b].tobytes()) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())], np.uint64).view(np.int64)


def posted(n: np.ndarray, similarity: float) -> np.ndarray:
    """How many shingles of a set of n a set of at least this similarity must share one of."""
    return np.where(n > 0, n - np.ceil(n * similarity - 1e-9).astype(np.int64) + 1, 0)


def buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def shingle_counts(texts: DataFrame, size: int) -> np.ndarray:
    """How many texts hold a shingle of each bucket."""

    def count(batches):
        total = np.zeros(1 << COUNT_BITS, np.int64)
        for batch in batches:
            total += np.bincount(buckets(shingle_sets(batch.column(0), size)[0]), minlength=1 << COUNT_BITS)
        rows = total.reshape(-1, CHUNK)
        used = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([zstandard.compress(rows[k].tobytes(), 1) for k in used], pa.binary())], ["chunk", "counts"])

    def add(key, rows):
        total = np.zeros(CHUNK, np.int64)
        for value in rows["counts"].to_pylist():
            total += np.frombuffer(zstandard.decompress(value), np.int64)
        return pa.table({"chunk": [key[0].as_py()], "counts": [total.tobytes()]})

    found = texts.mapInArrow(lean(count), "chunk bigint, counts binary").groupBy("chunk").applyInArrow(add, "chunk bigint, counts binary")
    out = np.zeros(((1 << COUNT_BITS) // CHUNK, CHUNK), np.int32)
    for row in found.toLocalIterator():
        out[row["chunk"]] = np.minimum(np.frombuffer(row["counts"], np.int64), 2**31 - 1)
    return out.ravel()


def _jaccard_at_least(one: pa.Array, two: pa.Array, size: int, similarity: float) -> np.ndarray:
    """For each pair of texts whether their whole sets are similar."""
    (a, a_at), (b, b_at) = shingle_sets(one, size), shingle_sets(two, size)
    n, m = np.diff(a_at), np.diff(b_at)
    pair = np.concatenate((np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(m)), m)))
    both = np.concatenate((a, b))
    order = np.lexsort((both, pair))
    both, pair = both[order], pair[order]
    same = np.bincount(pair[1:][(both[1:] == both[:-1]) & (pair[1:] == pair[:-1])], minlength=len(n))
    return same >= similarity * (n + m - same) - 1e-9


class Groups:
    """Rows of docs with a number each (uid) and the key of their set (rows: uid, key, row), and the links between keys (known: node, component)."""

    def __init__(self, docs: DataFrame, shingle_words: int, similarity: float, distance: int):
        spark = tune(docs.sparkSession)
        self.rows = self._describe(docs, shingle_words)
        whole = F.col("row")["text"]
        counts = spark.sparkContext.broadcast(shingle_counts(self.rows.select(whole.alias("text")), shingle_words))
        posts = self._post(self.rows.select("key", whole.alias("text")), shingle_words, similarity, counts)
        sets = durable(self.rows.groupBy("key").agg(F.min("uid").alias("uid"), F.min("fp").alias("fp")), "similar-keys")

        def verified(pairs: DataFrame) -> DataFrame:
            """The similar ones of pairs (a, b: keys; a written table). a should be the one that comes in more pairs."""
            asked = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
            asked = durable(asked.join(sets.select("key", "uid"), "key"), "similar-asked")
            texts = durable(self.rows.select("uid", whole.alias("text")).join(if_small(asked), "uid").select("key", "text"), "similar-texts")
            text = lambda c: texts.select(F.col("key").alias(c), F.col("text").alias(f"text_{c}"))

            def compare(batches):
                for batch in batches:
                    keep = pa.array(_jaccard_at_least(batch.column(2), batch.column(3), shingle_words, similarity), pa.bool_())
                    yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

            links = durable(pairs.join(text("a"), "a").join(text("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(lean(compare), "a bigint, b bigint"), "similar-links")
            discard(asked, texts)
            return links

        # round 1: by SimHash, and each text with the head of every list that it is in
        firsts = sets.groupBy("fp").agg(F.min("key").alias("key"), F.max("key").alias("last"))
        prints = durable(firsts, "similar-prints")
        near = hamming_links(prints.select("fp"), distance)
        named = lambda c: prints.select(F.col("fp").alias(c), F.col("key").alias(f"key_{c}"))
        near = near.join(named("a"), "a").join(named("b"), "b").select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))
        equal = sets.join(prints.filter("key != last").select("fp", F.col("key").alias("a")), "fp").filter("a != key").select("a", F.col("key").alias("b"))
        shared = self._lists(posts)
        heads = shared.filter(near_front() == F.col("first")).select("h", *[F.col(c).alias(f"o_{c}") for c in ("key", "n", "i")])
        stars = shared.join(heads, "h").filter((F.col("key") != F.col("o_key")) & enough(similarity)).select(F.col("o_key").alias("a"), F.col("key").alias("b"))
        pairs = durable(near.unionByName(equal).unionByName(stars).distinct(), "similar-first")
        links = verified(pairs)
        known = components(links, "similar-linked")

        # round 2: all that still meet in different components
        linked = known.select(F.col("node").alias("key"), F.col("component").alias("in_"))
        inside = durable(shared.select("h", "key", "n", "i").join(linked, "key", "left").withColumn("in_", F.coalesce("in_", "key")), "similar-inside")
        split = inside.groupBy("h", "in_").agg(F.count(F.lit(1)).alias("size"))
        split = split.groupBy("h").agg(F.max_by("in_", F.struct("size", "in_")).alias("main"), F.count(F.lit(1)).alias("parts")).filter("parts > 1").select("h", "main")
        rest = durable(inside.join(split, "h").withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")), "similar-rest")
        outside = rest.filter("in_ != main").select("h", *[F.col(c).alias(f"o_{c}") for c in ("key", "n", "i", "in_")], F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        once = (F.col("in_") == F.col("main")) | (F.col("key") < F.col("o_key"))  # two that are both outside meet twice
        cross = rest.join(outside, ["h", "salt"]).filter((F.col("in_") != F.col("o_in_")) & once & enough(similarity))
        late = durable(cross.select(F.col("key").alias("a"), F.col("o_key").alias("b")).distinct(), "similar-late")
        if not late.isEmpty():
            more = verified(late)
            known = components(links.unionByName(more), "similar-all")
        self.known = known
        self.used = [sets, prints, shared, pairs, links, inside, rest, late]

    @staticmethod
    def _describe(docs: DataFrame, size: int) -> DataFrame:
        row = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
        place = docs.columns.index("text")

        def run(batches):
            part, number = TaskContext.get().partitionId(), 0
            for batch in batches:
                rows = batch.column(0)
                hashes, starts = shingle_sets(rows.field(place), size)
                uid = (np.int64(part) << 36) + np.arange(number, number + len(rows))
                number += len(rows)
                yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(set_keys(hashes, starts)), pa.array(majority(hashes, starts).view(np.int64)), rows], ["uid", "key", "fp", "row"])

        schema = row.select(F.lit(0).cast("bigint").alias("uid"), F.lit(0).cast("bigint").alias("key"), F.lit(0).cast("bigint").alias("fp"), "row").schema
        return durable(row.mapInArrow(lean(run), schema), "similar-rows")

    @staticmethod
    def _post(texts: DataFrame, size: int, similarity: float, counts) -> DataFrame:
        """(h, key, n, i): each set, once for a partition, under its first shingles; i is the shingle's place."""

        def run(batches):
            seen: set[int] = set()
            for batch in batches:
                fresh = np.array([not (k in seen or seen.add(k)) for k in batch.column(0).to_pylist()], bool)
                hashes, starts = shingle_sets(batch.column(1).filter(pa.array(fresh)), size)
                keys, n = batch.column(0).to_numpy()[fresh], np.diff(starts)
                owner = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((hashes, counts.value[buckets(hashes)], owner))
                i = np.arange(len(hashes)) - starts[owner]
                front = i < posted(n, similarity)[owner]
                h, owner, i = hashes[order][front], owner[front], i[front]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(keys[owner]), pa.array(n[owner].astype(np.int32)), pa.array(i.astype(np.int32))], ["h", "key", "n", "i"])

        return durable(texts.mapInArrow(lean(run), "h bigint, key bigint, n int, i int"), "similar-posts")

    @staticmethod
    def _lists(posts: DataFrame) -> DataFrame:
        """The posts of lists with different sets, each once, with ``first``: the place of the one that has the list's shingle nearest to its front.

        Most shingles are one text's alone: their posts go before keys and places are gathered. posts is deleted.
        """
        held = posts.groupBy("h").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("h")
        met = durable(posts.join(held.hint("shuffle_hash"), "h", "left_semi"), "similar-met")
        once = durable(met.dropDuplicates(["h", "key"]), "similar-once")
        found = once.groupBy("h").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.min(near_front()).alias("first"))
        shared = durable(once.join(found.filter("low != high").select("h", "first"), "h"), "similar-shared")
        discard(posts, met, once)
        return shared


def near_front() -> Column:
    """Orders the sets of a list by how near to their front its shingle is."""
    return F.expr("shiftleft(i * 65536L div n, 44) | shiftrightunsigned(xxhash64(key), 20)")


def enough(similarity: float) -> Column:
    """Whether two sets whose first common shingle stands at these places can still be similar."""
    share = similarity / (1 + similarity)
    return F.least(F.col("n") - F.col("i"), F.col("o_n") - F.col("o_i")) >= F.lit(share) * (F.col("n") + F.col("o_n")) - F.lit(1e-9)


def similar_groups(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8, distance: int = 2) -> DataFrame:
    """(doc_id, component_id) for each row of docs: component_id is the smallest doc_id that links reach (null only if there is no other).

    docs needs doc_id (of any type) and text; other columns are not read. Equal texts and repeated rows are linked; so are all texts without
    words (null, empty, blank). Rows that share a doc_id are linked by their texts only. An empty table gives an empty result.
    """
    found = Groups(docs.select("doc_id", "text"), shingle_words, similarity, distance)
    grouped = found.rows.select(F.col("row")["doc_id"].alias("doc_id"), "key").join(found.known, F.col("key") == F.col("node"), "left")
    grouped = grouped.select("doc_id", F.coalesce("component", "key").alias("component"))
    ids = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return grouped.join(ids, "component").select("doc_id", "component_id")


def without_near_duplicates(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8, distance: int = 2) -> DataFrame:
    """One row of each group of similar texts, with all columns of docs.

    The row with the smallest doc_id stays (of several with that id any one; a null id only if the group has no other). So one of
    several equal rows stays, with null ids too, and of all texts without words one. Rows that share a doc_id go or stay by their own texts.
    """
    found = Groups(docs, shingle_words, similarity, distance)
    rows = found.rows.select("uid", "key", F.col("row")["doc_id"].alias("doc_id")).join(found.known, F.col("key") == F.col("node"), "left")
    rows = rows.select("uid", "doc_id", F.coalesce("component", "key").alias("component"))
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "uid")
    kept = rows.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min(first)["uid"].alias("kept")).filter("n > 1")
    gone = durable(rows.join(if_small(durable(kept.select("component", "kept"), "similar-kept")), "component").filter("uid != kept").select("uid"), "similar-gone")
    discard(*found.used, found.known)
    return found.rows.join(if_small(gone), "uid", "left_anti").select("row.*")
