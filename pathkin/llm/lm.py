"""LM scoring with an Elias-Fano n-gram trie of order 3.

Model: interpolated Witten-Bell smoothing. With c() the counts in training texts and T(h) the number of different successors of h,

    P(w | h) = c(h, w) / (c(h) + T(h)) + T(h) / (c(h) + T(h)) * P(w | h without its first word)

for h = (u, v) and h = (v); P(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1)). A text starts after a start mark (its first word has no context of two) and ends
with an end token. Contexts that training texts lack leave all to the shorter one.

How it runs. The corpus is read once and written as batches of about ``batch_tokens`` tokens: word
hashes of the batch, and each text as numbers into them. Every batch sends each shard one message with its
distinct words, their distinct successors, the distinct successors of those, and all counts in training texts. A shard adds up what
all batches sent, builds its part of the trie, looks up all the n-grams it was asked for, and
answers each batch with one message. Batches then score their texts. N-grams meet in a shard once for each
batch, however often they occur. Contexts (words, or pairs) that make up more than about 1/1024 of all tokens (at most 1024 of each) are
spread over all shards by successor, so that no shard gathers a common one; their weights are summed up over all shards and applied when texts are scored.
A batch writes to the shards that it has words or pairs for, so that there are no more
messages than distinct words and pairs. All sizes grow in proportion to the corpus, and no task holds more than a batch or a shard.

A shard's trie: contexts as an Elias-Fano sequence; Elias-Fano pointers to where each context's successors
start; successors as one Elias-Fano sequence of numbers relative to their context, made monotone by the number of the context; the same again for
successors of pairs, under the pairs; and one byte for each successor with the logarithm of its smoothed probability's own part, c(h, w) / (c(h) + T(h)), and for each pair
with that of the weight it leaves to the shorter context. High parts are read through a directory of one number a byte of unary code, and never unpacked.
"""

from __future__ import annotations

import mmap

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, id_bucket, lean, table, trim, tune, words

#: No word holds a line feed.
END, START = (np.uint64(xxhash.xxh64_intdigest(x)) for x in (b"\nend", b"\nstart"))
U64 = np.dtype("<u8")
#: Bits that tell the successors of a word, and those of a pair, apart.
KEY2, KEY3 = 32, 24
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def lowest_of(tokens: int) -> float:
    """The logarithm that code 1 stands for: no probability of a corpus with so many tokens is smaller. Code 255 stands for 0, code 0 for no entry."""
    return -float(np.log10(2.0 * max(tokens, 5 * 10**7)))


def quantise(probability: np.ndarray, lowest: float) -> np.ndarray:
    return np.clip(np.rint((np.log10(probability) - lowest) / -lowest * 254), 0, 254).astype(np.uint8) + np.uint8(1)


def restore(codes: np.ndarray, lowest: float) -> np.ndarray:
    values = np.append(0.0, 10.0 ** (lowest - lowest * np.arange(255) / 254))
    return values[codes]


def _select_table(bit: int) -> np.ndarray:
    """Where the k-th such bit of each byte is."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little") == bit
    return np.argsort(~bits, axis=1, kind="stable").astype(np.uint8)


_ONE, _ZERO = _select_table(1), _select_table(0)


class EliasFano:
    """A non-decreasing sequence of 64-bit numbers below ``universe``: packed low bits, and high parts in unary with how many ones and zeros are before each byte."""

    def __init__(self, values: np.ndarray, universe: int, keep=lambda a: a):
        self.n = n = len(values)
        self.low_bits = min(56, max(0, (universe // max(1, n)).bit_length() - 1))
        low = values & np.uint64((1 << self.low_bits) - 1)
        bits = [np.packbits(np.zeros(0, np.uint8))]
        step = 1 << 17  # a multiple of 8, so that chunks end on bytes
        shifts = np.arange(self.low_bits, dtype=np.uint64)
        for at in range(0, n if self.low_bits else 0, step):
            bits.append(np.packbits(((low[at : at + step, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little"))
        self.low = keep(np.concatenate([*bits, np.zeros(8, np.uint8)]))
        high = (values >> np.uint64(self.low_bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(high[-1]) + 2 if n else 1, np.uint8)  # a zero behind the last one
        unary[high] = 1
        packed = np.packbits(unary, bitorder="little")
        before = np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]))
        self.high, self.ones = keep(packed), keep(before.astype(np.uint32))
        self.zeros = keep((8 * np.arange(len(packed)) - before).astype(np.uint32))
        self.buckets = len(unary) - n

    def _find(self, directory: np.ndarray, table: np.ndarray, at: np.ndarray) -> np.ndarray:
        byte = np.searchsorted(directory, at.astype(np.uint32), "right") - 1
        return 8 * byte + table[self.high[byte], at - directory[byte].astype(np.int64)]

    def starts(self, high: np.ndarray) -> np.ndarray:
        """How many numbers have a smaller high part."""
        inside = (high > 0) & (high <= self.buckets)
        out = np.where(high <= 0, 0, self.n)
        k = high[inside] - 1
        out[inside] = self._find(self.zeros, _ZERO, k) - k
        return out

    def lows(self, at: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(at), U64)
        bit = at.astype(np.int64) * self.low_bits
        first, out = bit >> 3, np.zeros(len(at), U64)
        for k in range((self.low_bits + 14) // 8):
            out |= self.low[first + k].astype(U64) << np.uint64(8 * k)
        return (out >> (bit & 7).astype(U64)) & np.uint64((1 << self.low_bits) - 1)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        if not len(at):
            return np.zeros(0, U64)
        return ((self._find(self.ones, _ONE, at) - at).astype(U64) << np.uint64(self.low_bits)) | self.lows(at)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Positions of the values, -1 where there is none: the bucket of the high part, then binary search of low parts."""
        wanted = np.minimum(values >> np.uint64(self.low_bits), np.uint64(1 << 62)).astype(np.int64)
        low = values & np.uint64((1 << self.low_bits) - 1)
        a, end = self.starts(wanted), self.starts(wanted + 1)
        b = end.copy()
        open_ = np.flatnonzero(a < b)
        while len(open_):
            mid = (a[open_] + b[open_]) // 2
            less = self.lows(mid) < low[open_]
            a[open_[less]], b[open_[~less]] = mid[less] + 1, mid[~less]
            open_ = open_[a[open_] < b[open_]]
        hit = a < end
        hit[hit] = self.lows(a[hit]) == low[hit]
        return np.where(hit, a, -1)


class Trie:
    """The successors of a shard's contexts, and the successors of these pairs, each sorted under what they follow; levels are memory-mapped."""

    def __init__(self, contexts: np.ndarray, starts: np.ndarray, successors: np.ndarray, codes: np.ndarray, starts3: np.ndarray, successors3: np.ndarray, codes3: np.ndarray, weights: np.ndarray):
        relative = lambda starts, keys, bits: (np.repeat(np.arange(len(starts) - 1, dtype=U64), np.diff(starts)) << np.uint64(bits)) | keys
        self.contexts = EliasFano(contexts, 1 << 64, self._map)
        self.pointers = EliasFano(starts.astype(U64), len(successors) + 1, self._map)
        self.successors = EliasFano(relative(starts, successors, KEY2), max(1, len(contexts)) << KEY2, self._map)
        self.pointers3 = EliasFano(starts3.astype(U64), len(successors3) + 1, self._map)
        self.successors3 = EliasFano(relative(starts3, successors3, KEY3), max(1, len(successors)) << KEY3, self._map)
        self.codes, self.codes3, self.weights = self._map(codes), self._map(codes3), self._map(weights)

    @staticmethod
    def _map(level: np.ndarray) -> np.ndarray:
        if not level.nbytes:
            return level
        held = mmap.mmap(-1, level.nbytes)
        held.write(np.ascontiguousarray(level).tobytes())
        return np.frombuffer(held, level.dtype)

    @staticmethod
    def _below(parents: np.ndarray, pointers: EliasFano, level: EliasFano, keys: np.ndarray, bits: int) -> np.ndarray:
        """Places of keys in the stretches of their parents, -1 where there is none."""
        out = np.full(len(parents), -1, np.int64)
        known = np.flatnonzero(parents >= 0)
        at = level.find((parents[known].astype(U64) << np.uint64(bits)) | keys[known])
        hit = at >= 0
        p = parents[known][hit]
        assert ((at[hit] >= pointers[p].astype(np.int64)) & (at[hit] < pointers[p + 1].astype(np.int64))).all()
        out[known] = at
        return out

    def pairs(self, contexts: np.ndarray, successors: np.ndarray) -> np.ndarray:
        """The nodes of pairs: the context's number, then the successor within the context's own stretch."""
        return self._below(self.contexts.find(contexts), self.pointers, self.successors, successors, KEY2)

    def triples(self, nodes: np.ndarray, successors: np.ndarray) -> np.ndarray:
        return self._below(nodes, self.pointers3, self.successors3, successors, KEY3)


def coded(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """codes at the places, 0 for -1."""
    out = np.zeros(len(at), np.uint8)
    out[at >= 0] = codes[at[at >= 0]]
    return out


def pack(*arrays: np.ndarray) -> bytes:
    sizes = np.array([len(arrays), *(a.nbytes for a in arrays)], "<i8").tobytes()
    return zstandard.compress(sizes + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), 1)


def unpack(data: bytes, *dtypes) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    count = int(np.frombuffer(raw, "<i8", 1)[0])
    sizes, at, out = np.frombuffer(raw, "<i8", count, 8), 8 * (count + 1), []
    for size, dtype in zip(sizes.tolist(), dtypes):
        out.append(np.frombuffer(raw, dtype, size // np.dtype(dtype).itemsize, at))
        at += size
    return out


def pack_batch(texts: list[str | None], train: np.ndarray) -> bytes:
    """Sizes of the texts (in words), whether each is for training, hashes of the distinct words, and the words as numbers into these."""
    number: dict[bytes, int] = {}

    class Next(dict):
        def __missing__(self, w):
            self[w] = k = len(self)
            return k

    number = Next()
    get, flat, sizes = number.__getitem__, [], []
    for text in texts:
        got = words((text or "").encode())
        flat.append(np.fromiter(map(get, got), np.uint32, len(got)))
        sizes.append(len(got))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, number), U64, len(number))
    ids = np.concatenate(flat) if flat else np.zeros(0, np.uint32)
    # numbers in the order of first use are small for common words; their bytes are kept apart, which packs well
    return pack(np.array(sizes, "<i8"), train.astype(np.uint8), hashes, *((ids >> np.uint32(8 * k)).astype(np.uint8) for k in range(4)))


def pair_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes that stand for pairs of words where a pair is a context of its own."""
    x = a * np.uint64(0xD6E8FEB86659FD93) + b * _GOLDEN
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where equal neighbours begin, and how many they are."""
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(values)))


class Batch:
    """A batch's tokens as numbers into ``hashes`` (sorted; with the end token and the start mark), its distinct pairs, and their distinct successors."""

    def __init__(self, data: bytes):
        sizes, train, vocabulary, *planes = unpack(data, "<i8", np.uint8, U64, *[np.uint8] * 4)
        ids = sum(p.astype(np.int64) << (8 * k) for k, p in enumerate(planes))
        self.sizes, self.train = sizes, train.astype(bool)
        self.hashes = np.union1d(vocabulary, np.array([END, START], U64))
        ids = np.searchsorted(self.hashes, vocabulary)[ids]
        self.end, self.start = (int(np.searchsorted(self.hashes, x)) for x in (END, START))
        ends = np.cumsum(sizes + 1) - 1  # where each text's end token stands
        self.firsts = ends - sizes
        self.tokens = np.full(int(sizes.sum()) + len(sizes), self.end, np.int64)
        inner = np.ones(len(self.tokens), bool)
        inner[ends] = False
        self.tokens[inner] = ids
        self.training = np.repeat(self.train, sizes + 1)
        before = np.roll(self.tokens, 1)
        before[self.firsts] = self.start
        width = len(self.hashes)
        pairs, self.pair_of = np.unique(before * width + self.tokens, return_inverse=True)
        self.before, self.after = np.divmod(pairs, width)
        self.later = np.ones(len(self.tokens), bool)  # tokens with a context of two words
        self.later[self.firsts] = False
        at = np.flatnonzero(self.later)
        triples, self.triple_of = np.unique(self.pair_of[at - 1] * width + self.tokens[at], return_inverse=True)
        self.pair, self.last = np.divmod(triples, width)
        self.counts = np.bincount(self.tokens[self.training], minlength=width)
        self.pair_counts = np.bincount(self.pair_of[self.training], minlength=len(pairs))
        self.triple_counts = np.bincount(self.triple_of[self.training[at]], minlength=len(triples))

    def pair_names(self) -> np.ndarray:
        return pair_hashes(self.hashes[self.before], self.hashes[self.after])

    def common(self) -> tuple[np.ndarray, np.ndarray]:
        """Words and pairs that may be common contexts, and their counts."""
        w, p = (np.flatnonzero(c * 2048 >= len(self.tokens)) for c in (self.counts, self.pair_counts))
        return np.concatenate((self.hashes[w], self.pair_names()[p])), np.concatenate((self.counts[w], self.pair_counts[p]))

    def count_of(self, contexts: np.ndarray) -> np.ndarray:
        """How often each of the contexts (sorted words and pairs, by hash) occurs in training texts."""
        total = np.zeros(len(contexts), np.int64)
        for names, counts in ((self.hashes, self.counts), (self.pair_names(), self.pair_counts)):
            at = np.searchsorted(contexts, names)
            at[at == len(contexts)] = 0
            same = contexts[at] == names
            np.add.at(total, at[same], counts[same])
        return total

    def deal(self, shards: int, hot: np.ndarray) -> None:
        """Gives each word, pair and triple its shard. Words of a shard are a range of hashes; pairs go with their context, and triples with their pair; those of hot contexts go by hash.

        Triples of hot pairs travel as pairs whose context is the hot pair's hash.
        """
        names = self.pair_names()
        self.word_shard = shard_of(self.hashes, shards)
        self.hot_word, hot_pair = np.isin(self.hashes, hot), np.isin(names, hot)
        to = self.word_shard[self.before]
        spread = self.hot_word[self.before]
        to[spread] = shard_of((self.hashes[self.before[spread]] ^ self.hashes[self.after[spread]]) * _GOLDEN, shards)
        self.hot_triple = hot_pair[self.pair]
        some = np.flatnonzero(self.hot_triple)
        context, follows = names[self.pair[some]], self.hashes[self.last[some]]
        self.context = np.concatenate((self.hashes[self.before], context))
        self.follows = np.concatenate((self.hashes[self.after], follows))
        self.times = np.concatenate((self.pair_counts, self.triple_counts[some]))
        to = np.concatenate((to, shard_of((context ^ follows) * _GOLDEN, shards)))
        self.order = np.argsort(to, kind="stable")
        self.pair_shard = to[self.order]
        self.below = np.flatnonzero(~self.hot_triple)  # by pair
        under = to[self.pair[self.below]]
        order = np.argsort(under, kind="stable")
        self.below, self.below_shard = self.below[order], under[order]
        self.children = np.zeros(len(to), np.int64)
        self.children[: len(self.before)] = np.bincount(self.pair[self.below], minlength=len(self.before))

    def present(self) -> list[int]:
        """The shards that hold any of the batch's words or pairs."""
        return np.union1d(self.word_shard, self.pair_shard).tolist()

    def words_of(self, shard: int) -> slice:
        return slice(*np.searchsorted(self.word_shard, (shard, shard + 1)))

    def pairs_of(self, shard: int) -> np.ndarray:
        return self.order[slice(*np.searchsorted(self.pair_shard, (shard, shard + 1)))]

    def triples_of(self, shard: int) -> np.ndarray:
        return self.below[slice(*np.searchsorted(self.below_shard, (shard, shard + 1)))]

    def message(self, shard: int) -> bytes:
        """What the batch tells a shard: words and counts; contexts, and their successors with counts; the successors of each such pair, with counts."""
        own, pairs, below = self.words_of(shard), self.pairs_of(shard), self.triples_of(shard)
        first, sizes = runs(self.context[pairs])
        key3 = self.hashes[self.last[below]] >> np.uint64(64 - KEY3)
        contexts = self.context[pairs][first]
        at = np.searchsorted(self.hashes[own], contexts)  # most are among the message's words: steps between their places
        here = known_at(self.hashes[own], np.ones(own.stop - own.start, np.int64), contexts) > 0
        return pack(
            np.diff(self.hashes[own], prepend=U64.type(0)), self.counts[own].astype("<u4"), here.astype(np.uint8), np.diff(at[here], prepend=0).astype("<i4"), contexts[~here], sizes.astype("<u4"), (self.follows[pairs] >> np.uint64(64 - KEY2)).astype("<u4"), self.times[pairs].astype("<u4"),
            self.children[pairs].astype("<u4"), (key3 >> np.uint64(8)).astype("<u2"), (key3 & np.uint64(255)).astype(np.uint8), self.triple_counts[below].astype("<u4"),
        )


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def known_at(names: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """values by sorted names, 0 for names that there are not."""
    if not len(names):
        return np.zeros(len(wanted), np.int64)
    at = np.searchsorted(names, wanted)
    at[at == len(names)] = 0
    return np.where(names[at] == wanted, values[at], 0)


def opened(message: bytes) -> list[np.ndarray]:
    """words, counts; contexts, their sizes; successors, counts, numbers of children; the children's high and low bits, counts."""
    own, counts, here, steps, other, *rest = unpack(message, U64, "<u4", np.uint8, "<i4", U64, "<u4", "<u4", "<u4", "<u4", "<u2", np.uint8, "<u4")
    own = np.cumsum(own, dtype=U64)
    contexts = np.empty(len(here), U64)
    contexts[here == 1], contexts[here == 0] = own[np.cumsum(steps)], other
    return [own, counts, contexts, *rest]


def answer(messages: list[bytes], hot: np.ndarray, hot_counts: np.ndarray, lowest: float) -> tuple[list[bytes], int, np.ndarray]:
    """A shard's answers to its messages, how many words with training counts it has, and how many successors of each hot context."""
    parts = [opened(m) for m in messages]
    joined = lambda k, kind: np.concatenate([p[k] for p in parts]).astype(kind)
    vocabulary, word_at = np.unique(joined(0, U64), return_inverse=True)
    counts = np.bincount(word_at, weights=joined(1, np.float64), minlength=len(vocabulary)).astype(np.int64)
    contexts, of = np.unique(np.repeat(joined(2, U64), joined(3, np.int64)), return_inverse=True)

    # distinct pairs, and distinct successors of each
    pairs, pair_at = np.unique((of.astype(U64) << np.uint64(KEY2)) | joined(4, U64), return_inverse=True)
    times = np.bincount(pair_at, weights=joined(5, np.float64), minlength=len(pairs)).astype(np.int64)
    key3 = (joined(7, U64) << np.uint64(8)) | joined(8, U64)
    triples, triple_at = np.unique((np.repeat(pair_at, joined(6, np.int64)).astype(U64) << np.uint64(KEY3)) | key3, return_inverse=True)
    times3 = np.bincount(triple_at, weights=joined(9, np.float64), minlength=len(triples)).astype(np.int64)

    # what training texts hold becomes the trie
    seen, seen3 = np.flatnonzero(times), np.flatnonzero(times3)
    owner = (pairs[seen] >> np.uint64(KEY2)).astype(np.int64)
    used, begin = np.unique(owner, return_index=True)
    fanout = np.bincount(owner, minlength=len(contexts))
    is_hot = np.isin(contexts, hot)
    # a context's count is that of its word, of which all pairs are here; hot ones are told, and their types known only when all shards have answered
    total = np.where(is_hot, known_at(hot, hot_counts, contexts), np.bincount(owner, weights=times[seen], minlength=len(contexts)).astype(np.int64) + fanout)
    parent = np.searchsorted(seen, (triples[seen3] >> np.uint64(KEY3)).astype(np.int64))
    fanout3, total3 = np.bincount(parent, minlength=len(seen)), np.bincount(parent, weights=times3[seen3], minlength=len(seen))
    starts3 = np.concatenate(([0], np.cumsum(fanout3)))
    whole3 = np.maximum(1, total3 + fanout3)
    trie = Trie(
        contexts[used], np.append(begin, len(seen)), pairs[seen] & np.uint64((1 << KEY2) - 1), quantise(times[seen] / total[owner], lowest),
        starts3, triples[seen3] & np.uint64((1 << KEY3) - 1), quantise(times3[seen3] / whole3[parent], lowest), np.where(fanout3 > 0, quantise(np.maximum(fanout3, 1) / whole3, lowest), 0).astype(np.uint8),
    )

    nodes = trie.pairs(contexts[(pairs >> np.uint64(KEY2)).astype(np.int64)], pairs & np.uint64((1 << KEY2) - 1))
    codes, weights = coded(trie.codes, nodes)[pair_at], coded(trie.weights, nodes)[pair_at]
    codes3 = coded(trie.codes3, trie.triples(nodes[(triples >> np.uint64(KEY3)).astype(np.int64)], triples & np.uint64((1 << KEY3) - 1)))[triple_at]
    types = known_at(contexts, fanout, vocabulary)[word_at].astype("<u4")
    counts = counts[word_at].astype("<u8")
    out, word, pair, triple = [], 0, 0, 0
    for p in parts:
        w, e, t = word + len(p[0]), pair + len(p[4]), triple + len(p[7])
        out.append(pack(counts[word:w], types[word:w], codes[pair:e], weights[pair:e], codes3[triple:t]))
        word, pair, triple = w, e, t
    return out, int((np.bincount(word_at, weights=counts > 0) > 0).sum()), known_at(contexts, fanout, hot)


def lm_scores(docs: DataFrame, holdout=(5, 1), batch_tokens: int = 700_000) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs (doc_id, text).

    Texts are learnt from unless crc32 of the id as text modulo holdout[0] is holdout[1]. Null and
    empty texts are one end token. Repeated rows count and score each. An empty table gives an empty
    result; without training texts every token has probability 1 / (0.5 * (0 + 1)) * 0.5 = 1.
    Successors of a word are told apart by 32 bits of their hashes, those of a pair by 24.
    """
    spark = tune(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = id_bucket("doc_id", holdout[0]) == holdout[1]

    def encode(batches):
        part, number = TaskContext.get().partitionId(), 0
        ids, texts, train, size = [], [], [], 0

        def row():
            data = pack_batch(texts, np.array(train, bool))
            b = Batch(data)
            common, times = b.common()
            names = ["batch", "doc_ids", "data", "tokens", "texts", "common", "common_counts"]
            values = [
                pa.array([part << 32 | number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, sum(map(len, ids))], pa.int32()), pa.concat_arrays(ids)), pa.array([data], pa.binary()),
                pa.array([int(b.training.sum())], pa.int64()), pa.array([int(b.train.sum())], pa.int64()),
                pa.array([common.view(np.int64).tolist()], pa.list_(pa.int64())), pa.array([times.tolist()], pa.list_(pa.int64())),
            ]
            return pa.RecordBatch.from_arrays(values, names)

        for batch in batches:
            column, flags = batch.column(2).to_pylist(), batch.column(1).to_pylist()
            low = 0
            for k, text in enumerate(column):
                texts.append(text)
                train.append(not flags[k])
                size += len(text or "") // 6 + 1
                if size >= batch_tokens or k == len(column) - 1:
                    ids.append(batch.column(0).slice(low, k + 1 - low))
                    low = k + 1
                if size >= batch_tokens:
                    yield row()
                    ids, texts, train, size, number = [], [], [], 0, number + 1
        if texts:
            yield row()

    fields = f"batch bigint, doc_ids array<{kind}>, data binary, tokens bigint, texts bigint, common array<bigint>, common_counts array<bigint>"
    batches = durable(docs.select("doc_id", held.alias("held"), "text").mapInArrow(lean(encode), fields), "lm-batches")
    facts = batches.agg(F.sum("tokens").alias("tokens"), F.sum("texts").alias("texts"), F.count(F.lit(1)).alias("n")).first()
    train_tokens, train_texts = int(facts["tokens"] or 0), int(facts["texts"] or 0)
    shards, lowest = max(1, int(facts["n"] or 0)), lowest_of(train_tokens)

    # contexts to spread: at most 1024 words, and as many pairs, can make up 1/1024 of the training tokens each
    spread = (
        batches.select(F.explode(F.arrays_zip("common", "common_counts")).alias("c"))
        .groupBy(F.col("c.common").alias("word"))
        .agg(F.sum("c.common_counts").alias("n"))
        .filter(F.col("n") * 1024 >= train_tokens)
        .select("word")
    )
    hot = np.array([r["word"] for r in spread.collect()], np.int64).view(U64)
    hot = np.union1d(hot, np.array([START], U64))  # every text begins with the start mark

    def hot_contexts(rows):
        total = np.zeros(len(hot), np.int64)
        for batch in rows:
            for data in batch.column(0).to_pylist():
                total += Batch(data).count_of(hot)
        yield pa.RecordBatch.from_arrays([pa.array(hot.view(np.int64)), pa.array(total)], ["word", "n"])

    def send(rows):
        for batch in rows:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                b = Batch(data)
                b.deal(shards, hot)
                to = b.present()
                for some in (to[k : k + 64] for k in range(0, len(to), 64)):
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([number] * len(some), pa.int64()), pa.array([b.message(s) for s in some], pa.binary())], ["shard", "batch", "data"])

    counts = {r["word"]: r["n"] for r in batches.select("data").mapInArrow(lean(hot_contexts), "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    hot_counts = np.array([counts.get(w, 0) for w in hot.view(np.int64).tolist()], np.int64)
    hot_counts[np.searchsorted(hot, START)] = train_texts

    def reply(key, shard):
        answers, types, hot_types = answer(shard["data"].to_pylist(), hot, hot_counts, lowest)
        trim()
        once = pa.array([hot_types.tolist()] + [None] * (len(answers) - 1), pa.list_(pa.int64()))
        return pa.table({"batch": shard["batch"], "shard": shard["shard"], "types": pa.array([types] + [0] * (len(answers) - 1), pa.int64()), "hot_types": once, "data": pa.array(answers, pa.binary())})

    sent = batches.select("batch", "data").mapInArrow(lean(send), "shard bigint, batch bigint, data binary")
    replies = durable(sent.groupBy("shard").applyInArrow(reply, "batch bigint, shard bigint, types bigint, hot_types array<bigint>, data binary"), "lm-replies")
    types = int(replies.agg(F.sum("types")).first()[0] or 0)
    hot_types = np.zeros(len(hot), np.int64)
    for r in replies.select(F.posexplode("hot_types").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect():
        hot_types[r["k"]] = r["n"]
    whole = train_tokens + 0.5 * (types + 1)

    def score(own, got):
        b = Batch(own["data"][0].as_py())
        b.deal(shards, hot)
        counts, fanout = np.zeros(len(b.hashes), np.int64), np.zeros(len(b.hashes), np.int64)
        codes, weights, codes3 = np.zeros(len(b.context), np.uint8), np.zeros(len(b.context), np.uint8), np.zeros(len(b.pair), np.uint8)
        for s, data in zip(got["shard"].to_pylist(), got["data"].to_pylist()):
            pairs, below = b.pairs_of(s), b.triples_of(s)
            counts[b.words_of(s)], fanout[b.words_of(s)], codes[pairs], weights[pairs], codes3[below] = unpack(data, "<u8", "<u4", np.uint8, np.uint8, np.uint8)
        left = lambda n, types: np.where(n > 0, types / np.maximum(1, n + types), 1.0)
        hot_left = left(hot_counts, hot_types)
        base = (counts + 0.5) / whole
        # pairs: the weight that each word leaves to the base; hot words' shares are not smoothed yet
        context = np.where(b.hot_word, known_at(hot, hot_counts, b.hashes), counts)
        leaves = left(context, np.where(b.hot_word, known_at(hot, hot_types, b.hashes), fanout))[b.before]
        n = len(b.before)
        second = restore(codes[:n], lowest) * np.where(b.hot_word[b.before], 1 - leaves, 1.0) + leaves * base[b.after]
        # triples: those of hot pairs came as pairs
        leaves3 = np.where(weights[:n] > 0, restore(weights[:n], lowest), 1.0)
        names = b.pair_names()
        at = np.searchsorted(hot, names)
        at[at == len(hot)] = 0
        leaves3 = np.where(hot[at] == names, hot_left[at], leaves3)
        own3 = restore(codes3, lowest)
        some = b.hot_triple
        own3[some] = restore(codes[n:], lowest) * (1 - leaves3[b.pair[some]])
        final = second[b.pair_of]
        later = np.flatnonzero(b.later)
        final[later] = own3[b.triple_of] + leaves3[b.pair_of[later - 1]] * final[later]
        sums = lambda x: np.add.reduceat(x, b.firsts)
        doc_ids = own["doc_ids"].combine_chunks().flatten()
        trim()
        return pa.table(
            {
                "doc_id": doc_ids, "held_out": pa.array(~b.train), "n_tokens": pa.array(b.sizes + 1), "n_known": pa.array(sums((counts[b.tokens] > 0).astype(np.int64))),
                "train_tokens": pa.array(np.full(len(b.sizes), train_tokens)), "base_score": pa.array(sums(np.log10(base)[b.tokens])), "score": pa.array(sums(np.log10(final))),
            }
        )

    result = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return batches.select("batch", "doc_ids", "data").groupBy("batch").cogroup(replies.select("batch", "shard", "data").groupBy("batch")).applyInArrow(score, result)


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
