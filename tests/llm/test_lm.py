import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pathkin.llm.lm import EliasFano, Trie, coded, lm_scores, lowest_of, quantise, restore


@pytest.mark.parametrize("n, universe", [(0, 10), (1, 5), (1000, 2000), (1000, 1 << 64), (5000, 1 << 30), (140000, 1 << 50)])
def test_elias_fano(n, universe):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, universe, n, dtype=np.uint64))
    ef = EliasFano(values, universe)
    assert (ef[np.arange(n)] == values).all()
    asked = np.concatenate((values[:300], rng.integers(0, universe, 300, dtype=np.uint64)))
    found, known = ef.find(asked), set(values.tolist())
    assert all((a >= 0) == (int(x) in known) and (a < 0 or values[a] == x) for a, x in zip(found, asked))


def test_trie_and_codes():
    contexts = np.array([3, 9, 1 << 60], np.uint64)
    trie = Trie(contexts, np.array([0, 2, 3, 5]), np.array([1, 7, 7, 0, 5], np.uint64), np.array([10, 20, 30, 40, 50], np.uint8), np.array([0, 1, 1, 4, 4, 5]), np.array([6, 2, 4, 6, 0], np.uint64), np.array([1, 2, 3, 4, 5], np.uint8), np.array([7, 0, 8, 0, 9], np.uint8))
    nodes = trie.pairs(np.array([3, 3, 9, 9, 1 << 60, 4], np.uint64), np.array([7, 5, 7, 1, 0, 7], np.uint64))
    assert nodes.tolist() == [1, -1, 2, -1, 3, -1] and coded(trie.codes, nodes).tolist() == [20, 0, 30, 0, 40, 0]
    assert trie.triples(np.array([0, 0, 1, 2, 2, 4, -1]), np.array([6, 2, 6, 4, 5, 0, 6], np.uint64)).tolist() == [0, -1, -1, 2, -1, 4, -1]
    for tokens in (100, 10**12):
        low = lowest_of(tokens)
        p = np.logspace(low, 0, 200)
        assert np.abs(np.log10(restore(quantise(p, low), low)) - np.log10(p)).max() < -low / 500 and restore(np.zeros(1, np.uint8), low)[0] == 0


def test_elias_fano_is_smaller_than_the_numbers():
    values = np.sort(np.random.default_rng(1).integers(0, 1 << 40, 200_000, dtype=np.uint64))
    ef = EliasFano(values, 1 << 40)
    size = lambda: sum(x.nbytes for x in vars(ef).values() if isinstance(x, np.ndarray))
    assert (ef.find(values) >= 0).all() and (ef[np.arange(200_000)] == values).all() and size() < 0.75 * values.nbytes


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("batch", [300, 1_000_000])
def test_scores(spark, docs, rows, batch):
    """By brute force; the table has common words and pairs, so that hot contexts of both kinds are spread."""
    more = [(2000 + k, "the same pair " * 40 + f"the same {k} end{k % 7}") for k in range(12)]
    texts = [(r[0], r[1]) for r in rows] + more
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id bigint, text string"))
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    words, pairs, before, triples, before2 = Counter(), Counter(), Counter(), Counter(), Counter()
    grams = lambda w: [(a, b) for a, b in zip(["\n\n", *w], w)]
    for i, t in texts:
        if not held(i):
            w = [*tokens(t), "\n"]
            p = grams(w)
            words.update(w)
            pairs.update(p)
            before.update(a for a, _ in p)
            triples.update((*a, b) for a, b in zip(p, w[1:]))
            before2.update(p[:-1])
    fanout, fanout2, n, v = Counter(a for a, _ in pairs), Counter(x[:2] for x in triples), sum(words.values()), len(words)
    base = lambda x: (words[x] + 0.5) / (n + 0.5 * (v + 1))
    second = lambda a, b: (pairs[a, b] + fanout[a] * base(b)) / (before[a] + fanout[a]) if before[a] else base(b)
    third = lambda p, b: (triples[(*p, b)] + fanout2[p] * second(p[1], b)) / (before2[p] + fanout2[p]) if before2[p] else second(p[1], b)
    got = lm_scores(frame, batch_tokens=batch).collect()
    assert len(got) == len(texts)
    text = dict(texts)
    for r in got:
        w = [*tokens(text[r.doc_id]), "\n"]
        p = grams(w)
        want = [second(*p[0]), *(third(a, b) for a, b in zip(p, w[1:]))]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(w), sum(words[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10(base(x)) for x in w))
        assert r.score == pytest.approx(sum(map(math.log10, want)), abs=0.02 * len(w))


def test_no_texts(none):
    assert lm_scores(none).count() == 0
