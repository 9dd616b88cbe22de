import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pathkin.llm import similar
from pathkin.llm.similar import shingle_sets, similar_groups, without_near_duplicates
from pathkin.llm.simhash import shingle_hashes

from .test_simhash import groups


def sets_of(texts):
    return {k: frozenset(shingle_hashes((t or "").encode(), 5)) for k, t in texts.items()}


def brute(texts):
    """Groups of texts by comparing all pairs that share a shingle, and all that have none."""
    sets = sets_of(texts)
    alike = lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    return groups(list(texts), alike)


def found(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    return {r.doc_id: r.component_id for r in similar_groups(docs).collect()}


def test_shingle_sets_tell_the_same_apart():
    r = random.Random(1)
    texts = [None, "", " \t\n", "one", "One\tTWO  three", "a b c d e f g h a b c d e f", "x" * 70000 + " y z", "é  b\x0bc日本 d e f", "A B C D E F G H", "a b  c d e f g h a"]
    texts += [" ".join(r.choice("abAB") for _ in range(r.randint(0, 30))) for _ in range(300)]
    for block in (1 << 20, 50):  # words are hashed in blocks
        similar.BLOCK = block
        hashes, starts = shingle_sets(pa.array(texts), 5)
        got = [frozenset(hashes[a:b].tolist()) for a, b in zip(starts, starts[1:])]
        want = list(sets_of(dict(enumerate(texts))).values())
        assert [len(x) for x in got] == [len(x) for x in want]
        assert [len(a & b) for a in got for b in got] == [len(a & b) for a in want for b in want]
    part = pa.array(["zero", *texts])[1:]
    assert (shingle_sets(part, 5)[0] == hashes).all()


def test_similar_groups(docs, rows, none, spark):
    want = brute({r[0]: r[1] for r in rows if r[0] is not None})
    assert {r.doc_id: r.component_id for r in similar_groups(docs).collect() if r.doc_id is not None} == want and similar_groups(none).count() == 0
    # ids may be text, and may be shared
    named = docs.selectExpr("concat('n', doc_id) AS doc_id", "text")
    assert {r.doc_id for r in similar_groups(named).collect()} == {None if r[0] is None else f"n{r[0]}" for r in rows}


@pytest.mark.parametrize("salts", [1, 8])
def test_many_texts_lose_no_link(spark, salts):
    """2,600 texts: pairs at exactly 0.8 from 4 and 5 shingles on, a chain, large groups of near copies of several kinds, texts that share a passage without being alike."""
    similar.SALTS = salts
    r = random.Random(4)
    texts, at_least = [], 0
    for trial in range(40):
        for size in (8, 12, 14, 16, 20, 24, 36, 44, 54):  # n shingles inside n + n / 4
            own = [f"v{trial}x{size}x{k}" for k in range(size)]
            more = [f"m{trial}x{size}x{k}" for k in range((size - 4) // 4)]
            texts += [own, own + more]
            at_least += 1
    chain = [f"c{k}" for k in range(400)]
    texts += [chain[k : k + 60] for k in range(0, 300, 4)]
    passage = [f"p{k}" for k in range(80)]
    texts += [passage + [f"t{d}x{k}" for k in range(r.randint(10, 45))] for d in range(400)]
    texts += [t[:-1] + ["changed"] for t in texts[-400::3]]
    for length, changes, copies in ((120, 1, 300), (200, 3, 300), (100, 4, 300), (60, 2, 200), (400, 12, 100)):
        base = [f"b{length}x{k}" for k in range(length)]
        for c in range(copies):
            t = list(base)
            for k in range(changes):
                t[r.randrange(length)] = f"n{length}x{c}x{k}"
            texts.append(t)
    texts += [t[:] for t in r.sample(texts, 60)]
    r.shuffle(texts)
    texts = {k: " ".join(t) for k, t in enumerate(texts)}
    sets = sets_of(texts)
    holders = {}
    for k, s in sets.items():
        for h in s:
            holders.setdefault(h, []).append(k)
    pairs = Counter((a, b) for own in holders.values() for i, a in enumerate(own) for b in own[i + 1 :])
    low = {k: k for k in texts}

    def top(k):
        while low[k] != k:
            k = low[k]
        return k

    for (a, b), same in pairs.items():
        if same >= 0.8 * (len(sets[a]) + len(sets[b]) - same):
            a, b = sorted((top(a), top(b)))
            low[b] = a
    want = {k: top(k) for k in texts}
    assert len(texts) > 2500 and sum(k != v for k, v in want.items()) > at_least + 500
    assert found(spark, texts) == want


@pytest.mark.parametrize("sizes", [(4, 5), (8, 10), (16, 20), (40, 50)])
def test_pairs_at_the_limit(spark, sizes):
    n, m = sizes
    texts = {}
    for k in range(100):
        own = [f"w{k}x{j}" for j in range(n + 4)]
        texts[2 * k], texts[2 * k + 1] = " ".join(own), " ".join(own + [f"z{k}x{j}" for j in range(m - n)])
    assert found(spark, texts) == {k: k - k % 2 for k in texts}
    texts = {k: t + " more" * (k % 2) for k, t in texts.items()}  # just below it
    assert found(spark, texts) == {k: k for k in texts}


def test_one_row_of_each_group_stays(spark, none):
    a, b = "the first text has some words", "another text that is not like it"
    rows = [(1, a, 7), (1, a, 7), (2, b, 8), (2, a, 9), (None, b, 1), (None, "without an id " * 5, 1), (None, "without an id " * 5, 1), (4, None, 0), (5, "", 0), (6, " \n", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _id int").repartition(3)
    got = sorted(map(tuple, without_near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(1, a, 7), (2, b, 8), (None, "without an id " * 5, 1), (4, None, 0)], key=repr)
    odd = docs.selectExpr("concat('n', doc_id) AS doc_id", "text", "_id AS key", "_id AS uid", "_id AS row", "_id AS `a b`", "array(_id) AS component", "_id AS kept")
    assert without_near_duplicates(odd).columns == odd.columns and without_near_duplicates(odd).count() == 4
    assert without_near_duplicates(none).count() == 0
