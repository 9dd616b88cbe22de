import random
import re

import numpy as np
import xxhash

from pathkin.llm.components import components
from pathkin.llm.simhash import hamming_links, near_duplicates, shingle_hashes


def fingerprint(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(items, linked):
    """The smallest reachable item of each."""
    low = {i: i for i in items}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in items:
        for j in items:
            if i < j and linked(i, j):
                a, b = sorted((find(i), find(j)))
                low[b] = a
    return {i: find(i) for i in items}


def test_fingerprints_and_components(docs, rows, none):
    got = [r for r in near_duplicates(docs).collect()]
    assert len(got) == len(rows)
    prints = {r[0]: fingerprint(r[1]) for r in rows if r[0] is not None}
    want = groups(list(prints), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    for r in got:
        if r.doc_id is not None:
            assert (r.fp & (2**64 - 1), r.component_id) == (prints[r.doc_id], want[r.doc_id])
    assert near_duplicates(none).count() == 0


def test_links_connect_the_same_components(spark):
    r = random.Random(5)
    values = {r.getrandbits(64) for _ in range(60)}
    for v in list(values)[:12]:  # chains, and a run too full to compare pair by pair
        values |= {v ^ 1 << r.randrange(64) for _ in range(6)} | {v ^ 1 << r.randrange(64) ^ 1 << r.randrange(64) for _ in range(4)}
    hub = r.getrandbits(64)
    values |= {hub ^ 1 << k for k in range(40)}
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    want = groups(signed, lambda i, j: ((i ^ j) & (2**64 - 1)).bit_count() <= 2)
    fps = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    for distance, pairwise in ((2, 64), (2, 4)):
        links = hamming_links(fps, distance, pairwise=pairwise)
        assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 2 for r in links.collect())
        found = {r.node: r.component for r in components(links).collect()}
        assert {i: found.get(i, i) for i in signed} == want


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 90), (90, 95), (7, 7), (200, 201), (200, 201)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {95: 90, 100: 90, 201: 200}
