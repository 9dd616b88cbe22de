import math

import numpy as np
import pytest

from pathkin.llm.permutation import PermutationIndex, nearest_neighbours
from pathkin.llm.vafile import VaFile, exact_top_k


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 16))
    rows = [(k, [float(np.float32(x)) for x in centres[k % 6] + 0.3 * rng.normal(size=16)], k % 6, 1.0, "x") for k in range(1, 600)]
    rows[100] = (rows[100][0], rows[99][1], 0, 1.0, "x")  # a tie
    rows += [(600, None, 0, 1.0, "x"), (650, [1.0, None] + [0.0] * 14, 0, 1.0, "x"), (700, [math.nan] * 16, 0, 1.0, "x"), (750, [math.inf] * 16, 0, 1.0, "x"), (800, [0.0] * 16, 0, 1.0, "x"), (None, [0.1] * 16, 0, 1.0, "x"), (850, [0.5, 0.5], 0, 1.0, "x"), (851, [0.5, 0.25], 0, 1.0, "x"), rows[0]]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, score double, rank string")


def usable(vectors, nonzero):
    rows = [(r.vec_id, np.array(r.embedding, np.float64)) for r in vectors.collect() if r.embedding is not None and None not in r.embedding]
    return [(i, v) for i, v in rows if np.isfinite(v).all() and (v.any() or not nonzero)]


def brute(rows, every, k, measure):
    out = {}
    for q, x in rows:
        if q is not None and q % every == 0:
            near = sorted((-measure(x, y), i is None, i or 0) for i, y in rows if i != q and len(x) == len(y))
            out[q] = [(-s, None if none else i) for s, none, i in near[:k]]
    return out


def by_query(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
    return out


@pytest.mark.parametrize("groups", [{}, {"group_rows": 100}])
def test_exact_top_k(vectors, groups):
    whole = lambda v: np.floor(256 * v).astype(np.int64)
    want = brute(usable(vectors, False), 50, 5, lambda x, y: int(whole(x) @ whole(y)))
    assert by_query(exact_top_k(vectors, **groups)) == want


def test_va_file_reads_few_vectors():
    rng = np.random.default_rng(1)
    x = np.floor(256 * rng.normal(size=(4000, 8))).astype(np.int64)
    best, scores, read = VaFile(x).search(x[7], 5, np.array([7]))
    exact = x @ x[7]
    exact[7] = -(10**9)
    assert list(best) == list(np.lexsort((np.arange(4000), -exact))[:5]) and read < 1000


def test_nearest_neighbours(vectors):
    rows = usable(vectors, True)
    want = brute(rows, 20, 20, lambda x, y: float((x * y).sum()))
    got = by_query(nearest_neighbours(vectors, group_rows=200))
    assert got.keys() == want.keys()
    hits = [len({i for _, i in got[q]} & {i for _, i in want[q]}) / max(1, len(want[q])) for q in want]
    assert np.mean(hits) >= 0.9
    by_id = {}
    for i, v in rows:
        by_id.setdefault(i, []).append(v)
    assert all(s == pytest.approx(float(by_id[q][0] @ by_id[i][0]), rel=1e-12) for q in got for s, i in got[q])


def test_footrule():
    rng = np.random.default_rng(2)
    x, p = rng.normal(size=(50, 8)), rng.normal(size=(12, 8))
    index = PermutationIndex(x, p, 5)
    orders = index.permutation(x)
    place = lambda o: {int(v): k for k, v in enumerate(o)}
    for q in range(5):
        a = place(orders[q])
        want = [sum(abs(a.get(v, 5) - b.get(v, 5)) for v in range(12)) for b in map(place, orders)]
        assert index.footrule(orders[q]).tolist() == want


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert exact_top_k(none).count() == 0 and nearest_neighbours(none).count() == 0


def test_recall_at_the_shipped_settings(spark):
    """9,000 vectors of 64 independent directions (two groups) and 1,500 of a second dimension, by brute force."""
    rng = np.random.default_rng(11)
    rows = [(k, rng.normal(size=64)) for k in range(9000)] + [(k, rng.normal(size=24)) for k in range(9000, 10500)]
    rows = [(k, x / np.linalg.norm(x)) for k, x in rows]
    frame = spark.createDataFrame([(k, x.tolist()) for k, x in rows], "vec_id bigint, embedding array<double>")
    got = by_query(nearest_neighbours(frame))
    for low, high in ((0, 9000), (9000, 10500)):
        x = np.array([v for _, v in rows[low:high]])
        hits = []
        for q in range(low, high, 20):
            scores = x @ x[q - low]
            scores[q - low] = -np.inf
            hits.append(len({i for _, i in got[q]} & set((np.argsort(-scores)[:20] + low).tolist())) / 20)
        assert len(got[low]) == 20 and np.mean(hits) >= 0.9, (low, np.mean(hits))


def test_products_that_do_not_fit_are_refused():
    with pytest.raises(OverflowError):
        VaFile(np.full((3, 4), 2**40)).search(np.full(4, 2**40), 2, np.zeros(0, int))
