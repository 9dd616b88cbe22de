import heapq
from collections import defaultdict

import pytest

from pathkin.llm.mixing import mix, mixed_documents, sainte_lague


def filled(sizes, weights, share=1.0, most=3):
    """Targets by stopping sources and sharing the rest again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, free, target = sum(sizes.values()) * share, set(names), {}
    while free:
        per = left / sum(weight[s] for s in free)
        over = {s for s in free if per * weight[s] > most * sizes[s]}
        if not over:
            return target | {s: per * weight[s] for s in free}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_targets_and_limits(docs, rows):
    got = mix(docs).collect()
    assert len(got) == len(rows)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    assert target == pytest.approx(filled(sizes, (5, 2, 1)))
    assert all(abs(taken[s] - target[s]) <= max(3, 0.02 * target[s]) for s in sizes)
    assert all(r.source_size == sizes[r.source] for r in got)
    assert sorted(map(repr, got)) == sorted(map(repr, mix(docs.repartition(5)).collect()))


def test_empty_table(none):
    assert mix(none).count() == 0 and mixed_documents(none).columns == none.columns and mixed_documents(none).count() == 0


@pytest.mark.parametrize("seats", [0, 1, 7, 100, 1001])
def test_apportionment_equals_seat_by_seat(spark, seats):
    claims = [53.0, 24.0, 23.0, 0.0, 10.5, 10.5, 1.0]
    df = spark.createDataFrame([(0, k, c) for k, c in enumerate(claims)], "g int, k int, claim double")
    from pyspark.sql import functions as F

    got = {r.k: r.n for r in sainte_lague(df, F.lit(seats), "claim", ["g"], "k", "n").collect()}
    heap, want = [(-c, k) for k, c in enumerate(claims) if c], [0] * len(claims)
    heapq.heapify(heap)
    for _ in range(seats):
        _, k = heapq.heappop(heap)
        want[k] += 1
        heapq.heappush(heap, (-claims[k] / (2 * want[k] + 1), k))
    assert got == dict(enumerate(want))


def test_mixed_documents_keep_columns(docs):
    assert mixed_documents(docs).columns == docs.columns


def test_a_tiny_source_leaves_the_other_blocks_alone(spark):
    rows = [(k, "w " * 40, "ab"[k % 2]) for k in range(400)]
    plan = lambda more: {r.doc_id: r.taken for r in mix(spark.createDataFrame(rows + more, "doc_id int, text string, source string")).collect()}
    alone, beside = plan([]), plan([(1000, "two words", "z")])
    tiny = beside.pop(1000)
    assert tiny == 6 and sum(beside.values()) + tiny == pytest.approx(16002, abs=120)
    blocks = lambda taken: {n % 8 for n in taken.values()}
    assert len(set(alone.values())) < 60 and len(set(beside.values())) < 60 and blocks(alone)


@pytest.mark.parametrize("name", ["op1_source_mix", "op4_exact_top_k"])
def test_queries_equal_their_sql(spark, rows, tmp_path, name):
    import duckdb

    from pathkin.llm.queries import ORACLE_SQL, QUERIES

    tiny = [(901, "only two", None, "tiny", 8)]
    spark.createDataFrame([(r[0], r[1], r[2], r[3], r[4]) for r in rows] + tiny, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    vectors = [(k, [((k * 37 + j * 11) % 19 - 9) / 8 for j in range(6)]) for k in range(300)] + [(300, None), (350, [float("nan")] * 6), (400, [0.5, None, 0.0, 0.0, 0.0, 0.0])]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = QUERIES[name](spark, str(tmp_path))
    columns = ", ".join(sorted(got.columns))
    want = db.execute(f"SELECT {columns} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.selectExpr(*columns.split(", ")).collect()))) == sorted(map(repr, want))


def test_rows_that_share_an_id_share_its_count(spark):
    rows = [(1, "a b c", "x")] * 2 + [(None, "d e", "x"), (None, "d e f", "x"), (2, "", "x"), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string")
    got = mixed_documents(docs).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, rows))
