import random

import corpus_pipeline
import pytest

from .conftest import near, prose

CLASHES = "1 AS _id, 2 AS _old, array(5) AS _matches, 'p' AS _pieces, 3 AS _found, 4 AS _threshold, 5 AS _copy, 6 AS _times, 7 AS _source, 8 AS `key`, 9 AS `row`, 10 AS old_length".split(", ")


@pytest.fixture(scope="module")
def folder(spark, docs, labels, tmp_path_factory):
    """Nulls in all columns, repeated rows, shared and null ids, and a text of 10 MB."""
    path = tmp_path_factory.mktemp("tables")
    r = random.Random(2)
    long = " ".join(r.choice("abcdefgh") * r.randint(1, 9) for _ in range(1_900_000))
    more = spark.createDataFrame([(5, prose(77, 50), None, "a", None), (None, None, None, None, None), (None, "no id", None, None, None), (900, long, "en", "b", len(long))], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(more).write.parquet(f"{path}/documents.parquet")
    labels.select("doc_id", "quality", "toxic").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, folder)
        kept[name] = docs.collect()
        if name != "bpe":
            assert docs.columns == before.columns
    toxic = {d for d, t in texts.items() if "idiot" in (t or "")}
    assert len(toxic & {r.doc_id for r in kept["toxicity"]}) <= 0.2 * len(toxic)
    one = [r.doc_id for r in kept["near_duplicates"]]
    assert len(set(one) - {None}) == len([d for d in one if d is not None]) - 1  # 5 has two texts that are not alike
    assert one.count(5) == 2 and one.count(None) == 1 and 900 in one and not {1, 2, 6, 7, 8} & set(one) and 0 in one
    assert not any("9b1c02d7a4e8f365" in (r.text or "") for r in kept["secrets"]) and len(kept["secrets"]) == len(one)
    assert {r.doc_id for r in kept["mix"]} <= set(one) and {r.doc_id for r in kept["bpe"]} == {r.doc_id for r in kept["mix"]}
    assert near(1, 60, 1) != prose(1, 60)


def test_other_columns_pass_unchanged(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id < 40").selectExpr("*", *CLASHES)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert out.selectExpr(*[c.split(" AS ")[1] for c in CLASHES]).distinct().count() == 1
        assert out.selectExpr(*[c.split(" AS ")[1] for c in CLASHES]).first() == docs.selectExpr(*[c.split(" AS ")[1] for c in CLASHES]).first()


def test_run(spark, folder, none, tmp_path):
    assert corpus_pipeline.run(spark, folder).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    none.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
