"""A corpus pipeline: toxicity, SimHash near-duplicates, secret scans, source mix, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. A stage's result is written as Parquet in the shared folder and read again as the next one's docs.

1. toxicity: texts that the classifier scores 0.5 or more go. It learns from the labels of all ids whose crc32 modulo 5 is not 0, and from the stage's own texts.
2. near_duplicates: texts linked by a Jaccard similarity of 0.8 or more of their five-word shingles form groups; of each one row stays, that with the smallest doc_id.
   SimHash links most copies; an exact join finds the rest. Rows go by their own texts, whatever ids they share: of equal rows one stays, of rows without words one.
3. secrets: values that the forest takes for secrets become [SECRET], and n_chars follows; all rows stay.
4. mix: each row stays as often as the mix takes its words, rounded to whole documents; rows without words stay once.
5. bpe: (doc_id, n_tokens, ids_sha256, decoded_sha256) of each row.

Null texts are empty texts throughout. An empty table passes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathkin.llm.bpe import VOCABULARY, encode_decode
from pathkin.llm.common import durable, free_name, table
from pathkin.llm.mixing import mixed_documents
from pathkin.llm.secrets import redacted
from pathkin.llm.similar import without_near_duplicates
from pathkin.llm.toxicity import without_toxic


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_duplicates(docs)


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    old = free_name("old_length", docs)
    marked = redacted(docs.withColumn(old, F.length("text")))
    return marked.withColumn("n_chars", F.col("n_chars") + F.coalesce(F.length("text") - F.col(old), F.lit(0))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_decode(docs, VOCABULARY, digests=True)


STAGES = [
    ("toxicity", remove_toxic),
    ("near_duplicates", remove_near_duplicates),
    ("secrets", remove_secrets),
    ("mix", mix_sources),
    ("bpe", encode),
]

#: A classifier, SimHash and BPE are not expressible in SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = durable(docs, f"stage-{name}")
    return docs
