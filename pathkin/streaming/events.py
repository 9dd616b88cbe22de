"""The same parsing and extraction over a stream of corpus files.

Counts are kept by verb form, which needs no lookup on the stream; stems are joined when the counts are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extract import verb_events, with_key
from ..operators.parse import parse_lines, valid_records


def stream_verb_counts(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """A streaming DataFrame (verb, prep, slot, w, c) that grows as files arrive in folder; write it in complete or update mode."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return verb_events(valid_records(parse_lines(lines))).groupBy("verb", "prep", "slot", "w").agg(F.sum("c").alias("c"))


def triples_of(counts: DataFrame) -> DataFrame:
    """Triple counts (p, slot, w, c) of a snapshot of verb counts."""
    return with_key(counts).groupBy("p", "slot", "w").agg(F.sum("c").alias("c"))
