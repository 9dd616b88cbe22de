"""Test sets of template pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stemming import with_stem
from ..functions.text import trim_controls


def normalise_templates(df: DataFrame, column: str, out: str) -> DataFrame:
    """df with ``out``, the predicate key of a template: 'X stem [prep ]Y'; null with fewer than three tokens.

    The first and last token are not looked at, nor is anything after the third.
    """
    tokens = F.split(trim_controls(F.regexp_replace(F.col(column), r"\s+", " ")), " ")
    staged = df.withColumn("_t", tokens).withColumn("_verb", F.when(F.size("_t") >= 3, F.get("_t", F.lit(1))))
    staged = with_stem(staged, "_verb", "_stem")
    prep = F.when(F.size("_t") >= 4, F.lower(F.get("_t", F.lit(2))))
    key = F.when(F.col("_stem").isNotNull(), F.concat_ws(" ", F.lit("X"), "_stem", prep, F.lit("Y")))
    return staged.withColumn(out, key).drop("_t", "_verb", "_stem")


def label_of(path: Column) -> Column:
    """NEG, POS or UNK by what a file's name holds."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return F.when(name.contains("negative"), "NEG").when(name.contains("positive"), "POS").otherwise("UNK")


def canonical_pairs(raw: DataFrame) -> DataFrame:
    """(p1, p2, label) with p1 <= p2, one row for each pair, from (left_raw, right_raw, label, precedence).

    Templates that do not normalise drop their pair. Of several labels that of the highest precedence stays (the file read last), ties to the smaller.
    """
    keyed = normalise_templates(normalise_templates(raw, "left_raw", "_l"), "right_raw", "_r").filter("_l IS NOT NULL AND _r IS NOT NULL")
    ordered = keyed.select(F.least("_l", "_r").alias("p1"), F.greatest("_l", "_r").alias("p2"), "label", "precedence")
    best = F.min(F.struct(-F.col("precedence"), "label")).alias("_best")
    return ordered.groupBy("p1", "p2").agg(best).select("p1", "p2", F.col("_best.label").alias("label"))


def read_pairs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lenient reader: (left_raw, right_raw, label, precedence, place); place numbers a file's lines in their order; blank lines and lines of one column are skipped, further columns ignored. The label comes from the file's name, the precedence from the order of paths."""
    parts = []
    for k, path in enumerate(paths):
        line = trim_controls(F.col("value"))
        rows = spark.read.text(path).select(line.alias("value"), label_of(F.input_file_name()).alias("label"), F.monotonically_increasing_id().alias("place"))
        fields = F.split("value", "\t")
        rows = rows.filter("value != ''").filter(F.size(fields) >= 2)
        parts.append(rows.select(F.get(fields, F.lit(0)).alias("left_raw"), F.get(fields, F.lit(1)).alias("right_raw"), "label", F.lit(k).alias("precedence"), "place"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def load_test_pairs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Canonical pairs of the files; an error if there are none."""
    pairs = canonical_pairs(read_pairs(spark, paths))
    if pairs.isEmpty():
        raise ValueError(f"no test pairs in {', '.join(paths)}")
    return pairs


def read_strict(spark: SparkSession, path: str, label: int) -> DataFrame:
    """(left_raw, right_raw, label); blank lines and lines that begin with # are skipped, a line with fewer than two columns or an empty side is an error that names file and line."""
    lines = spark.read.text(path).coalesce(1).withColumn("_n", F.monotonically_increasing_id() + 1)
    value = trim_controls(F.regexp_replace("value", "^﻿", ""))
    lines = lines.select(value.alias("value"), "_n").filter("value != '' AND NOT startswith(value, '#')")
    fields = F.split("value", "\t", -1)
    left, right = trim_controls(F.get(fields, F.lit(0))), trim_controls(F.get(fields, F.lit(1)))
    bad = (F.size(fields) < 2) | (left == "") | (right == "")
    check = lambda c: F.when(bad, F.raise_error(F.concat(F.lit(f"bad line in {path}:"), F.col("_n").cast("string")))).otherwise(c)
    return lines.select(check(left).alias("left_raw"), check(right).alias("right_raw"), F.lit(label).alias("label"))


def test_set_stats(pairs: DataFrame) -> DataFrame:
    """(measure, n): pairs of each label and in all, and distinct templates."""
    counts = pairs.rollup("label").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce(F.concat(F.lit("pairs_"), "label"), F.lit("pairs")).alias("measure"), "n")
    templates = pairs.select(F.explode(F.array("left_raw", "right_raw")).alias("t")).distinct().agg(F.count(F.lit(1)).alias("n")).select(F.lit("templates").alias("measure"), "n")
    return counts.unionByName(templates)


def first_pairs(pairs: DataFrame, k: int = 5) -> DataFrame:
    """The first k pairs in the order of their lists (place), positive lists before negative ones."""
    return pairs.orderBy("precedence", "place").limit(k)
