"""The whole dataflow as one plan: corpus lines to labelled similarities."""

from __future__ import annotations

import argparse
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extract import extract_triples
from ..operators.parse import parse_lines, rejected_lines, valid_records
from ..operators.similarity import labelled, numerators, similarity
from ..operators.stats import denominators, marginals, mutual_information
from ..operators.testset import load_test_pairs
from ..session import durable
from ..sources.tsv import object_path, read_lines, write_tsv


@dataclass
class Results:
    rejects: DataFrame
    triples: DataFrame
    marginals: DataFrame
    mi: DataFrame
    denominators: DataFrame
    numerators: DataFrame
    similarity: DataFrame


def build(lines: DataFrame, pairs: DataFrame, weight: str = "reference") -> Results:
    """All tables; triples and mutual information, which several of them read, are written to the shared folder, the others are lazy."""
    parsed = parse_lines(lines)
    triples = durable(extract_triples(valid_records(parsed)), "triples")
    mi = durable(mutual_information(triples), "information")
    denoms = denominators(mi)
    numer = numerators(mi, pairs, weight)
    return Results(rejected_lines(parsed), triples, marginals(triples), mi, denoms, numer, labelled(similarity(numer, denoms), pairs))


def volumes(results: Results) -> DataFrame:
    """(stage, records, bytes): how many rows each table of a run has, and how many bytes they take as tab-separated lines."""
    tables = {name: getattr(results, name) for name in ("triples", "marginals", "mi", "denominators", "numerators", "similarity")}

    def text(t: DataFrame) -> Column:
        """A row as written: doubles with ten decimals, nulls as empty fields."""
        fields = [F.format_string("%.10f", c) if kind == "double" else F.col(c).cast("string") for c, kind in t.dtypes]
        return F.concat_ws("\t", *[F.coalesce(f, F.lit("")) for f in fields])

    counts = [t.agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.sum(F.octet_length(text(t)) + 1), F.lit(0)).alias("bytes")).select(F.lit(name).alias("stage"), "records", "bytes") for name, t in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def checked(results: Results, corpus: str) -> Results:
    """results, or an error if a table that later stages look things up in is empty: the marginals of a kind, or the denominators."""
    kinds = {r["kind"] for r in results.marginals.select("kind").distinct().collect()}  # three at most
    if missing := [k for k in ("PS", "SW", "S") if k not in kinds]:
        raise ValueError(f"no {', '.join(missing)} marginals in {corpus}")
    if results.denominators.isEmpty():
        raise ValueError(f"no triple of {corpus} has positive information")
    return results


def run_pipeline(spark: SparkSession, corpus: str, positive: str, negative: str, out: str, weight: str = "reference") -> Results:
    """Reads corpus and test files, writes (p1, p2, label, s) sorted by pair as tab-separated text to out. An error stops the run; negative labels win over positive ones."""
    results = checked(build(read_lines(spark, corpus), load_test_pairs(spark, [positive, negative]), weight), corpus)
    write_tsv(results.similarity.orderBy("p1", "p2"), out, ["p1", "p2", "label", "s"])
    return results


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Scores pairs of predicate templates by the fillers they share in a parsed corpus.")
    for name in ("corpus", "positive", "negative", "out"):
        parser.add_argument(name)
    parser.add_argument("--bucket", help="bucket of paths that are not URIs")
    given = parser.parse_args(args)
    paths = [object_path(p, given.bucket) if given.bucket else p for p in (given.corpus, given.positive, given.negative, given.out)]
    spark = SparkSession.builder.appName("predicate-similarity").getOrCreate()
    try:
        run_pipeline(spark, *paths)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
