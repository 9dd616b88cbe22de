"""Counts, marginals and mutual information of (predicate, slot, filler) triples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fixed10


def triple_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("p", "slot", "w").agg(F.sum("c").alias("c"))


def marginals(triples: DataFrame) -> DataFrame:
    """(kind, p, slot, w, n): PS, SW and S sums as one table of grouping sets."""
    view = triples.select("p", "slot", "w", "c")
    sets = view.groupingSets([["p", "slot"], ["slot", "w"], ["slot"]], "p", "slot", "w").agg(F.sum("c").alias("n"), F.grouping("p").alias("_gp"), F.grouping("w").alias("_gw"))
    kind = F.when(F.col("_gp") == 0, "PS").when(F.col("_gw") == 0, "SW").otherwise("S")
    return sets.select(kind.alias("kind"), "p", "slot", "w", "n")


def mutual_information(triples: DataFrame) -> DataFrame:
    """(p, slot, w, c, mi): mi is ln(c * S / (PS * SW)) with ten decimals, for positive counts only.

    S is summed from the PS sums and has one row for each of the two slots, hence the broadcast; the other joins are left to the optimiser.
    """
    ps = triples.groupBy("p", "slot").agg(F.sum("c").alias("ps"))
    sw = triples.groupBy("slot", "w").agg(F.sum("c").alias("sw"))
    s = ps.groupBy("slot").agg(F.sum("ps").alias("s"))
    # marginals that are not positive drop their triples, and c <= 0 can have no logarithm
    joined = triples.filter("c > 0").join(ps.filter("ps > 0"), ["p", "slot"]).join(sw.filter("sw > 0"), ["slot", "w"]).join(F.broadcast(s.filter("s > 0")), "slot")
    real = lambda name: F.col(name).cast("double")
    mi = F.ln(real("c") * real("s") / (real("ps") * real("sw")))
    return joined.select("p", "slot", "w", "c", fixed10(mi).alias("mi"))


def positive(mi: DataFrame) -> DataFrame:
    return mi.filter("mi > 0")


def denominators(mi: DataFrame) -> DataFrame:
    """(p, slot, denom): sums of positive mutual information."""
    return positive(mi).groupBy("p", "slot").agg(F.sum("mi").alias("denom"))


def shared_features(mi: DataFrame) -> DataFrame:
    """(slot, w, predicates): fillers with positive information for two predicates or more."""
    return positive(mi).groupBy("slot", "w").agg(F.count(F.lit(1)).alias("predicates")).filter("predicates >= 2")
