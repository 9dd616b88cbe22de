"""Similarity of predicate pairs by the mutual information of their shared fillers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import positive, shared_features

#: A pair of different predicates counts each shared filler twice by default, a predicate with itself once.
WEIGHTS = ("reference", "single")


def numerators(mi: DataFrame, pairs: DataFrame, weight: str = "reference") -> DataFrame:
    """(p1, p2, slot, contrib): sums over shared fillers, for the wanted pairs (p1, p2) with p1 <= p2.

    Rows of predicates that no pair asks for are cut before anything is shuffled by filler, so that the work follows the
    number of wanted predicates; whether a filler is shared is still counted over all predicates.
    """
    if weight not in WEIGHTS:
        raise ValueError(f"weight must be one of {WEIGHTS}")
    wanted = pairs.select(F.explode(F.array("p1", "p2")).alias("p")).distinct()
    candidates = positive(mi).select("p", "slot", "w", "mi").join(wanted, "p", "left_semi").join(shared_features(mi).select("slot", "w"), ["slot", "w"], "left_semi")
    one = candidates.select(F.col("p").alias("p1"), "slot", "w", F.col("mi").alias("mi1"))
    two = candidates.select(F.col("p").alias("p2"), "slot", "w", F.col("mi").alias("mi2"))
    met = pairs.select("p1", "p2").distinct().join(one, "p1").join(two, ["p2", "slot", "w"])
    sums = met.groupBy("p1", "p2", "slot").agg(F.sum(F.col("mi1") + F.col("mi2")).cast("decimal(37,10)").alias("contrib"))
    # added up rather than multiplied, which would cost the decimals places
    twice = (F.col("p1") != F.col("p2")) & F.lit(weight == "reference")
    return sums.withColumn("contrib", F.when(twice, F.col("contrib") + F.col("contrib")).otherwise(F.col("contrib").cast("decimal(38,10)")))


def similarity(numer: DataFrame, denoms: DataFrame) -> DataFrame:
    """(p1, p2, sim_x, sim_y, s): s is the geometric mean of both slots' similarities.

    Pairs without shared fillers, or with a predicate that has no denominator in a slot, have no row; pairs that share fillers in one slot only have s = 0.
    """
    # 30 digits leave room to add two of them without losing decimals
    by_slot = lambda name, slot: F.sum(F.when(F.col("slot") == slot, F.col(name))).cast("decimal(30,10)")
    sums = numer.groupBy("p1", "p2").agg(by_slot("contrib", "X").alias("num_x"), by_slot("contrib", "Y").alias("num_y"))
    wide = denoms.groupBy("p").agg(by_slot("denom", "X").alias("dx"), by_slot("denom", "Y").alias("dy")).filter("dx IS NOT NULL AND dy IS NOT NULL")
    both = sums.join(wide.select(F.col("p").alias("p1"), F.col("dx").alias("dx1"), F.col("dy").alias("dy1")), "p1")
    both = both.join(wide.select(F.col("p").alias("p2"), F.col("dx").alias("dx2"), F.col("dy").alias("dy2")), "p2")

    def share(num: str, a: str, b: str):
        return F.when(F.col(num) > 0, F.col(num).cast("double") / (F.col(a) + F.col(b)).cast("double")).otherwise(F.lit(0.0))

    both = both.withColumn("sim_x", share("num_x", "dx1", "dx2")).withColumn("sim_y", share("num_y", "dy1", "dy2"))
    return both.select("p1", "p2", "sim_x", "sim_y", F.sqrt(F.col("sim_x") * F.col("sim_y")).alias("s"))


def labelled(similar: DataFrame, pairs: DataFrame) -> DataFrame:
    """similar with the label of each pair, UNK where there is none."""
    return similar.join(pairs.select("p1", "p2", "label"), ["p1", "p2"], "left").withColumn("label", F.coalesce("label", F.lit("UNK")))
