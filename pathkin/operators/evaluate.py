"""Evaluation of scored, labelled pairs (p1, p2, label, s): a pair is predicted POS if s >= t."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable


def _rates(df: DataFrame) -> DataFrame:
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    return df.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn)).withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn))


def threshold_sweep(scored: DataFrame, steps: int = 4096) -> DataFrame:
    """(t, tp, fp, tn, fn, precision, recall, f1) for each distinct score as threshold.

    Running sums in two levels: scores are dealt to ranges of 1/steps; only the sums of ranges meet in one task, and each range adds up its own scores.
    """
    known = scored.filter("label IN ('POS', 'NEG')")
    each = known.groupBy("s").agg(F.sum(F.when(F.col("label") == "POS", 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col("label") == "NEG", 1).otherwise(0)).alias("neg"))
    each = durable(each.withColumn("_range", F.floor(F.col("s") * steps)), "scores")
    above, whole = Window.orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    ranges = each.groupBy("_range").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    before = lambda c: F.coalesce(F.sum(c).over(above), F.lit(0))
    ranges = ranges.select("_range", before("_p").alias("_tp"), before("_n").alias("_fp"), F.sum("_p").over(whole).alias("_pos"), F.sum("_n").over(whole).alias("_neg"))
    down = Window.partitionBy("_range").orderBy(F.col("s").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = each.join(ranges, "_range").select(F.col("s").alias("t"), (F.sum("pos").over(down) + F.col("_tp")).alias("tp"), (F.sum("neg").over(down) + F.col("_fp")).alias("fp"), "_pos", "_neg")
    return _rates(swept.select("t", "tp", "fp", (F.col("_neg") - F.col("fp")).alias("tn"), (F.col("_pos") - F.col("tp")).alias("fn")))


def best_threshold(swept: DataFrame, least_tn: int = 5) -> DataFrame:
    """The row of a sweep with the best F1 among those with at least so many true negatives; ties to the larger threshold."""
    return swept.filter(F.col("tn") >= least_tn).orderBy(F.col("f1").desc(), F.col("t").desc()).limit(1)


def outcome(t: Column | float) -> Column:
    t = t if isinstance(t, Column) else F.lit(t)
    hit = F.col("s") >= t
    return F.when(F.col("label") == "POS", F.when(hit, "TP").otherwise("FN")).when(F.col("label") == "NEG", F.when(hit, "FP").otherwise("TN"))


def confusion_matrix(scored: DataFrame, t: Column | float) -> DataFrame:
    """One row: tp, fp, tn, fn, precision, recall, f1 at threshold t."""
    count = lambda name: F.coalesce(F.sum(F.when(F.col("_o") == name, 1).otherwise(0)), F.lit(0)).alias(name.lower())
    return _rates(scored.withColumn("_o", outcome(t)).agg(*[count(n) for n in ("TP", "FP", "TN", "FN")]))


def error_samples(scored: DataFrame, t: Column | float, k: int = 5) -> DataFrame:
    """(outcome, place, p1, p2, label, s): the k pairs of each outcome whose scores are nearest to t, ties by pair."""
    t = t if isinstance(t, Column) else F.lit(t)
    near = Window.partitionBy("outcome").orderBy(F.abs(F.col("s") - t), "p1", "p2")
    judged = scored.withColumn("outcome", outcome(t)).filter("outcome IS NOT NULL")
    return judged.withColumn("place", F.row_number().over(near)).filter(F.col("place") <= k).select("outcome", "place", "p1", "p2", "label", "s")


def run_comparison(small: DataFrame, large: DataFrame) -> DataFrame:
    """(p1, p2, label, s_small, s_large) for pairs that both runs score."""
    return small.select("p1", "p2", "label", F.col("s").alias("s_small")).join(large.select("p1", "p2", F.col("s").alias("s_large")), ["p1", "p2"])
