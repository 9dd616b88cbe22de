"""Staged columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def staged(df: DataFrame, **columns: Column) -> DataFrame:
    """df with further columns, each computed once for a row.

    The optimiser would copy a column's expression to each place that reads it, which for nested array expressions multiplies
    the work and the plan. A generator of one row is a border that expressions do not cross.
    """
    one = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_staged")
    return df.select("*", one).select(*[F.col(c) for c in df.columns if c not in columns], *[F.col(f"_staged.{n}").alias(n) for n in columns])
