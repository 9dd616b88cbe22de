"""Text helpers with the semantics that the corpus format asks for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim_controls(value: Column) -> Column:
    """Strips all characters up to U+0020 at both ends (Spark's trim strips spaces only)."""
    return F.btrim(value, F.lit("".join(map(chr, range(33)))))


def strict_long(value: Column) -> Column:
    """A signed whole number without blanks or decimals; anything else is null."""
    return F.when(value.rlike(r"^[+-]?[0-9]+$"), value.try_cast("bigint"))


def strict_int(value: Column) -> Column:
    return F.when(value.rlike(r"^[+-]?[0-9]+$"), value.try_cast("int"))


def fixed10(value: Column) -> Column:
    """Ten decimals, half up, as an exact decimal: sums no longer depend on the order of rows."""
    return F.format_string("%.10f", value).cast("decimal(18,10)")
