"""Corpus lines to token arrays, and the lines that are rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.staging import staged
from ..functions.text import strict_int, strict_long, trim_controls


def _token(parts: Column, place: Column) -> Column:
    return F.struct(
        (place + 1).cast("int").alias("id"), F.get(parts, F.lit(0)).alias("word"), F.get(parts, F.lit(1)).alias("pos"), F.get(parts, F.lit(2)).alias("rel"),
        F.when(F.size(parts) == 4, strict_int(F.get(parts, F.lit(3)))).alias("head"),
    )


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """lines with toks array<struct<id, word, pos, rel, head>>, count and reason.

    A line is: head word, tab, tokens word/POS/relation/head parted by white space, tab, count, and ignored
    fields. reason is null for a valid line, else why it is rejected: fields, count, token or head (a
    head that is no token of the line). Blank lines have reason blank.
    """
    tokens = F.split(F.rtrim(F.get("_fields", F.lit(1)), F.lit(" \t\n\v\f\r")), r"\s+")
    parts = F.transform(tokens, lambda t: F.split(t, "/", 4))  # once for a token, however many fields are taken from it
    line = trim_controls(F.col(column))
    cut = staged(lines, _line=line, _fields=F.split(line, "\t", 4))
    parsed = staged(cut, count=strict_long(F.get("_fields", F.lit(2))), toks=F.transform(parts, _token))
    within = lambda t: (t["head"] >= 0) & (t["head"] <= F.size("toks"))
    reason = (
        F.when(F.col("_line").isNull() | (F.col("_line") == ""), "blank")
        .when(F.size("_fields") < 3, "fields")
        .when(F.col("count").isNull(), "count")
        .when(F.exists("toks", lambda t: t["head"].isNull()), "token")
        .when(~F.forall("toks", within), "head")
    )
    return staged(parsed, reason=reason).drop("_line", "_fields")


def valid_records(parsed: DataFrame) -> DataFrame:
    return parsed.filter("reason IS NULL").drop("reason")


def rejected_lines(parsed: DataFrame) -> DataFrame:
    """Rejected lines; blank lines are skipped rather than rejected."""
    return parsed.filter("reason IS NOT NULL AND reason != 'blank'").drop("toks", "count")
