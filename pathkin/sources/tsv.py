"""Text sources and sinks: corpus lines, tab-separated tables, object-store paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strict_int, strict_long, trim_controls


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row (value) for each line of the files under path; splittable, compressed files too; hidden files are left out."""
    return spark.read.text(path)


def _parse(field: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.LongType):
        return strict_long(field)
    if isinstance(kind, T.IntegerType):
        return strict_int(field)
    return field if isinstance(kind, T.StringType) else field.try_cast(kind)


def read_tsv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of tab-separated text. Lines with another number of fields or with a field that is no number where one belongs are left out."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    fields = F.split(trim_controls(F.col("value")), "\t", -1)
    rows = read_lines(spark, path).select(fields.alias("f")).filter(F.size("f") == len(schema))
    typed = rows.select(*[_parse(F.get("f", F.lit(k)), c.dataType).alias(c.name) for k, c in enumerate(schema)])
    return typed.dropna(subset=[c.name for c in schema if not isinstance(c.dataType, T.StringType)])


def read_keyed_value(spark: SparkSession, path: str, keys: list[str], value: str) -> DataFrame:
    """Rows of key fields and a number after the last tab; lines with another number of keys or no number are left out."""
    line = trim_controls(F.col("value"))
    rows = read_lines(spark, path).select(F.split(F.regexp_extract(line, r"(?s)^(.*)\t([^\t]*)$", 1), "\t", -1).alias("k"), F.regexp_extract(line, r"(?s)^(.*)\t([^\t]*)$", 2).try_cast("double").alias(value))
    return rows.filter((F.size("k") == len(keys)) & F.col(value).isNotNull()).select(*[F.get("k", F.lit(i)).alias(n) for i, n in enumerate(keys)], value)


def write_tsv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Tab-separated text; fails if path exists. Nulls are written as empty fields."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns or df.columns]
    df.select(F.concat_ws("\t", *fields).alias("value")).write.mode("errorifexists").text(path)


def object_path(path: str, bucket: str | None = None, scheme: str = "s3") -> str:
    """A URI as it is; a bucket-relative path as scheme://bucket/path without doubled slashes."""
    if "://" in path:
        return path
    if not bucket:
        raise ValueError(f"{path} is not a URI and no bucket is given")
    return f"{scheme}://{bucket.strip('/')}/{path.strip('/')}"
