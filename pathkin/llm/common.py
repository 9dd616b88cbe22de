"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import durable, files_at, shared_dir, ship  # noqa: F401

#: A word is a run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
#: For bytes.translate: A-Z become a-z, nothing else changes (safe in UTF-8).
ASCII_LOWER = bytes.maketrans(_UPPER, _LOWER)
#: Rows and bytes handed to Python at once (one row at least); texts can be long.
ARROW_ROWS, ARROW_BYTES = 1000, 2 << 20


def tune(spark: SparkSession) -> SparkSession:
    """Makes Python operators runnable: sends the package and keeps the Arrow batches small, as single texts may hold megabytes."""
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def trim() -> None:
    """Gives memory that is no longer used back to the system: Python workers live on."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable) -> Callable:
    """run, a function from batches to batches, that trims memory when it ends."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def discard(*tables: DataFrame) -> None:
    """Deletes tables that durable() wrote and nothing reads any more."""
    for t in tables:
        files, at = files_at(t.sparkSession, t.stored_at)
        files.delete(at, True)


def free_name(name: str, *frames: DataFrame) -> str:
    """name, with underscores before it until no column of the frames has it in any case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_file(name: str) -> str:
    """The path of a tokenizer's file on this machine; a name without folders is that of a public tokenizer. Call it where the file is opened."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def id_bucket(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def words(data: bytes) -> list[bytes]:
    """The words of UTF-8 text with A-Z lowered; bytes.split() parts at exactly U+0020 and U+0009 to U+000D."""
    return data.translate(ASCII_LOWER).split()


#: Rows of at most a few numbers each that are sent to every executor: tens of MB.
BROADCAST_ROWS = 1_000_000


def if_small(ids: DataFrame) -> DataFrame:
    """ids (a written table of a few numbers a row), marked for broadcast if it has few enough rows; else any join of it is a shuffle."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
