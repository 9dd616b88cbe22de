"""What Python workers and written tables need: this package, and a folder that all machines share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for each application."""
    if (app := spark.sparkContext.applicationId) in _SHIPPED:
        return
    top = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp()  # executors fetch from it for as long as the driver lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(path := os.path.join(folder, f"pathkin-{app}.zip"), "w", zipfile.ZIP_DEFLATED) as out:
        for f in sorted(top.rglob("*.py")):
            out.write(f, f.relative_to(top.parent))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


_SHARED: set[str] = set()


def files_at(spark: SparkSession, path: str):
    """The file system of a path, and the path, as the JVM knows them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def shared_dir(spark: SparkSession) -> str:
    """This application's part of the cluster's shared folder, spark.checkpoint.dir; it goes when the driver's JVM ends.

    Where the setting is missing, as in tests, one machine runs everything and a folder under /tmp serves; a cluster without it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file:///tmp/checkpoints"
    path = f"{base.rstrip('/')}/pathkin/{spark.sparkContext.applicationId}"
    if path not in _SHARED:
        _SHARED.add(path)
        files, at = files_at(spark, path)
        files.mkdirs(at)
        files.deleteOnExit(at)
    return path


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, through the JVM's file systems."""
    files, at = files_at(spark, path)
    out = files.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def durable(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it again.

    This cuts lineage so that a lost executor costs no recomputation, and gives Catalyst real sizes. Shuffle files go with the write.
    """
    spark, cleanup = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", spark.conf.get(cleanup)
    spark.conf.set(cleanup, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out
