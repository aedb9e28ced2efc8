"""Intermediate tables in the folder that all executors share.

A written Parquet table cuts lineage like ``checkpoint()`` but keeps column
statistics and compression, and a lost executor only costs the tasks it ran.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only where that is unset and the master is local, as in tests, a private
    folder is made and removed when the process ends; executors elsewhere could
    not read it, so on a cluster an unset folder is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="twinsift-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return f"file://{_own[app]}"


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def materialize(df: DataFrame, tag: str, free: bool = False, parts: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    ``parts`` names a column whose values get a folder each, so that one can be
    discarded before the rest. ``free`` has Spark remove the job's shuffle files once the table is
    written; nothing reads them again, since readers go to the table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/twinsift/{uuid.uuid4().hex}-{tag}"
    schema = df.schema
    with _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", str(free).lower()):
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(parts) if parts else writer).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    if parts:
        out = out.select(*schema.names)  # partition columns are read last
    out.twinsift_path = path
    return out


def union(tables: list[DataFrame]) -> DataFrame:
    """The rows of tables made by :func:`materialize`, which :func:`discard` removes together."""
    out = reduce(DataFrame.union, tables)
    if len(tables) > 1:
        out.twinsift_tables = tables
    return out


def discard(df: DataFrame, part: str | None = None) -> None:
    """Remove a table made by :func:`materialize`, or the part ``column=value`` of it, that nothing reads any more."""
    path = getattr(df, "twinsift_path", None)
    for table in getattr(df, "twinsift_tables", []):
        discard(table, part)
    if path:
        path = f"{path}/{part}" if part else path
        spark = df.sparkSession
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none if it is not there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(p) if f.isDirectory()] if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
