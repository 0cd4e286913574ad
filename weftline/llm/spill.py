"""Cutting lineage with files that all executors and the driver can read."""

from __future__ import annotations

import re
import tempfile

from urllib.parse import urlsplit
from uuid import uuid4

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Spark's option to delete the shuffle files of a query when it ends.
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one where it is unset and the session is local, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="weftline-")
        spark.sparkContext.setCheckpointDir(folder)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, and its path there."""
    parts = urlsplit(folder)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path
    return fs.FileSystem.from_uri(folder)


def stored(frame: DataFrame) -> DataFrame:
    """``frame`` computed once and written to the shared folder, so that no lost executor can lose it."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


def written(frame: DataFrame, folder: str | None = None, release: bool = False) -> DataFrame:
    """As ``stored``, as a compressed table, in ``folder`` if one is named: for many narrow rows, and for rounds.

    A checkpoint hands on the size that its plan was estimated at. Over rounds of joins each estimate is a product of the last
    ones, a number with four times the digits each round, until the driver has no room for it. A table has its own size.
    With ``release``, what was shuffled on the way goes at once, not when the driver happens to collect its garbage.
    """
    spark = frame.sparkSession
    folder = folder or new_table(spark)
    before = spark.conf.get(_RELEASE, None)
    if release:
        spark.conf.set(_RELEASE, "true")
    try:
        frame.write.parquet(folder)
    finally:
        if release:
            spark.conf.unset(_RELEASE) if before is None else spark.conf.set(_RELEASE, before)
    return spark.read.schema(frame.schema).parquet(folder)


def new_table(spark: SparkSession) -> str:
    """The name of a new folder for a table."""
    return f"{shared_folder(spark).rstrip('/')}/table-{uuid4().hex}"


def delete(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of this library in whatever store Spark keeps it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def splittable(grouped: DataFrame, key: str) -> DataFrame:
    """``grouped``, the result of a grouping by the integer ``key``, to be joined on it to rows with hot keys.

    Adaptive execution splits a hot key only where both sides are shuffled for the join. A grouping by the
    key is not, unless the key is a new expression.
    """
    return grouped.withColumn(key, F.shiftleft(key, 0))
