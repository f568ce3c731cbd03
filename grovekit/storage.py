"""Where intermediate results live: the folder that all executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Folders written by ``materialize`` that are still there.
_written: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where the session names none, one under the system's temporary folder is set
    for it, if it runs on this machine alone; on a cluster, ``RuntimeError``, as
    executors would not see each other's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = known.get() if known.isDefined() else None
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "grovekit-work")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _folder(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage and survives lost executors. The files are removed by
    ``scratch`` or ``discard``, else when the application ends.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/grovekit/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, where = _folder(spark, path)
    files.deleteOnExit(where)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._grovekit_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    if path in _written:
        _written.remove(path)
        files, where = _folder(spark, path)
        files.delete(where, True)


def discard(*frames: DataFrame) -> None:
    """Remove the files of written frames that nothing reads any more; other frames are left alone."""
    for df in frames:
        if path := getattr(df, "_grovekit_path", None):
            _delete(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Removes what ``materialize`` writes within the block, but for the frames that are put into the list."""
    before, kept = set(_written), []
    yield kept
    stay = {getattr(df, "_grovekit_path", None) for df in kept}
    for path in [p for p in _written if p not in before and p not in stay]:
        _delete(spark, path)
