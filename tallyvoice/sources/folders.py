"""Folders that driver and executors share, through Spark's own file systems."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where it is unset, a temporary folder is set in local mode only (one machine, as in tests); on a
    cluster its executors would each write to their own disks, so a RuntimeError says what to set.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tallyvoice-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def _located(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _located(spark, path)
    return files.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder and all in it; nothing may read it any more."""
    files, where = _located(spark, path)
    files.delete(where, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; none if there is no folder."""
    files, where = _located(spark, path)
    return sorted(x.getPath().getName() for x in files.listStatus(where)) if files.exists(where) else []


def whole(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end: the committer marks it."""
    return exists(spark, f"{path}/_SUCCESS")
