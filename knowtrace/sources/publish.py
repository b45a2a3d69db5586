"""Staged publish of file outputs: one write beside the target, swapped in only if rows came.

The rows are written once, to a hidden folder next to the target, and counted while they are written.  An empty run drops
that folder and leaves an earlier output alone.  Otherwise the folder is renamed into place (``overwrite``) or its files are
moved next to those already there (``append``).  A job killed on the way leaves the target as it was, or, between the two
renames of an overwrite, whole under the name ``.<target>.old-...``; never half-written.  Renames are cheap and atomic on
HDFS and local disks; on object stores they copy.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, DataFrameWriter, Observation, SparkSession
from pyspark.sql import functions as F


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and a function that makes its paths."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def _files(fs, folder) -> list:
    found, out = fs.listFiles(folder, True), []
    while found.hasNext():
        out.append(found.next().getPath())
    return out


def publish(df: DataFrame, path: str, save: Callable[[DataFrameWriter, str], None], mode: str = "overwrite") -> bool:
    """Write ``df`` by ``save(writer, folder)`` and put it at ``path``; False, and nothing changed, without rows."""
    if mode not in ("overwrite", "append"):
        raise ValueError("mode must be 'overwrite' or 'append'")
    spark = df.sparkSession
    fs, make = file_system(spark, path)
    target = make(path)
    sign = uuid.uuid4().hex[:12]
    staged, old = (make(target.getParent(), f".{target.getName()}.{kind}-{sign}") for kind in ("staged", "old"))
    seen = Observation()
    save(df.observe(seen, F.count(F.lit(1)).alias("rows")).write, staged.toString())
    if not seen.get.get("rows"):
        fs.delete(staged, True)
        return False
    fs.mkdirs(target.getParent())
    if mode == "append" and fs.exists(target):
        root = staged.toUri().getPath()
        for file in _files(fs, staged):
            inner = file.toUri().getPath()[len(root) + 1 :]
            if not file.getName().startswith(("_", ".")):
                place = make(target, inner)
                fs.mkdirs(place.getParent())
                if not fs.rename(file, place):
                    raise OSError(f"cannot move {file} to {place}")
        fs.delete(staged, True)
        return True
    if fs.exists(target) and not fs.rename(target, old):
        raise OSError(f"cannot move {target} to {old}")
    if not fs.rename(staged, target):
        raise OSError(f"cannot move {staged} to {target}")
    fs.delete(old, True)
    return True
