"""Session helpers: one builder for tests/bench, and the shared work folder.

Jobs never invent a machine-local scratch folder.  Anything that has to be
written mid-job (checkpoints, round-trip files, stream state) goes under the
folder the cluster names in ``spark.checkpoint.dir``.  Only when that setting
is absent *and* the master is local (tests) do we set one ourselves.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_spark(master: str | None = None, app: str = "knowtrace", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    settings = {**DEFAULT_CONF, **conf}
    if master:
        builder = builder.master(master)
        # Local mode: the driver JVM is also the executor, so it needs the heap.
        # (On a cluster the deploy sets driver/executor memory.)
        if master.startswith("local") and "spark.driver.memory" not in settings:
            settings["spark.driver.memory"] = os.environ.get("KNOWTRACE_DRIVER_MEMORY", "16g")
        # Few partitions suit one machine; a cluster's own number stands.
        if master.startswith("local"):
            settings.setdefault("spark.sql.shuffle.partitions", "8")
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Root of the cluster-shared work folder (from ``spark.checkpoint.dir``)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set; a shared folder is required on a cluster")
        root = tempfile.mkdtemp(prefix="knowtrace-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def work_path(spark: SparkSession, kind: str) -> str:
    """A fresh, unique sub-path of the shared folder for one job's output."""
    return f"{_own_dir(spark)}/{kind}/{uuid.uuid4().hex}"


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/knowtrace/{spark.sparkContext.applicationId}"


def clear_work(spark: SparkSession) -> None:
    """Delete what this application has written to the shared folder (tables, not checkpoints).

    Results are lazy and read those tables, so call it once they are written elsewhere.
    Checkpoints go with their frames if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, kind: str) -> DataFrame:
    """A table written to the shared folder and read back: computed once, whoever reads it."""
    path = f"{work_path(df.sparkSession, kind)}/t"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
