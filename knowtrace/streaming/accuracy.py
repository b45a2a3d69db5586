"""ST2: running tri-state accuracy by month over a growing directory of result files.

A streaming ``groupBy(month)`` keeps one state row per month (the key space
is the calendar, so no watermark is needed); each micro-batch hands the months that changed
to ``foreachBatch``, which merges them into the next version of the table.  After all
files are consumed the output equals the batch A2 (``accuracy_by(..., 'month')``).
Checkpoint and output live in the shared folder, so a restarted job resumes.

A version is a folder of its own, ``version=<epoch>``; a file that names the current one is replaced last, by a
rename.  A reader (:func:`read_current`) thus sees one whole table at any time; the version before stays until
the next one is out, and goes when the run ends.  A replayed epoch that is out already is left as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knowtrace.functions.core import accuracy_pct, month_key
from knowtrace.sources.publish import file_system

POINTER = "_CURRENT"
TABLE = "month string, correct long, incorrect long, unknown long, total long, accuracy double"

RESULTS_SCHEMA = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("death_date", T.DateType()),
        T.StructField("pageviews", T.LongType()),
        T.StructField("knows", T.BooleanType()),
    ]
)


def running_accuracy(stream: DataFrame, date_col: str = "death_date", knows: str = "knows") -> DataFrame:
    """The streaming aggregate (counts only; accuracy is derived per batch)."""
    k = F.col(knows)
    return stream.groupBy(month_key(date_col).alias("month")).agg(
        F.count_if(k).alias("correct"),
        F.count_if(~k).alias("incorrect"),
        F.count_if(k.isNull()).alias("unknown"),
        F.count(F.lit(1)).alias("total"),
    )


def current_version(spark: SparkSession, out_path: str) -> int | None:
    """The number of the version that readers see, None before the first."""
    fs, make = file_system(spark, out_path)
    if not fs.exists(make(out_path, POINTER)):
        return None
    stream = fs.open(make(out_path, POINTER))
    try:
        return int(stream.readUTF())
    finally:
        stream.close()


def _point_to(spark: SparkSession, out_path: str, version: int) -> None:
    """Replace the pointer in one step."""
    fs, make = file_system(spark, out_path)
    fresh = make(out_path, f"{POINTER}.{version}")
    stream = fs.create(fresh, True)
    stream.writeUTF(str(version))
    stream.close()
    jvm = spark.sparkContext._jvm
    fc = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    option = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(option, 1)
    options[0] = option.OVERWRITE
    fc.rename(fresh, make(out_path, POINTER), options)


def _drop_versions(spark: SparkSession, out_path: str, keep: set[int]) -> None:
    fs, make = file_system(spark, out_path)
    for found in fs.globStatus(make(out_path, "version=*")) or []:
        if int(found.getPath().getName().split("=")[1]) not in keep:
            fs.delete(found.getPath(), True)


def read_current(spark: SparkSession, out_path: str) -> DataFrame:
    """The table as of the last version that is out (no rows before the first)."""
    version = current_version(spark, out_path)
    return spark.createDataFrame([], TABLE) if version is None else spark.read.schema(TABLE).parquet(f"{out_path}/version={version}")


def merge_version(spark: SparkSession, changed: DataFrame, out_path: str, epoch: int) -> bool:
    """Publish the current table with the ``changed`` months in place of theirs; False if ``epoch`` is out already."""
    before = current_version(spark, out_path)
    if before is not None and before >= epoch:
        return False
    rest = read_current(spark, out_path).join(F.broadcast(changed.select("month")), "month", "left_anti")
    rest.unionByName(changed).coalesce(1).write.mode("overwrite").parquet(f"{out_path}/version={epoch}")
    _point_to(spark, out_path, epoch)
    _drop_versions(spark, out_path, {epoch, epoch if before is None else before})
    return True


def stream_accuracy(
    spark: SparkSession,
    in_dir: str,
    out_path: str,
    checkpoint: str,
    schema: T.StructType = RESULTS_SCHEMA,
    fmt: str = "parquet",
    max_files_per_trigger: int | None = None,
) -> None:
    """Run until every file present now is consumed (``availableNow``), then stop."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    agg = running_accuracy(reader.load(in_dir))

    def publish(batch: DataFrame, epoch_id: int) -> None:
        # months of the calendar; computed once for the two that read them
        changed = batch.withColumn("accuracy", accuracy_pct("correct", F.col("correct") + F.col("incorrect"))).persist()
        try:
            merge_version(spark, changed, out_path, epoch_id)
        finally:
            changed.unpersist()

    q = (
        agg.writeStream.outputMode("update")
        .foreachBatch(publish)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    out = current_version(spark, out_path)
    if out is not None:
        _drop_versions(spark, out_path, {out})
