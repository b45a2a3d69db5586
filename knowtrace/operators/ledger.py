"""Month ledger: which months are collected, stated and not guessed (K4 ``manifest``, D8).

The default resume rule takes any row of a month for the whole month.  A ledger says it:
a run writes its rows under ``data/month=<month>/run=<run>``, and only when they all lie there does it
add a line a month (rows included, zero too) to ``ledger``.  So

* a month without rows is done and not tried again;
* a month of a run that ended before its lines were written is collected again, and what that run left is
  never read, because readers take the runs of the ledger only;
* of two runs that collected the same month, the one committed under the smaller name (they begin with the time) is read;
* months are collected whole, whatever days were asked for: the range is applied when the rows are read.

The ledger has a few rows a month of the calendar, so it is broadcast; as ``month`` and ``run`` are partition
columns, the join prunes the folders that are read.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knowtrace.operators import select
from knowtrace.operators import wikitext as W
from knowtrace.operators.ingest import collect_entities

LINES = "month_key string, run string, rows long"
ROWS = "name string, death_date date, description string, pageviews long, month string, run string"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def new_run() -> str:
    return f"{time.time_ns() // 1_000_000:013d}-{uuid.uuid4().hex[:8]}"


def committed(spark: SparkSession, path: str) -> DataFrame:
    """month_key, run, rows: the months that are done, and by which run."""
    lines = _read(spark, f"{path}/ledger", LINES)
    first = lines.groupBy("month_key").agg(F.min("run").alias("run"))
    return lines.join(F.broadcast(first), ["month_key", "run"]).distinct()


def pending(spark: SparkSession, path: str, start, end) -> DataFrame:
    """The months that touch ``[start, end]`` and are not in the ledger."""
    wanted = W.month_starts(spark, start, end).withColumn("month_key", F.date_format("month_start", "yyyy-MM"))
    return wanted.join(F.broadcast(committed(spark, path).select("month_key")), "month_key", "left_anti")


def write_rows(rows: DataFrame, path: str, run: str) -> DataFrame:
    """Write a run's rows (nothing is done by that) and return month_key, rows as they lie there."""
    out = rows.select("name", "death_date", "description", "pageviews", F.date_format("death_date", "yyyy-MM").alias("month"), F.lit(run).alias("run"))
    out.repartition("month").write.mode("append").partitionBy("month", "run").parquet(f"{path}/data")
    mine = _read(rows.sparkSession, f"{path}/data", ROWS).where(F.col("run") == run)
    return mine.groupBy(F.col("month").alias("month_key")).agg(F.count(F.lit(1)).alias("rows"))


def commit(months: DataFrame, written: DataFrame, path: str, run: str) -> None:
    """One line a month, in one file: readers see all of a run's months or none."""
    lines = months.select("month_key").join(F.broadcast(written), "month_key", "left")
    lines = lines.select("month_key", F.lit(run).alias("run"), F.coalesce("rows", F.lit(0)).cast("long").alias("rows"))
    lines.coalesce(1).write.mode("append").parquet(f"{path}/ledger")


def collect_months(pages: DataFrame, views: DataFrame, path: str, start, end, title: str = "title", corrections: DataFrame | None = None) -> str | None:
    """Collect the months that the ledger lacks, whole; the run's name, or None if all are done."""
    spark = pages.sparkSession
    todo = pending(spark, path, start, end)
    span = todo.agg(F.min("month_start"), F.last_day(F.max("month_start"))).first()
    if span[0] is None:
        return None
    months = spark.createDataFrame(todo.collect(), todo.schema)  # months of the calendar; fixed for this run
    rows, _ = collect_entities(pages, views, *span, title, months=months, corrections=corrections)
    run = new_run()
    commit(months, write_rows(rows, path, run), path, run)
    return run


def read_months(spark: SparkSession, path: str, start=None, end=None) -> DataFrame:
    """The rows of the committed months in ``[start, end]``."""
    rows = _read(spark, f"{path}/data", ROWS)
    done = committed(spark, path).select(F.col("month_key").alias("month"), "run")
    if start is not None:
        done = done.where(F.col("month") >= str(start)[:7])
    if end is not None:
        done = done.where(F.col("month") <= str(end)[:7])
    rows = rows.join(F.broadcast(done), ["month", "run"])
    return select.date_range(rows.select("name", "death_date", "description", "pageviews"), start, end)
