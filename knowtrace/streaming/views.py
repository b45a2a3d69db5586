"""A store of daily views by epoch and month, and totals that late views correct (ST1, J1).

The store is ``epoch=<n>/month=<YYYY-MM>`` (a folder a day would be thousands of small ones): epoch 0 is what was there first, each later epoch one micro-batch of
late views, its own folder, overwritten when the batch is replayed.  A total is stamped with the epoch it was summed
up to, so which views it holds is known, and none counts twice or is left out:

* :func:`totals` sums a window over the epochs up to a number; the days are bounds known before the scan, so
  months and epochs are partition filters and the days are pushed to the files;
* :func:`stream_views` stores each batch of late views as an epoch and reopens the 60-day windows that its days touch:
  entities with such a window get a new total, published in the epoch's own folder;
* :func:`read_ingested` takes each entity's total with the highest epoch.  An entity without any view is kept
  aside, so that late views can still bring it in.

An entity that is stored while a batch of views is under way may carry an older epoch; the next batch reopens it, as
it looks for entities behind any epoch whose days touch them.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knowtrace.operators import pageviews
from knowtrace.session import stored

VIEWS_SCHEMA = T.StructType([T.StructField("article", T.StringType()), T.StructField("day", T.DateType()), T.StructField("views", T.LongType())])
STORED = "article string, day date, views long, epoch int, month string"
TOTALS = "article_title string, death_date date, pageviews long, views_epoch int, epoch string, month string"
ENTITIES = "name string, article_title string, death_date date, description string, pageviews long, views_epoch int, epoch string, month string"
BEFORE, AFTER = 1, 58


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of Parquet, or no rows where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def store_views(views: DataFrame, store: str, epoch: int = 0) -> None:
    """Write normalised daily views (:func:`pageviews.daily_views`) as one epoch; again, if it was there."""
    rows = views.select("article", "day", "views", F.date_format("day", "yyyy-MM").alias("month"))
    rows.hint("rebalance", "month").sortWithinPartitions("month", "day").write.mode("overwrite").partitionBy("month").parquet(f"{store}/epoch={epoch}")


def last_epoch(spark: SparkSession, store: str) -> int:
    """The last epoch of the store, -1 for none.  An epoch appears when it is whole (``_SUCCESS``)."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, "epoch=*/_SUCCESS")) or []
    done = {int(s.getPath().getParent().getName().split("=")[1]) for s in found}
    n = -1
    while n + 1 in done:
        n += 1
    return n


def stored_views(spark: SparkSession, store: str, upto: int, days: tuple[dt.date, dt.date] | None = None, after: int = -1) -> DataFrame:
    """Views of the epochs ``after + 1`` to ``upto``, on ``days`` (first and last) or on all."""
    rows = read(spark, store, STORED).where(F.col("epoch").between(after + 1, upto))
    if days is None:
        return rows
    return rows.where(F.col("month").between(*(f"{d:%Y-%m}" for d in days)) & F.col("day").between(*map(F.lit, days)))


def date_bounds(entities: DataFrame, date_col: str = "death_date") -> tuple[dt.date, dt.date] | None:
    """The days that the windows of the entities reach, or None without entities.  A small job of its own."""
    lo, hi = entities.agg(F.min(date_col), F.max(date_col)).first()
    return None if lo is None else (lo - dt.timedelta(days=BEFORE), hi + dt.timedelta(days=AFTER))


def totals(entities: DataFrame, store: str, upto: int) -> DataFrame:
    """``entities`` with pageviews (NULL without a view) and views_epoch."""
    bounds = date_bounds(entities)
    if bounds is None:
        return entities.select("*", F.lit(None).cast("long").alias("pageviews"), F.lit(upto).alias("views_epoch"))
    views = stored_views(entities.sparkSession, store, upto, bounds).select("article", "day", "views")
    return pageviews.attach_pageviews(entities, views, before=BEFORE, after=AFTER).withColumn("views_epoch", F.lit(upto))


def _ingested(spark: SparkSession, out_dir: str) -> DataFrame:
    """Entities as first written, those without views included."""
    return read(spark, f"{out_dir}/entities", ENTITIES).unionByName(read(spark, f"{out_dir}/missing", ENTITIES))


def _corrected(spark: SparkSession, out_dir: str) -> DataFrame:
    """article_title, death_date, total, total_epoch: the latest correction of each window."""
    latest = read(spark, f"{out_dir}/corrections", TOTALS).groupBy("article_title", "death_date")
    return latest.agg(F.max_by("pageviews", "views_epoch").alias("total"), F.max("views_epoch").alias("total_epoch"))


def read_ingested(spark: SparkSession, out_dir: str) -> DataFrame:
    """name, article_title, death_date, description, pageviews, views_epoch of all entities that have views by now."""
    rows, fixed = _ingested(spark, out_dir), _corrected(spark, out_dir)
    out = rows.join(fixed, ["article_title", "death_date"], "left")
    newer = F.coalesce(F.col("total_epoch") > F.col("views_epoch"), F.lit(False))
    out = out.select(
        "name", "article_title", "death_date", "description",
        F.when(newer, F.col("total")).otherwise(F.col("pageviews")).alias("pageviews"),
        F.when(newer, F.col("total_epoch")).otherwise(F.col("views_epoch")).alias("views_epoch"),
    )
    return out.where("pageviews IS NOT NULL")


def reopened(spark: SparkSession, store: str, out_dir: str, epoch: int) -> DataFrame | None:
    """article_title, death_date of the windows that views newer than their total touch, or None.

    The days of the epoch bound the months of entities that are read; a window behind several epochs counts as well.
    """
    days = tuple(stored_views(spark, store, epoch, after=0).agg(F.min("day"), F.max("day")).first())
    if days[0] is None:
        return None
    lo, hi = days[0] - dt.timedelta(days=AFTER), days[1] + dt.timedelta(days=BEFORE)
    rows = _ingested(spark, out_dir).where(F.col("month").between(f"{lo:%Y-%m}", f"{hi:%Y-%m}") & F.col("death_date").between(F.lit(lo), F.lit(hi)))
    fixed = _corrected(spark, out_dir)
    rows = rows.join(fixed, ["article_title", "death_date"], "left")
    held = F.greatest(F.col("views_epoch"), F.coalesce("total_epoch", F.lit(-1)))
    keys = rows.select("article_title", "death_date", held.alias("held")).groupBy("article_title", "death_date").agg(F.min("held").alias("held"))
    late = stored_views(spark, store, epoch, days, after=0).select(F.col("article").alias("key"), "day", F.col("epoch").alias("late_epoch"))
    touched = (F.col("key") == pageviews.title_key("article_title")) & F.col("day").between(F.date_sub("death_date", BEFORE), F.date_add("death_date", AFTER))
    return keys.join(late, touched & (F.col("late_epoch") > F.col("held")), "left_semi").select("article_title", "death_date")


def stream_views(spark: SparkSession, in_dir: str, store: str, out_dir: str, checkpoint: str, schema: T.StructType = VIEWS_SCHEMA, fmt: str = "parquet", max_files_per_trigger: int | None = None) -> None:
    """Store every file of late views present now, correct the totals it touches, stop."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))

    def process(batch: DataFrame, batch_id: int) -> None:
        epoch = batch_id + 1  # the store's epoch 0 was there first
        store_views(pageviews.daily_views(batch), store, epoch)
        keys = reopened(spark, store, out_dir, epoch)
        if keys is not None:
            # found once: the bounds, the windows and the sums all read them
            fixed = totals(stored(keys, "reopened"), store, epoch).withColumn("month", F.date_format("death_date", "yyyy-MM"))
            fixed.hint("rebalance", "month").write.mode("overwrite").partitionBy("month").parquet(f"{out_dir}/corrections/epoch={epoch}")

    query = reader.load(in_dir).writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
