"""ST1: incremental month-page ingestion with Structured Streaming.

A file-source stream over a directory of page files; each micro-batch is
parsed (T1), joined to the static daily-view table (J1), rows without an
article dropped (P3), and written to the entity output under
``epoch=<batch id>/month=<YYYY-MM>``; rejects go to a sibling folder.  Each
epoch owns its folder and overwrites it, so a replayed batch is idempotent.  The checkpoint records which files
were consumed, so a re-run with ``availableNow`` processes only new files
(the streaming form of the reference's resume-by-month).

The views are a table, or the path of a store (:mod:`knowtrace.streaming.views`).  With a store a micro-batch
reads the days its own windows reach and no others, totals are stamped with the store's epoch, and entities
without views are kept under ``missing``, so that late views can correct both (``stream_views``).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knowtrace.functions.core import month_key
from knowtrace.operators import pageviews, select
from knowtrace.operators import wikitext as W
from knowtrace.streaming.views import AFTER, BEFORE, last_epoch, totals

PAGES_SCHEMA = T.StructType(
    [
        T.StructField("page_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("month", T.IntegerType()),
        T.StructField("text", T.StringType()),
    ]
)


def month_bounds(pages: DataFrame) -> tuple[dt.date, dt.date] | None:
    """The days that windows of entities on these pages can reach, from the pages' months alone (nothing is parsed)."""
    month = F.col("year") * 12 + F.col("month") - 1
    lo, hi = pages.agg(F.min(month), F.max(month)).first()
    if lo is None:
        return None
    return dt.date(lo // 12, lo % 12 + 1, 1) - dt.timedelta(days=BEFORE), dt.date((hi + 1) // 12, (hi + 1) % 12 + 1, 1) + dt.timedelta(days=AFTER - 1)


def stream_ingest(
    spark: SparkSession,
    in_dir: str,
    out_dir: str,
    checkpoint: str,
    views: DataFrame | str,
    schema: T.StructType = PAGES_SCHEMA,
    fmt: str = "parquet",
    max_files_per_trigger: int | None = None,
) -> None:
    """Consume every page file present now, append entities/rejects, stop."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    pages = reader.load(in_dir)

    def process(batch: DataFrame, epoch_id: int) -> None:
        # One parse feeds two sinks and the view join (which reads its input
        # three times): persist it for this batch only (spills to disk; a lost
        # block is recomputed from the batch's files).
        parsed = W.parse_all(batch).persist()
        try:
            ent = parsed.where(F.col("code") == "ok").select(*W.ENTITY_COLS)
            rej = parsed.where(F.col("code") != "ok").select(*W.REJECT_COLS)
            if isinstance(views, str):
                every = totals(ent, views, last_epoch(spark, views)).withColumn("month", month_key("death_date")).persist()
                columns = ["name", "article_title", "death_date", "description", "pageviews", "views_epoch", "month"]
                lost = every.where(F.col("pageviews").isNull()).select(*columns)
                lost.hint("rebalance", "month").write.mode("overwrite").partitionBy("month").parquet(f"{out_dir}/missing/epoch={epoch_id}")
                out = select.drop_missing_article(every).select(*columns)
            else:
                every = None
                # the days as literals, so that a table laid out by day is read only where this batch reaches
                days = month_bounds(batch)
                near = views if days is None else views.where(F.col("day").between(*map(F.lit, days)))
                att = select.drop_missing_article(pageviews.attach_pageviews(ent, near))
                out = att.select("name", "article_title", "death_date", "description", "pageviews").withColumn("month", month_key("death_date"))
            # foreachBatch is at-least-once: a replayed epoch rewrites its own folder
            # (overwrite) instead of appending twice, so retries leave no duplicates.
            # A month's rows come together first, else every task writes a file for every month.
            out.hint("rebalance", "month").write.mode("overwrite").partitionBy("month").parquet(f"{out_dir}/entities/epoch={epoch_id}")
            rej.write.mode("overwrite").parquet(f"{out_dir}/rejects/epoch={epoch_id}")
            if every is not None:
                every.unpersist()
        finally:
            parsed.unpersist()

    q = (
        pages.writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
