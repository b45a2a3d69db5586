"""Registered queries for the two streaming jobs (ST1, ST2).

Each writes its inputs (derived from the driver tables) into the shared
folder, runs the stream to completion with ``availableNow`` and returns the
published output, which must equal the batch computation.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from knowtrace.operators.pageviews import daily_views
from knowtrace.plans import bindings as B
from knowtrace.plans.catalog import register
from knowtrace.plans.oracle import MONTHLY, RESULTS, with_
from knowtrace.plans.q_wikitext import ENTITIES_SQL
from knowtrace.plans.render import SQL_SOURCES, render_pages
from knowtrace.session import cut_lineage, stored, work_path
from knowtrace.streaming import views as late
from knowtrace.streaming.accuracy import stream_accuracy as run_accuracy
from knowtrace.streaming.ingest import stream_ingest as run_ingest


@register("stream_accuracy", with_(RESULTS, MONTHLY) + "SELECT * FROM monthly")
def stream_accuracy(spark, sf_dir):
    """ST2: results land as eight files; the stream consumes two files
    per micro-batch and publishes the running table."""
    base = work_path(spark, "stream_accuracy")
    r = B.results(spark, sf_dir).select("name", "death_date", "pageviews", "knows")
    r.repartition(8).write.mode("overwrite").parquet(f"{base}/in")
    run_accuracy(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", max_files_per_trigger=2)
    return spark.read.parquet(f"{base}/out").select("month", "correct", "incorrect", "unknown", "total", "accuracy")


@register(
    "stream_ingest",
    with_(
        SQL_SOURCES,
        "ok AS (SELECT *, n2 AS c_name_sp FROM src WHERE shape IN (0, 1, 2, 3, 7))",
        f"ent AS ({ENTITIES_SQL.replace('FROM ok', ', okey FROM ok')})",
        """v AS (SELECT 'Person_' || CAST(l_orderkey AS VARCHAR) AS article, CAST(l_shipdate AS DATE) AS day,
         CAST(l_quantity AS BIGINT) AS views FROM lineitem)""",
    )
    + """SELECT e.name, e.death_date, e.description, CAST(sum(v.views) AS BIGINT) AS pageviews
FROM ent e JOIN v ON v.article = replace(e.article_title, ' ', '_')
  AND v.day BETWEEN e.death_date - 1 AND e.death_date + 58
GROUP BY e.okey, e.name, e.death_date, e.description""",
)
def stream_ingest(spark, sf_dir):
    """ST1: page files arrive in two drops (up to 1997, then the rest); each run
    of the stream picks up only the files it has not seen."""
    base = work_path(spark, "stream_ingest")
    pages = cut_lineage(render_pages(spark, sf_dir))  # rendered once, split into two drops
    # views and page files lie in order of time, so a micro-batch reads the views around its months and not all
    views = stored(B.person_views(spark, sf_dir).repartitionByRange("day").sortWithinPartitions("day"), "stream_ingest_views")
    early = pages.where(F.col("year") <= 1997).repartitionByRange("year", "month")
    late = pages.where(F.col("year") > 1997).repartitionByRange("year", "month")
    early.write.mode("append").parquet(f"{base}/in")
    run_ingest(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", views, max_files_per_trigger=4)
    late.write.mode("append").parquet(f"{base}/in")
    run_ingest(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", views, max_files_per_trigger=4)
    out = spark.read.parquet(f"{base}/out/entities")
    return out.select("name", "death_date", "description", "pageviews")


@register(
    "late_views",
    with_(
        SQL_SOURCES,
        "ok AS (SELECT *, n2 AS c_name_sp FROM src WHERE shape IN (0, 1, 2, 3, 7))",
        f"ent AS ({ENTITIES_SQL.replace('FROM ok', ', okey FROM ok')})",
        """v AS (SELECT 'Person_' || CAST(l_orderkey AS VARCHAR) AS article, CAST(l_shipdate AS DATE) AS day,
         CAST(l_quantity AS BIGINT) AS views FROM lineitem)""",
    )
    + """SELECT e.name, e.death_date, e.description, CAST(sum(v.views) AS BIGINT) AS pageviews
FROM ent e JOIN v ON v.article = replace(e.article_title, ' ', '_')
  AND v.day BETWEEN e.death_date - 1 AND e.death_date + 58
GROUP BY e.okey, e.name, e.death_date, e.description""",
)
def late_views(spark, sf_dir):
    """ST1 over a store of views by epoch and month: odd order lines are there first, the others come late."""
    base = work_path(spark, "late_views")
    store, out = f"{base}/store", f"{base}/out"
    lines = B.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("Person_"), F.col("l_orderkey").cast("string")).alias("article"), F.to_date("l_shipdate").alias("day"), F.col("l_quantity").cast("bigint").alias("views"), "l_linenumber")
    odd = F.col("l_linenumber") % 2 == 1
    late.store_views(daily_views(lines.where(odd)), store)
    render_pages(spark, sf_dir).write.parquet(f"{base}/in")
    run_ingest(spark, f"{base}/in", out, f"{base}/checkpoint", store)
    daily_views(lines.where(~odd)).write.parquet(f"{base}/late")
    late.stream_views(spark, f"{base}/late", store, out, f"{base}/late-checkpoint")
    return late.read_ingested(spark, out).select("name", "death_date", "description", "pageviews")
