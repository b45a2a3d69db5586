"""The 60-day view join never sends a side through the driver: spans grow out of a small file, unseen by the planner."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from knowtrace.operators import pageviews, select
from knowtrace.session import work_path


@pytest.fixture(scope="module")
def attached(spark):
    """2,000 entities and their views, read from files so small that the planner would broadcast them."""
    base = work_path(spark, "pageviews-plan")
    day = F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") % 300).cast("int"))
    spark.range(2000).select(F.concat(F.lit("A "), F.col("id").cast("string")).alias("article_title"), day.alias("death_date")).write.parquet(f"{base}/entities")
    shift = F.explode(F.array(*map(F.lit, (-2, -1, 0, 30, 58, 59))))
    views = spark.range(1500).select("id", day.alias("date"), shift.alias("shift"))
    views.select(F.concat(F.lit("A_"), F.col("id").cast("string")).alias("article"), F.date_add("date", F.col("shift")).alias("day"), F.lit(1).alias("views")).write.parquet(f"{base}/views")
    return pageviews.attach_pageviews(spark.read.parquet(f"{base}/entities"), pageviews.daily_views(spark.read.parquet(f"{base}/views")))


def test_nothing_is_planned_as_a_broadcast(attached):
    for df in (attached, select.drop_missing_article(attached)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan, plan


def test_totals_at_the_edges_of_windows(attached):
    assert sorted(map(tuple, attached.groupBy("pageviews").count().collect()), key=str) == [(4, 1500), (None, 500)]


@pytest.mark.parametrize("width", [None, 1, 7, 59, 60, 61, 400])
def test_the_width_of_buckets_changes_no_total(spark, width):
    keys = spark.createDataFrame([("A", dt.date(2024, 1, 1) + dt.timedelta(days=k)) for k in range(130)], "article string, date date")
    days = spark.sql("SELECT 'A' AS article, explode(sequence(DATE'2023-10-01', DATE'2024-09-30')) AS day, 1L AS views")
    totals = pageviews.window_totals(keys, days, bucket_days=width)
    assert [tuple(r) for r in totals.groupBy("total").count().collect()] == [(60, 130)]
