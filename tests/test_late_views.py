"""Streaming ingest over a store of views by day, and late views."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from knowtrace.operators import pageviews
from knowtrace.session import work_path
from knowtrace.streaming import views as V
from knowtrace.streaming.ingest import stream_ingest

D = dt.date
PAGE = "==1==\n* [[Ann Example]], 40, Danish painter\n* [[Bo Example]], 50, Danish singer\n* [[Cy Example]], 60, Danish actor"


def _views(spark, *rows):
    return pageviews.daily_views(spark.createDataFrame(rows, "article string, day date, views long"))


@pytest.fixture()
def world(spark):
    base = work_path(spark, "late-views")
    pages = spark.createDataFrame([("p1", "Deaths in January 2024", 2024, 1, PAGE)], "page_id string, title string, year int, month int, text string")
    pages.write.parquet(f"{base}/in")
    V.store_views(_views(spark, ("Ann_Example", D(2024, 1, 3), 7), ("Bo_Example", D(2023, 12, 31), 5), ("Bo_Example", D(2024, 2, 28), 2), ("Bo_Example", D(2024, 2, 29), 100)), f"{base}/store")
    stream_ingest(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", f"{base}/store")
    return base


def _late(spark, base, *rows):
    _views(spark, *rows).write.mode("append").parquet(f"{base}/late")
    V.stream_views(spark, f"{base}/late", f"{base}/store", f"{base}/out", f"{base}/ckpt-views")


def _got(spark, base):
    return {r.name.split()[0]: (r.pageviews, r.views_epoch) for r in V.read_ingested(spark, f"{base}/out").collect()}


def test_totals_of_the_first_run(spark, world):
    assert _got(spark, world) == {"Ann": (7, 0), "Bo": (7, 0)}  # both ends of the window, not the day after
    assert V.last_epoch(spark, f"{world}/store") == 0


def test_late_views_count_once(spark, world):
    _late(spark, world, ("Ann_Example", D(2024, 2, 28), 10), ("Ann_Example", D(2024, 2, 29), 1000), ("Cy Example", D(2024, 1, 1), 3))
    want = {"Ann": (17, 1), "Bo": (7, 0), "Cy": (3, 1)}  # Cy had no view before
    assert _got(spark, world) == want
    V.stream_views(spark, f"{world}/late", f"{world}/store", f"{world}/out", f"{world}/ckpt-views")  # nothing new
    assert _got(spark, world) == want
    _late(spark, world, ("Ann_Example", D(2023, 12, 31), 1), ("Bo_Example", D(2023, 12, 30), 50))
    assert _got(spark, world) == {**want, "Ann": (18, 2)}


def test_a_replayed_batch_changes_nothing(spark, world):
    _late(spark, world, ("Ann_Example", D(2024, 1, 5), 10))
    _late(spark, world, ("Ann_Example", D(2024, 1, 6), 20))
    want = _got(spark, world)
    assert want["Ann"] == (37, 2)
    # a checkpoint lost: both files come again, now as one batch, in the folder of the first
    V.stream_views(spark, f"{world}/late", f"{world}/store", f"{world}/out", f"{world}/ckpt-views-again", max_files_per_trigger=1)
    assert _got(spark, world)["Ann"][0] == 37


def test_an_entity_behind_is_caught_up(spark, world):
    """Views stored while an entity was under way: the next batch reopens its window as well."""
    V.store_views(_views(spark, ("Ann_Example", D(2024, 1, 5), 10)), f"{world}/store", 1)
    assert [r.article_title for r in V.reopened(spark, f"{world}/store", f"{world}/out", 1).collect()] == ["Ann Example"]
    V.store_views(_views(spark, ("Bo_Example", D(2024, 1, 5), 20)), f"{world}/store", 2)
    assert sorted(r.article_title for r in V.reopened(spark, f"{world}/store", f"{world}/out", 2).collect()) == ["Ann Example", "Bo Example"]
    assert V.reopened(spark, f"{world}/store", f"{world}/out", 0) is None


def test_a_micro_batch_reads_its_days(spark, world):
    ent = spark.createDataFrame([("Ann Example", D(2024, 1, 1))], "article_title string, death_date date")
    plan = V.totals(ent, f"{world}/store", 0)._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "FileScan" in x and "epoch#" in x)
    filters = scan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "(epoch#" in filters and "isnotnull(month#" in filters and "2023-12-31" in scan and "2024-02-28" in scan, scan
    read = V.totals(ent, f"{world}/store", 0)
    assert read.first().pageviews == 7
    # later epochs than asked for stay out
    V.store_views(_views(spark, ("Ann_Example", D(2024, 1, 5), 10)), f"{world}/store", 1)
    assert V.totals(ent, f"{world}/store", 0).first().pageviews == 7 and V.totals(ent, f"{world}/store", 1).first().pageviews == 17
    assert V.totals(ent.where(F.lit(False)), f"{world}/store", 1).count() == 0
