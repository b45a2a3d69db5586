"""What the streams and the ledger read and write: views by day, late files by many tasks, pages rendered once."""

import datetime as dt
import glob

from pyspark.sql import functions as F

from knowtrace.operators import pageviews
from knowtrace.plans import q_io, q_stream
from knowtrace.session import work_path
from knowtrace.streaming import ingest

PAGE = "==1==\n* [[Person 1]], 40, Danish painter\n* [[Person 2]], 50, Danish singer"


def _pages(spark):
    rows = [("p1", "Deaths in January 1996", 1996, 1, PAGE)]
    return spark.createDataFrame(rows, "page_id string, title string, year int, month int, text string")


def test_a_micro_batch_reads_its_days_of_a_table(spark, monkeypatch):
    base, seen, attach = work_path(spark, "days-of-a-table"), [], pageviews.attach_pageviews
    _pages(spark).write.parquet(f"{base}/in")
    days = [("Person_1", dt.date(1995, 12, 31), 3), ("Person_1", dt.date(1996, 3, 1), 50), ("Person_2", dt.date(2000, 1, 1), 7)]
    spark.createDataFrame(days, "article string, day date, views long").write.parquet(f"{base}/views")

    def spy(ent, views):
        seen.append(views._jdf.queryExecution().executedPlan().toString())
        return attach(ent, views)

    monkeypatch.setattr(ingest.pageviews, "attach_pageviews", spy)
    ingest.stream_ingest(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", spark.read.parquet(f"{base}/views"))
    pushed = seen[0].split("PushedFilters: [")[1]
    assert "1995-12-31" in pushed and "1996-03-29" in pushed, seen[0]
    assert [(r.name, r.pageviews) for r in spark.read.parquet(f"{base}/out/entities").collect()] == [("Person 1", 3)]


def _lines(spark):
    rows = [(k % 2 + 1, k % 4 + 1, dt.datetime(1996, 1, 1 + k % 20), 1.0) for k in range(80)]
    return spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_shipdate timestamp, l_quantity double").repartition(4)


def test_late_lines_are_written_by_many_tasks(spark, monkeypatch):
    base = work_path(spark, "late-lines")
    monkeypatch.setattr(q_stream, "work_path", lambda *_: base)
    monkeypatch.setattr(q_stream, "render_pages", lambda *_: _pages(spark))
    monkeypatch.setattr(q_stream.B, "table", lambda *_: _lines(spark))
    assert sorted((r.name, r.pageviews) for r in q_stream.late_views(spark, "").collect()) == [("Person 1", 40), ("Person 2", 40)]
    assert len(glob.glob(f"{base}/late/*.parquet")) > 1


def test_the_ledger_renders_pages_once(spark, monkeypatch):
    plans, collect = [], q_io.ledger.collect_months

    def spy(pages, *args, **kw):
        plans.append(pages._jdf.queryExecution().executedPlan().toString())
        return collect(pages, *args, **kw)

    views = _lines(spark).select(F.concat(F.lit("Person_"), F.col("l_orderkey").cast("string")).alias("article"), F.to_date("l_shipdate").alias("day"), F.col("l_quantity").alias("views"))
    monkeypatch.setattr(q_io.ledger, "collect_months", spy)
    monkeypatch.setattr(q_io, "render_pages", lambda *_: _pages(spark).repartition(3))
    monkeypatch.setattr(q_io.B, "person_views", lambda *_: pageviews.daily_views(views))
    got = {r.month_key: (r.rows, r.views) for r in q_io.month_ledger(spark, "").collect()}
    assert len(plans) == 2 and not any("Exchange" in x for x in plans), plans
    assert all(x == (0, 0) for m, x in got.items() if m != "1996-01") and got.get("1996-01", (2, 80)) == (2, 80)
