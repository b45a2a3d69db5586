"""CSV wire format, resume rule and the two streaming jobs."""

import datetime as dt

from pyspark.sql import functions as F

from knowtrace.operators import ingest, metrics, pageviews
from knowtrace.session import work_path
from knowtrace.sources import csv_io
from knowtrace.streaming.accuracy import stream_accuracy
from knowtrace.streaming.ingest import stream_ingest


def _results(spark):
    rows = [
        ("Ann, Example", dt.date(2024, 1, 5), 'singer "A"\nline two', 10, True, "No"),
        ("Bo", dt.date(2024, 1, 6), " padded ", 0, False, "Yes"),
        ("Cy", dt.date(2024, 2, 1), "", 5, None, ""),
    ]
    return spark.createDataFrame(
        rows, "name string, death_date date, description string, pageviews long, knows boolean, response string"
    )


def test_results_csv_round_trip(spark):
    path = work_path(spark, "test_csv")
    csv_io.write_results(_results(spark), path)
    raw = spark.read.text(path).collect()
    assert raw[0].value == '"name","death_date","description","pageviews","llm_knows_death","llm_response"'
    back = {r.name: r for r in csv_io.read_results(spark, path).collect()}
    assert back["Ann, Example"].description == 'singer "A"\nline two'
    assert back["Bo"].description == " padded "  # whitespace kept
    assert (back["Ann, Example"].knows, back["Bo"].knows, back["Cy"].knows) == (True, False, None)
    assert back["Cy"].pageviews == 5


def test_results_missing_and_extra_columns(spark):
    empty = csv_io.read_results(spark, work_path(spark, "none") + "/nothing.csv", missing_ok=True)
    assert empty.count() == 0
    try:
        csv_io.write_results(_results(spark).withColumn("extra", F.lit(1)), work_path(spark, "x"))
    except ValueError as e:
        assert "extra" in str(e)
    else:
        raise AssertionError("extra column must be rejected")
    assert csv_io.versioned_path("deaths_data.csv", "1.0") == "deaths_data_v1.0.csv"


def test_pending_months_rule(spark):
    existing = spark.createDataFrame([(dt.date(2024, 2, 3),)], "death_date date")
    todo = ingest.pending_months(spark, "2024-01-15", "2024-03-31", existing)
    assert [r.month_key for r in todo.orderBy("month_start").collect()] == ["2024-01", "2024-03"]


def test_stream_accuracy_equals_batch(spark):
    base = work_path(spark, "test_stream_acc")
    rows = [(str(i), dt.date(2024, 1 + i % 5, 1 + i % 27), i, [True, False, None][i % 3]) for i in range(500)]
    df = spark.createDataFrame(rows, "name string, death_date date, pageviews long, knows boolean")
    df.repartition(5).write.parquet(f"{base}/in")
    stream_accuracy(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", max_files_per_trigger=2)
    got = sorted(tuple(r) for r in spark.read.parquet(f"{base}/out").select("month", "correct", "incorrect", "unknown", "total").collect())
    want = sorted(tuple(r) for r in metrics.accuracy_by(df, "month").select("month", "correct", "incorrect", "unknown", "total").collect())
    assert got == want


def test_stream_ingest_incremental(spark):
    base = work_path(spark, "test_stream_ingest")
    page = "==1==\n* [[Ann Example]], 40, Danish painter\n* [[Bo Example]], 50, Danish singer"
    pages = spark.createDataFrame(
        [("p1", "Deaths in January 2024", 2024, 1, page)], "page_id string, title string, year int, month int, text string"
    )
    views = pageviews.daily_views(
        spark.createDataFrame(
            [("Ann_Example", dt.date(2024, 1, 3), 7), ("Bo_Example", dt.date(2024, 2, 3), 9)],
            "article string, day date, views long",
        )
    )
    pages.write.mode("append").parquet(f"{base}/in")
    stream_ingest(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", views)
    first = spark.read.parquet(f"{base}/out/entities").count()
    stream_ingest(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", views)  # nothing new
    assert spark.read.parquet(f"{base}/out/entities").count() == first == 2
    pages.withColumn("page_id", F.lit("p2")).write.mode("append").parquet(f"{base}/in")
    stream_ingest(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", views)
    assert spark.read.parquet(f"{base}/out/entities").count() == 4


def test_empty_write_leaves_nothing(spark):
    import os

    path = work_path(spark, "empty_out") + "/deaths.csv"
    empty = _results(spark).where(F.lit(False))
    assert csv_io.write_results(empty, path) is False
    assert not os.path.exists(path.replace("file:", ""))


def test_empty_rerun_keeps_the_earlier_output(spark):
    path = work_path(spark, "rerun") + "/deaths.csv"
    assert csv_io.write_results(_results(spark), path) is True
    n = csv_io.read_results(spark, path).count()
    assert csv_io.write_results(_results(spark).where(F.lit(False)), path) is False
    assert csv_io.read_results(spark, path).count() == n > 0


def test_columns_are_read_by_name(spark):
    base = work_path(spark, "by_name")
    df = spark.createDataFrame([("2024-01-05", "Ann", "x", "singer")], "death_date string, name string, extra string, description string")
    df.write.options(header=True, quoteAll=True).csv(f"{base}/a")
    r = csv_io.read_entities(spark, f"{base}/a").first()
    assert (r.name, r.death_date, r.description, r.pageviews) == ("Ann", dt.date(2024, 1, 5), "singer", 0)
    csv_io.write_results(_results(spark), f"{base}/b")
    assert csv_io.read_entities(spark, f"{base}/b").count() == _results(spark).count()
    both = csv_io.read_entities(spark, [f"{base}/a", f"{base}/b"])
    assert both.count() == _results(spark).count() + 1 and both.where("name = 'Ann' AND description = 'singer'").count() == 1


def test_run_labels_come_back_and_prune(spark):
    path = work_path(spark, "labels")
    for label in ("my model_topday-all", "50%_x", "007"):
        csv_io.write_results(_results(spark), path, run=label, mode="append")
    back = csv_io.read_results(spark, path)
    assert {r.run for r in back.select("run").distinct().collect()} == {"my model_topday-all", "50%_x", "007"}
    plan = back.where("run = '50%_x'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run" in plan


def test_work_tables_can_be_cleared(spark, tmp_path):
    import os

    from knowtrace import session

    kept = session.work_path(spark, "cleared")
    _results(spark).write.parquet(kept)
    own = kept.split("/cleared/")[0].replace("file:", "")
    assert os.path.isdir(own)
    other = own + "-other"
    os.makedirs(other)
    session.clear_work(spark)
    assert not os.path.exists(own) and os.path.isdir(other)
    os.rmdir(other)


def _month(spark, name, year, month, lines):
    return spark.createDataFrame([(name, f"Deaths in {name}", year, month, "\n".join(lines))], "page_id string, title string, year int, month int, text string")


def test_append_months_on_its_own_output(spark):
    path = work_path(spark, "append") + "/deaths.csv"
    pages = _month(spark, "January 2024", 2024, 1, ["==1==", "* [[Ann Example]], 40, Danish painter", "* [[Bo Example]], 41, singer"])
    pages = pages.unionByName(_month(spark, "February 2024", 2024, 2, ["==3==", "* [[Cy Example]], 50, Danish singer"]))
    days = [("Ann_Example", dt.date(2024, 1, 3), 7), ("Bo_Example", dt.date(2024, 1, 3), 5), ("Cy_Example", dt.date(2024, 2, 4), 9)]
    views = pageviews.daily_views(spark.createDataFrame(days, "article string, day date, views long"))
    fixes = spark.createDataFrame([("January 2024", 3, "fix", "", "Danish singer")], "page_id string, line_no int, action string, name string, description string")
    assert ingest.append_months(pages, views, path, "2024-01-01", "2024-01-31", corrections=fixes)
    files = set(spark.read.format("binaryFile").load(path).select("path").toPandas()["path"])
    assert ingest.append_months(pages, views, path, "2024-01-01", "2024-02-29", corrections=fixes)
    assert not ingest.append_months(pages, views, path, "2024-01-01", "2024-02-29", corrections=fixes)
    got = sorted((r.name, r.pageviews) for r in csv_io.read_entities(spark, path).collect())
    assert got == [("Ann Example", 7), ("Bo Example", 5), ("Cy Example", 9)]  # the corrected row has its views
    assert files <= set(spark.read.format("binaryFile").load(path).select("path").toPandas()["path"])


def test_build_run(spark):
    from knowtrace.operators import requests as R

    rows = [("A", dt.date(2024, 1, 1), "x", 5), ("B", dt.date(2024, 1, 1), "x", 9), ("C", dt.date(2024, 1, 2), "x", 1), ("D", dt.date(2025, 1, 1), "x", 99)]
    df = spark.createDataFrame(rows, "name string, death_date date, description string, pageviews long")
    got = R.build_run(df, "claude-x", ["name"], "2024-01-01", "2024-12-31", top_per_day=1, min_views=2).orderBy("position").collect()
    assert [(r.name, r.request_id) for r in got] == [("B", "0")] and '"custom_id":"0"' in got[0].payload
    assert [r.name for r in R.build_run(df, "gpt-x", ["name"]).orderBy("position").collect()] == ["D", "B", "A", "C"]
