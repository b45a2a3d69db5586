"""The month ledger, rule by rule."""

import datetime as dt

import pytest

from knowtrace.operators import ledger, pageviews
from knowtrace.session import work_path

MONTHS = {"January": ["==1==", "* [[Ann Example]], 40, Danish painter", "* [[Bo Example]], 41, Danish singer"], "February": ["==2==", "no entries"], "March": ["==3==", "* [[Cy Example]], 50, Danish singer"]}


@pytest.fixture()
def world(spark):
    pages = spark.createDataFrame([(m, f"Deaths in {m} 2024", 2024, k + 1, "\n".join(t)) for k, (m, t) in enumerate(MONTHS.items())], "page_id string, title string, year int, month int, text string")
    days = [("Ann_Example", dt.date(2024, 1, 3), 7), ("Bo_Example", dt.date(2024, 1, 3), 5), ("Cy_Example", dt.date(2024, 3, 4), 9)]
    views = pageviews.daily_views(spark.createDataFrame(days, "article string, day date, views long"))
    return pages, views, work_path(spark, "ledger-test")


def _names(spark, path, *span):
    return sorted(r.name.split()[0] for r in ledger.read_months(spark, path, *span).collect())


def _lines(spark, path):
    return sorted((r.month_key, r.rows) for r in ledger.committed(spark, path).collect())


def test_empty_months_are_done(spark, world):
    pages, views, path = world
    assert _names(spark, path) == [] and _lines(spark, path) == []
    assert ledger.collect_months(pages, views, path, "2024-01-01", "2024-02-29")
    assert _lines(spark, path) == [("2024-01", 2), ("2024-02", 0)]
    assert ledger.collect_months(pages, views, path, "2024-01-01", "2024-02-29") is None
    assert [r.month_key for r in ledger.pending(spark, path, "2024-01-01", "2024-04-30").orderBy("month_key").collect()] == ["2024-03", "2024-04"]


def test_a_later_run_adds_its_months_only(spark, world):
    pages, views, path = world
    first = ledger.collect_months(pages, views, path, "2024-01-01", "2024-01-31")
    second = ledger.collect_months(pages, views, path, "2024-01-01", "2024-03-31")
    assert _names(spark, path) == ["Ann", "Bo", "Cy"]
    assert {(r.month_key, r.run) for r in ledger.committed(spark, path).collect()} == {("2024-01", first), ("2024-02", second), ("2024-03", second)}


def test_months_are_whole_and_the_range_is_read(spark, world):
    pages, views, path = world
    ledger.collect_months(pages, views, path, "2024-01-20", "2024-03-02")
    assert _names(spark, path) == ["Ann", "Bo", "Cy"]
    assert _names(spark, path, "2024-01-20", "2024-03-02") == []
    assert _names(spark, path, None, "2024-01-31") == ["Ann", "Bo"]


def test_killed_between_rows_and_ledger(spark, world, monkeypatch):
    """The rows lie there, the months are not done: they are neither read nor doubled."""
    pages, views, path = world

    def killed(*args):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(ledger, "commit", killed)
        with pytest.raises(KeyboardInterrupt):
            ledger.collect_months(pages, views, path, "2024-01-01", "2024-03-31")
    assert spark.read.parquet(f"{path}/data").count() == 3
    assert _names(spark, path) == [] and _lines(spark, path) == []
    ledger.collect_months(pages, views, path, "2024-01-01", "2024-03-31")
    assert _names(spark, path) == ["Ann", "Bo", "Cy"]
    assert spark.read.parquet(f"{path}/data").count() == 6
    assert ledger.collect_months(pages, views, path, "2024-01-01", "2024-03-31") is None


def test_a_month_committed_twice_is_read_once(spark, world):
    """Two runs that did not see each other."""
    pages, views, path = world
    months = ledger.pending(spark, path, "2024-01-01", "2024-01-31")
    rows, _ = ledger.collect_entities(pages, views, dt.date(2024, 1, 1), dt.date(2024, 1, 31), months=months)
    for run in ("2-b", "1-a"):
        ledger.commit(spark.createDataFrame([("2024-01",)], "month_key string"), ledger.write_rows(rows, path, run), path, run)
    assert _names(spark, path) == ["Ann", "Bo"]
    assert [r.run for r in ledger.committed(spark, path).collect()] == ["1-a"]


def test_reading_prunes_by_the_ledger(spark, world):
    pages, views, path = world
    ledger.collect_months(pages, views, path, "2024-01-01", "2024-03-31")
    plan = ledger.read_months(spark, path, "2024-03-01", "2024-03-31")._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "FileScan parquet" in x and "death_date" in x)
    filters = scan.split("PartitionFilters: [")[1]
    assert "(month#" in filters and ">= 2024-03)" in filters and "isnotnull(run" in filters, scan
