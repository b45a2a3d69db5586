"""Files with different headers, the order of rows in files, staged publishing, order on disk."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from knowtrace.operators import select
from knowtrace.session import work_path
from knowtrace.sources import csv_io, jsonl, publish


def _put(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
        f.write(text)


def _entities(spark, n=400, day0=dt.date(2024, 1, 1)):
    rows = [(f"n{i}", day0 + dt.timedelta(days=i * 7 % 61), "d", (i * 37) % 101) for i in range(n)]
    return spark.createDataFrame(rows, "name string, death_date date, description string, pageviews long").repartition(4)


def test_headers_differ_in_one_folder(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "runs")
    _put(base, "a.csv", '"name","death_date","pageviews","llm_knows_death"\n"Ann","2024-01-05","7","True"\n')
    _put(base, "b.csv", '"llm_knows_death","extra","name","death_date"\n"False","x","Bo, ""B""\nC","2024-1-6"\n"","y","Cy","2024-01-07"\n')
    _put(base, "c.csv", "")
    _put(base, "d.csv", '"name","death_date","pageviews","llm_knows_death"\n')
    want = {("Ann", dt.date(2024, 1, 5), 7, True, "a.csv"), ('Bo, "B"\nC', dt.date(2024, 1, 6), 0, False, "b.csv"), ("Cy", dt.date(2024, 1, 7), 0, None, "b.csv")}
    for opened in (512, 0):  # by opening the files, and by a scan
        monkeypatch.setattr(csv_io, "OPENED_FILES", opened)
        got = csv_io.read_results(spark, base).select("name", "death_date", "pageviews", "knows", "file_name")
        assert {tuple(r) for r in got.collect()} == want
        both = csv_io.read_results(spark, [f"{base}/a.csv", f"{base}/b.csv"]).select("name", "death_date", "pageviews", "knows", "file_name")
        assert {tuple(r) for r in both.collect()} == want
    assert csv_io.read_results(spark, f"{base}/b.csv").count() == 2


def test_headers_differ_between_run_partitions(spark, tmp_path):
    base = str(tmp_path / "runs")
    _put(f"{base}/run=one", "a.csv", '"name","death_date"\n"Ann","2024-01-05"\n')
    _put(f"{base}/run=two", "a.csv", '"death_date","name"\n"2024-01-06","Bo"\n')
    assert {(r.name, r.run) for r in csv_io.read_results(spark, base).collect()} == {("Ann", "one"), ("Bo", "two")}


def test_ties_keep_the_order_of_the_file(spark, tmp_path):
    names = [f"n{(i * 7919) % 997}" for i in range(60)]
    for k, part in enumerate((names[:35], names[35:])):
        _put(str(tmp_path), f"{'ab'[k]}.csv", '"name","death_date","description","pageviews"\n' + "".join(f'"{n}","2024-01-05","two\nlines","5"\n' for n in part))
    df = csv_io.read_entities(spark, str(tmp_path), order=True)
    got = select.top_n(df.repartition(7), "day", 50, ["file_order"]).orderBy("rank").collect()
    assert [r.name for r in got] == names[:50]


def test_empty_runs_keep_the_old_output(spark, tmp_path):
    df, none = _entities(spark, 9), _entities(spark, 9).where("pageviews < 0")
    results = lambda d: d.withColumn("knows", F.lit(True)).withColumn("response", F.lit("No"))
    sinks = {
        "entities": lambda d, p: csv_io.write_entities(d, p),
        "results": lambda d, p: csv_io.write_results(results(d), p),
        "requests": lambda d, p: jsonl.write_requests_jsonl(d.select(F.col("name").alias("payload")), p),
    }
    for name, write in sinks.items():
        for empty in (none, df.where(F.lit(False)), df.limit(0)):
            assert write(empty, f"{tmp_path}/{name}") is False and not os.path.exists(f"{tmp_path}/{name}")
        assert write(df, f"{tmp_path}/{name}") is True
        held = sorted(r.value for r in spark.read.text(f"{tmp_path}/{name}").collect())
        for empty in (none, df.where(F.lit(False))):
            assert write(empty, f"{tmp_path}/{name}") is False
        assert sorted(r.value for r in spark.read.text(f"{tmp_path}/{name}").collect()) == held
    assert sorted(os.listdir(tmp_path)) == sorted(sinks)  # nothing staged is left


def test_rows_are_made_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    df = _entities(spark, 50)
    csv_io.write_results(df.withColumn("knows", F.lit(True)).withColumn("response", F.lit("")).mapInPandas(count, "name string, death_date date, description string, pageviews long, knows boolean, response string"), f"{tmp_path}/out")
    assert seen.value == 50


def test_a_killed_job_leaves_the_target(spark, tmp_path):
    path = f"{tmp_path}/out"
    assert csv_io.write_entities(_entities(spark, 9), path)
    bad = _entities(spark, 9).withColumn("description", F.when(F.col("name") == "n8", F.raise_error(F.lit("killed"))).otherwise(F.lit("new")))
    with pytest.raises(Exception, match="killed"):
        csv_io.write_entities(bad, path)
    assert {r.description for r in csv_io.read_entities(spark, path).collect()} == {"d"}
    assert csv_io.write_entities(_entities(spark, 5), path)  # and is replaced whole
    assert csv_io.read_entities(spark, path).count() == 5
    with pytest.raises(ValueError):
        publish.publish(_entities(spark, 5), path, lambda w, p: w.csv(p), "ignore")


def test_append_moves_files_in(spark, tmp_path):
    path = f"{tmp_path}/out"
    df = _entities(spark, 40).withColumn("month", F.date_format("death_date", "yyyy-MM"))
    for _ in range(2):
        assert csv_io.write_entities(df, path, mode="append", partition_by=["month"])
    assert csv_io.read_entities(spark, path).count() == 80
    assert {f for f in os.listdir(path) if f.startswith("month=")} == {"month=2024-01", "month=2024-02", "month=2024-03"}


@pytest.mark.parametrize("parts", [None, ["month"], ["kind"]])
def test_order_on_disk(spark, tmp_path, parts):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = _entities(spark).withColumn("month", F.date_format("death_date", "yyyy-MM")).withColumn("kind", F.col("pageviews") % 3)
        csv_io.write_entities(df, f"{tmp_path}/good", partition_by=parts)
        assert len(spark.read.text(f"{tmp_path}/good").inputFiles()) > 2
        assert csv_io.order_breaks(spark, f"{tmp_path}/good", parts).count() == 0
        # without the sort, and with the sort left to a writer that sorts by its partition columns alone
        shown = ["name", F.col("death_date").cast("string"), "description", F.col("pageviews").cast("string"), *(parts or [])]
        w = df.select(*shown).write.options(**csv_io.WRITE_OPTS)
        (w.partitionBy(*parts) if parts else w).csv(f"{tmp_path}/bad")
        assert {"rows"} <= {r.kind for r in csv_io.order_breaks(spark, f"{tmp_path}/bad", parts).collect()}
        # each file in order, but not the files
        if not parts:
            df.sortWithinPartitions("death_date", F.desc("pageviews")).select(*shown).write.options(**csv_io.WRITE_OPTS).csv(f"{tmp_path}/apart")
            assert {r.kind for r in csv_io.order_breaks(spark, f"{tmp_path}/apart").collect()} == {"files"}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
