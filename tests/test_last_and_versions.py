"""Last write wins and retries without sorting; versions of a streamed table; the inline count warning."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from knowtrace.operators import metrics
from knowtrace.operators import responses as S
from knowtrace.session import work_path
from knowtrace.sources import jsonl
from knowtrace.streaming import accuracy


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_last_write_wins_by_hash(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", "c", None, "hot"]) if i % 3 else "hot", f"t{rng.randrange(5)}", None if i % 11 == 0 else rng.randrange(-5, 40)) for i in range(300)]
    df = spark.createDataFrame(rows, "request_id string, text string, seq long").repartition(5)
    out = S.dedupe_last(df)
    got = {r.request_id: (r.text, r.seq) for r in out.collect()}
    assert out.columns == ["request_id", "text", "seq"] and out.count() == len(got) == 5
    for key, (text, seq) in got.items():
        held = [(s, t) for k, t, s in rows if k == key]
        best = max((s for s, _ in held if s is not None), default=None)
        assert seq == best and (best, text) in held
    assert {r.request_id: (r.text, r.seq) for r in S.dedupe_last(df.repartition(2)).collect()} == got  # ties do not depend on the deal
    plan = _plan(out)
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_equal_rows_and_extremes(spark):
    rows = [("a", "x", 5), ("a", "x", 5), ("b", "y", -(2**63)), ("b", "z", 2**63 - 1), ("c", "n", None), ("d", None, 0), ("d", "q", 0)]
    got = sorted((r.request_id, r.seq) for r in S.dedupe_last(spark.createDataFrame(rows, "request_id string, text string, seq long")).collect())
    assert got == [("a", 5), ("b", 2**63 - 1), ("c", None), ("d", 0)]


def test_lines_of_files_in_order(spark, tmp_path):
    for k in range(3):
        with open(tmp_path / f"{k}.jsonl", "w") as f:
            for i in range(40):
                f.write('{"key":"request-%d","response":{"candidates":[{"content":{"parts":[{"text":"%d-%d"}]}}]}}\n' % (i % 7, k, i))
    out = S.dedupe_last(jsonl.read_responses_jsonl(spark, str(tmp_path)))
    assert {r.request_id: r.text for r in out.collect()} == {str(i % 7): f"2-{i}" for i in range(33, 40)}
    assert "SortAggregate" not in _plan(out)


def test_terminal_attempts_by_hash(spark):
    rows = [("a", 0, 200, "", "length"), ("a", 1, 400, "No", "stop"), ("a", 2, 800, "Yes", "stop"), ("b", 0, 200, "", "length"), ("b", 1, 400, None, "length"), ("c", 0, 800, "", "length"), (None, 0, 200, " ", "stop")]
    out = S.resolve_attempts(spark.createDataFrame(rows, "request_id string, attempt int, limit int, text string, finish string"))
    assert {r.request_id: (r.attempt, r.text, r.attempts) for r in out.collect()} == {"a": (1, "No", 3), "b": (1, None, 2), "c": (0, "", 1), None: (0, " ", 1)}
    assert "SortAggregate" not in _plan(out)


def test_inline_count_warning_and_errors(spark):
    req = spark.range(3).selectExpr("id AS position", "CAST(id AS STRING) AS request_id")
    inline = spark.createDataFrame([(0, True, " No ", None), (1, False, None, "quota"), (2, False, None, None), (3, True, None, None)], "position long, has_response boolean, text string, error string")
    with pytest.warns(UserWarning, match="4 inline responses to 3 requests"):
        assert S.warn_on_mismatch(req, inline)
    got = S.join_responses(req, S.score(S.responses_by_position(inline))).orderBy("position").collect()
    assert [(r.knows, r.response) for r in got] == [(True, "No"), (None, "Error: quota"), (None, "Error: No response")]
    assert not S.warn_on_mismatch(req, inline.limit(3))


def test_versions_of_the_running_table(spark):
    base = work_path(spark, "versions")
    out = f"{base}/out"
    rows = [(str(i), dt.date(2024, 1 + i % 5, 1 + i % 27), i, [True, False, None][i % 3]) for i in range(200)]
    df = spark.createDataFrame(rows, "name string, death_date date, pageviews long, knows boolean")
    by_month = lambda d: sorted(map(tuple, metrics.accuracy_by(d, "month").collect()))
    read = lambda: sorted(map(tuple, accuracy.read_current(spark, out).collect()))
    assert read() == []
    first, second = df.where("pageviews < 90"), df.where("pageviews >= 90 AND month(death_date) = 2")
    assert accuracy.merge_version(spark, metrics.accuracy_by(first, "month"), out, 0) and read() == by_month(first)
    held = accuracy.read_current(spark, out)  # a reader of version 0
    both = first.unionByName(second)
    changed = metrics.accuracy_by(both, "month").where("month = '2024-02'")
    assert accuracy.merge_version(spark, changed, out, 1)
    assert read() == by_month(both) and sorted(map(tuple, held.collect())) == by_month(first)
    assert not accuracy.merge_version(spark, metrics.accuracy_by(first, "month"), out, 1)  # replayed
    assert read() == by_month(both)
    # killed after the folder, before the pointer: readers keep version 1; the replay brings version 2
    metrics.accuracy_by(first, "month").limit(1).write.parquet(f"{out}/version=2")
    assert read() == by_month(both)
    assert accuracy.merge_version(spark, metrics.accuracy_by(df, "month"), out, 2) and read() == by_month(df)
    assert sorted(f for f in os.listdir(out.replace("file:", "")) if not f.startswith(".")) == ["_CURRENT", "version=1", "version=2"]


def test_each_batch_publishes_what_changed(spark, monkeypatch):
    base = work_path(spark, "versions-stream")
    rows = [(str(i), dt.date(2024, 1 + i % 4, 1), i, True) for i in range(8)]
    df = spark.createDataFrame(rows, "name string, death_date date, pageviews long, knows boolean")
    sizes, merge = [], accuracy.merge_version
    monkeypatch.setattr(accuracy, "merge_version", lambda s, c, o, e: sizes.append(c.count()) or merge(s, c, o, e))
    for months in ("1, 2, 3, 4", "2"):
        df.where(f"month(death_date) IN ({months})").coalesce(1).write.mode("append").parquet(f"{base}/in")
        accuracy.stream_accuracy(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint")
    assert [n for n in sizes if n] == [4, 1]
    want = df.unionByName(df.where(F.month("death_date") == 2))
    assert sorted(map(tuple, accuracy.read_current(spark, f"{base}/out").collect())) == sorted(map(tuple, metrics.accuracy_by(want, "month").collect()))
