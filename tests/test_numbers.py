"""Numeric goldens (FIXTURES section 5) and invariants."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from knowtrace.functions.core import py_fixed
from knowtrace.functions.labels import compact_number, model_title, py_title, run_label, views_subtitle
from knowtrace.operators import bins, metrics, pageviews, select, smoothing


def _results(spark, rows):
    return spark.createDataFrame(rows, "name string, death_date date, pageviews long, knows boolean")


def test_accuracy_null_when_nothing_known(spark):
    d = dt.date(2024, 1, 1)
    r = _results(spark, [("a", d, 1, None), ("b", d, 2, None)])
    row = metrics.accuracy_by(r, "day").first()
    assert row.accuracy is None and row.unknown == row.total == 2


def test_accuracy_invariant(spark):
    rnd = random.Random(1)
    rows = [(str(i), dt.date(2024, 1, 1) + dt.timedelta(days=rnd.randint(0, 90)), rnd.randint(0, 10**6),
             rnd.choice([True, False, None])) for i in range(2000)]
    m = metrics.accuracy_by(_results(spark, rows), "month").collect()
    assert all(r.correct + r.incorrect + r.unknown == r.total for r in m)
    assert sum(r.total for r in m) == 2000


def _series(spark, values):
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "day date, accuracy double")


@pytest.mark.parametrize("n,width", [(7, None), (8, 2), (9, 3), (20, 6), (21, 7)])
def test_valid_moving_average_width(spark, n, width):
    vals = [float(i * 3 % 11) for i in range(n)]
    out = smoothing.moving_average_valid(_series(spark, vals)).orderBy("day").collect()
    if width is None:
        assert all(r.moving_avg is None for r in out)
        return
    assert {r.window for r in out} == {width}
    for i, r in enumerate(out):
        if i < width - 1:
            assert r.moving_avg is None
        else:
            assert r.moving_avg == pytest.approx(sum(vals[i - width + 1 : i + 1]) / width)


def test_trailing_moving_average(spark):
    df = spark.createDataFrame([("2024-01", 90.0), ("2024-02", 60.0), ("2024-03", 30.0), ("2024-04", 0.0)], "month string, accuracy double")
    got = [r.moving_avg for r in smoothing.moving_average_trailing(df).orderBy("month").collect()]
    assert got == [90.0, 75.0, 60.0, 30.0]


def test_log_bins_goldens(spark):
    d = dt.date(2024, 1, 1)
    r = _results(spark, [("a", d, 1, True), ("b", d, 10, False), ("c", d, 100, True)])
    got = [(x.bin, x.total) for x in bins.accuracy_by_log_bins(r, 2).orderBy("bin").collect()]
    assert got == [(0, 1), (1, 2)]
    same = _results(spark, [("a", d, 5, True), ("b", d, 5, False)])
    one = bins.accuracy_by_log_bins(same, 10).collect()
    assert len(one) == 1 and one[0].total == 2 and one[0].low == one[0].high == 5.0


def test_log_bins_conserve_rows(spark):
    rnd = random.Random(3)
    d = dt.date(2024, 1, 1)
    rows = [(str(i), d, rnd.randint(1, 10**7), rnd.choice([True, False])) for i in range(3000)]
    got = bins.accuracy_by_log_bins(_results(spark, rows), 10).collect()
    assert sum(r.total for r in got) == 3000


def test_median_and_stats(spark):
    d = dt.date(2024, 1, 1)
    r = _results(spark, [("a", d, 1, True), ("b", d, 2, True), ("c", d, 4, True), ("d", d, 9, True)])
    s = metrics.pageview_stats(r).where("knows").first()
    none = metrics.pageview_stats(r).where("NOT knows").first()
    assert (none.min_views, none.max_views, none.mean_views, none.median_views, none["count"]) == (0, 0, 0.0, 0.0, 0)
    assert (s.min_views, s.max_views, s.median_views, s["count"]) == (1, 9, 3.0, 4)
    assert s.mean_views == 4.0


def test_compact_numbers_and_python_rounding(spark):
    vals = [500000, 1500000, 2000000, 999, 999500, 1150000, 1250000, 1350000, 2500]
    df = spark.createDataFrame([(v,) for v in vals], "v long")
    got = [r.c for r in df.select(compact_number("v").alias("c")).collect()]

    assert got == [
        "500 thousand", "1.5 million", "2 million", "999", "1000 thousand", "1.1 million", "1.2 million", "1.4 million", "2 thousand",
    ]
    rnd = random.Random(5)
    xs = [rnd.random() * 10 ** rnd.randint(0, 6) for _ in range(500)] + [0.25, 0.35, 2.5, 3.5, 1.15, 12.45]
    fx = spark.createDataFrame([(x,) for x in xs], "x double")
    out = [r.s for r in fx.select(py_fixed("x", 1).alias("s")).collect()]
    assert out == [f"{x:.1f}" for x in xs]


def test_titles_and_labels(spark):
    df = spark.createDataFrame([("o3mini high",), ("gemini 3 pro",)], "s string")
    assert [r.t for r in df.select(py_title("s").alias("t")).collect()] == ["O3Mini High", "Gemini 3 Pro"]
    lab = spark.range(1).select(
        run_label(F.lit("gpt-4.7"), F.lit("2021-03-02"), F.lit("2022-07-08"), top_per_month=F.lit(40), min_views=F.lit(700000)).alias("l")
    ).first().l
    assert lab == "gpt-4.7_2021-03-02_to_2022-07-08_topmonth-40_minviews-700000.csv"
    lab2 = spark.range(1).select(run_label(F.lit("a/b:c"), None, F.lit("2025-01-01"), top_per_day=F.lit(0)).alias("l")).first().l
    assert lab2 == "a-b-c_until_2025-01-01_topday-all_minviews-none.csv"
    t = spark.createDataFrame([(lab,)], "f string").select(model_title("f").alias("m"), views_subtitle("f").alias("s")).first()
    assert (t.m, t.s) == ("GPT 4.7", "All deaths with minimum 700 thousand views")


def test_sixty_day_window(spark):
    d = dt.date(2024, 3, 10)
    ent = spark.createDataFrame([("A B", d)], "article_title string, death_date date")
    rows = [("A_B", d - dt.timedelta(days=2), 1), ("A_B", d - dt.timedelta(days=1), 10),
            ("A_B", d + dt.timedelta(days=58), 100), ("A_B", d + dt.timedelta(days=59), 1000)]
    views = pageviews.daily_views(spark.createDataFrame(rows, "article string, day date, views long"))
    assert pageviews.attach_pageviews(ent, views).first().pageviews == 110
    missing = spark.createDataFrame([("Nobody", d)], "article_title string, death_date date")
    assert pageviews.attach_pageviews(missing, views).first().pageviews is None


def test_top_n_rules(spark):
    d = dt.date(2024, 1, 1)
    r = _results(spark, [(str(i), d, i % 5, True) for i in range(20)]).withColumn("k", F.col("name").cast("int"))
    out = select.top_n(r, "day", 3, tie=["k"]).collect()
    assert len(out) == 3 and sorted(x.pageviews for x in out) == [4, 4, 4]
    with pytest.raises(ValueError):
        select.select_top(r, tie=["k"], top_per_day=1, top_per_month=1)
    assert select.min_views(r, 0).count() == 20


def test_exact_median_random(spark):
    import statistics

    rnd = random.Random(9)
    rows = []
    for g in range(4):
        n = rnd.randint(1, 400)
        rows += [(g, rnd.choice([rnd.randint(0, 50), rnd.randint(0, 10**6)])) for _ in range(n)]
    rows += [(9, 7)] * 300  # a hot value
    df = spark.createDataFrame(rows, "g int, v long").repartition(7)
    got = {r.g: r.median for r in metrics.exact_median(df, "g", "v").collect()}
    for g in {r[0] for r in rows}:
        assert got[g] == float(statistics.median([v for gg, v in rows if gg == g]))


def test_arithmetic_bin_equals_edge_comparison(spark):
    rnd = random.Random(4)
    d = dt.date(2024, 1, 1)
    for mode in ("clamped", "float"):
        for trial in range(6):
            if trial == 0:
                vals = [7] * 5
            elif trial == 1:
                vals = [1, 10, 100, 1000]
            else:
                vals = [rnd.randint(1, 10 ** rnd.randint(1, 9)) for _ in range(rnd.randint(1, 300))]
            df = _results(spark, [(str(i), d, v, True) for i, v in enumerate(vals)])
            binned, edges = bins.with_log_bin(df, 10, "pageviews", mode)
            v = F.col("pageviews").cast("double")
            last = F.size(F.filter(edges, lambda e: e <= v)) - 1
            ref = F.when(last < 0, F.lit(None)).when(last < 10, last).when(v == F.get(edges, F.lit(10)), F.lit(9))
            rows = binned.select("bin", ref.cast("int").alias("ref")).collect()
            assert all(r.bin == r.ref for r in rows), (mode, trial)


def test_pystrip_matches_python(spark):
    from knowtrace.functions.core import pystrip

    rnd = random.Random(8)
    alphabet = [" ", "\t", "\n", "\r", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", " ", "　", "a", "é", "x", "​"]
    texts = ["".join(rnd.choices(alphabet, k=rnd.randint(0, 12))) for _ in range(2000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.s for r in df.select(pystrip("t").alias("s")).collect()] == [t.strip() for t in texts]


def test_word_count_matches_python(spark):
    from knowtrace.functions.core import is_one_word, word_count

    rnd = random.Random(12)
    alphabet = [" ", "\t", "\x1c", "\x1f", "\xa0", "　", "a", "b", "é", "-", "​"]
    texts = ["".join(rnd.choices(alphabet, k=rnd.randint(0, 10))) for _ in range(2000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(word_count("t").alias("n"), is_one_word("t").alias("one")).collect()
    assert [r.n for r in rows] == [len(t.split()) for t in texts]
    assert [r.one for r in rows] == [len(t.split()) == 1 for t in texts]
