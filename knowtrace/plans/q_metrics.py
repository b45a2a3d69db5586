"""Registered queries: aggregates, filters, bins and the 60-day view join."""

from __future__ import annotations

from pyspark.sql import functions as F

from knowtrace.operators import bins, metrics, pageviews, report, select
from knowtrace.plans import bindings as B
from knowtrace.plans.catalog import register
from knowtrace.plans.oracle import DAILY, MONTHLY, RESULTS, with_

DATE_START, DATE_END = "1996-01-01", "1998-12-31"
MIN_VIEWS = 250_000
MIN_KNOWN = 120

VIEWS_CTE = """e AS (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS article, CAST(o_orderdate AS DATE) AS d FROM orders),
v AS (SELECT CAST(l_orderkey AS VARCHAR) AS article, CAST(l_shipdate AS DATE) AS day,
             CAST(l_quantity AS BIGINT) AS views FROM lineitem),
attached AS (
  SELECT e.o_orderkey, e.article, e.d,
         CAST(sum(v.views) AS BIGINT) AS pageviews
  FROM e LEFT JOIN v ON v.article = e.article AND v.day BETWEEN e.d - 1 AND e.d + 58
  GROUP BY e.o_orderkey, e.article, e.d)"""


@register("accuracy_by_month", with_(RESULTS, MONTHLY) + "SELECT * FROM monthly")
def accuracy_by_month(spark, sf_dir):
    return metrics.accuracy_by(B.results(spark, sf_dir), "month")


@register("accuracy_by_day", with_(RESULTS, DAILY) + "SELECT * FROM daily")
def accuracy_by_day(spark, sf_dir):
    return metrics.accuracy_by(B.results(spark, sf_dir), "day")


@register(
    "overall_summary",
    with_(RESULTS)
    + """SELECT count(*) AS total,
  count(*) FILTER (WHERE knows) AS correct,
  count(*) FILTER (WHERE NOT knows) AS incorrect,
  count(*) FILTER (WHERE knows IS NULL) AS unknown,
  CAST(count(*) FILTER (WHERE knows) AS DOUBLE) / count(*) * 100 AS pct_correct,
  CAST(count(*) FILTER (WHERE NOT knows) AS DOUBLE) / count(*) * 100 AS pct_incorrect,
  CAST(count(*) FILTER (WHERE knows IS NULL) AS DOUBLE) / count(*) * 100 AS pct_unknown
FROM results""",
)
def overall_summary(spark, sf_dir):
    return metrics.overall_summary(B.results(spark, sf_dir))


@register(
    "pageview_stats",
    with_(RESULTS)
    + """SELECT knows, min(pageviews) AS min_views, max(pageviews) AS max_views,
  round(avg(pageviews), 6) AS mean_views, CAST(median(pageviews) AS DOUBLE) AS median_views,
  count(*) AS count
FROM results WHERE knows IS NOT NULL GROUP BY knows""",
)
def pageview_stats(spark, sf_dir):
    st = metrics.pageview_stats(B.results(spark, sf_dir))
    return st.withColumn("mean_views", F.round("mean_views", 6))


def _bins_sql(mode: str) -> str:
    inner = "pow(10, i * ((log10(hi) - log10(lo)) / 10) + log10(lo))"
    last = "pow(10, log10(hi))"
    if mode == "clamped":
        edge = (
            "CASE WHEN i = 0 THEN CAST(lo AS DOUBLE) WHEN i = 10 THEN CAST(hi AS DOUBLE) "
            f"ELSE greatest(CAST(lo AS DOUBLE), least(CAST(hi AS DOUBLE), {inner})) END"
        )
    else:
        edge = f"CASE WHEN i = 10 THEN {last} ELSE {inner} END"
    return (
        with_(
            RESULTS,
            "valid AS (SELECT * FROM results WHERE knows IS NOT NULL AND pageviews > 0)",
            "bounds AS (SELECT min(pageviews) AS lo, max(pageviews) AS hi FROM valid)",
            f"edges AS (SELECT i, {edge} AS e FROM bounds, generate_series(0, 10) AS g(i))",
            """binned AS (
  SELECT v.knows, v.pageviews,
         (SELECT max(i) FROM edges WHERE e <= v.pageviews) AS last_le,
         (SELECT e FROM edges WHERE i = 10) AS top
  FROM valid v)""",
            """b AS (
  SELECT knows, CASE WHEN last_le < 10 THEN last_le WHEN pageviews = top THEN 9 END AS bin
  FROM binned WHERE last_le IS NOT NULL)""",
        )
        + """SELECT CAST(b.bin AS INTEGER) AS bin, round(lo.e, 4) AS low, round(hi.e, 4) AS high,
  round(sqrt(lo.e * hi.e), 4) AS mid,
  count(*) FILTER (WHERE knows) AS correct, count(*) AS total,
  CAST(count(*) FILTER (WHERE knows) AS DOUBLE) / count(*) * 100 AS accuracy
FROM b JOIN edges lo ON lo.i = b.bin JOIN edges hi ON hi.i = b.bin + 1
WHERE b.bin IS NOT NULL
GROUP BY b.bin, lo.e, hi.e"""
    )


def _rounded_bins(df):
    return df.select(
        "bin",
        F.round("low", 4).alias("low"),
        F.round("high", 4).alias("high"),
        F.round("mid", 4).alias("mid"),
        "correct",
        "total",
        "accuracy",
    )


@register("log_bins", _bins_sql("clamped"))
def log_bins(spark, sf_dir):
    return _rounded_bins(bins.accuracy_by_log_bins(B.results(spark, sf_dir), 10, edges="clamped"))


@register("bin_points", _bins_sql("float"))
def bin_points(spark, sf_dir):
    """C3 with the reference's float edges (rows can fall outside every bin)."""
    return _rounded_bins(bins.accuracy_by_log_bins(B.results(spark, sf_dir), 10, edges="float"))


@register(
    "rug_points",
    with_(RESULTS)
    + """SELECT CASE WHEN knows THEN 'knows' ELSE 'does_not_know' END AS outcome, pageviews AS views
FROM results WHERE knows IS NOT NULL AND pageviews > 0""",
)
def rug_points(spark, sf_dir):
    return bins.rug_points(B.results(spark, sf_dir))


@register(
    "count_by_month",
    "SELECT strftime(CAST(o_orderdate AS DATE), '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1",
)
def count_by_month(spark, sf_dir):
    return metrics.count_by_month(B.entities(spark, sf_dir))


@register(
    "date_range",
    with_(RESULTS)
    + f"""SELECT name, death_date, pageviews, knows FROM results
WHERE death_date BETWEEN DATE '{DATE_START}' AND DATE '{DATE_END}'""",
)
def date_range(spark, sf_dir):
    r = select.date_range(B.results(spark, sf_dir, start=DATE_START, end=DATE_END), DATE_START, DATE_END)
    return r.select("name", "death_date", "pageviews", "knows")


@register(
    "min_views",
    with_(RESULTS) + f"SELECT name, death_date, pageviews FROM results WHERE pageviews >= {MIN_VIEWS}",
)
def min_views_q(spark, sf_dir):
    r = B.results(spark, sf_dir, min_views=MIN_VIEWS)
    return select.min_views(r, MIN_VIEWS).select("name", "death_date", "pageviews")


@register(
    "known_positive",
    with_(RESULTS) + "SELECT name, pageviews, knows FROM results WHERE knows IS NOT NULL AND pageviews > 0",
)
def known_positive(spark, sf_dir):
    return select.valid_for_bins(B.results(spark, sf_dir)).select("name", "pageviews", "knows")


@register(
    "min_samples",
    with_(RESULTS, MONTHLY) + f"SELECT * FROM monthly WHERE correct + incorrect >= {MIN_KNOWN}",
)
def min_samples_q(spark, sf_dir):
    return select.min_samples(metrics.accuracy_by(B.results(spark, sf_dir), "month"), MIN_KNOWN)


@register(
    "split_outcomes",
    with_(RESULTS)
    + """SELECT CASE WHEN knows THEN 'knows' WHEN NOT knows THEN 'does_not_know' ELSE 'error' END AS outcome,
  count(*) AS n, CAST(sum(pageviews) AS BIGINT) AS views
FROM results GROUP BY 1""",
)
def split_outcomes_q(spark, sf_dir):
    """P7 in one pass: the three-way split as a label column, then one aggregate
    (``select.split_outcomes`` gives the three frames when they are needed apart)."""
    r = B.results(spark, sf_dir)
    return r.groupBy(select.outcome_label().alias("outcome")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("pageviews").cast("bigint").alias("views")
    )


@register(
    "pageviews_60d",
    with_(VIEWS_CTE) + "SELECT article AS name, d AS death_date, pageviews FROM attached WHERE pageviews IS NOT NULL",
)
def pageviews_60d(spark, sf_dir):
    ent = B.entities(spark, sf_dir)
    att = pageviews.attach_pageviews(ent, B.views(spark, sf_dir))
    return select.drop_missing_article(att).select("name", "death_date", "pageviews")


@register(
    "missing_by_month",
    with_(VIEWS_CTE)
    + """SELECT strftime(d, '%Y-%m') AS month, count(*) FILTER (WHERE pageviews IS NULL) AS missing,
  count(*) AS entries FROM attached GROUP BY 1""",
)
def missing_by_month(spark, sf_dir):
    att = pageviews.attach_pageviews(B.entities(spark, sf_dir), B.views(spark, sf_dir))
    return metrics.missing_by_month(att)


@register(
    "monthly_bars",
    with_(RESULTS, MONTHLY)
    + """SELECT month, CAST(month || '-15' AS DATE) AS anchor, accuracy, correct + incorrect AS n,
  printf('%.0f', accuracy) || '%' || chr(10) || '(n=' || CAST(correct + incorrect AS VARCHAR) || ')' AS label
FROM monthly WHERE accuracy IS NOT NULL""",
)
def monthly_bars(spark, sf_dir):
    return report.monthly_bars(B.results(spark, sf_dir))


@register(
    "month_rollup",
    with_(RESULTS, MONTHLY) + "SELECT * FROM monthly",
)
def month_rollup(spark, sf_dir):
    """A2 rolled up from A1 day counts (one scan serves both reports)."""
    daily = metrics.accuracy_by(B.results(spark, sf_dir), "day")
    return metrics.rollup_accuracy(daily)



