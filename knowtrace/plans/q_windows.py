"""Registered queries: period top-N and moving averages."""

from __future__ import annotations

from pyspark.sql import functions as F

from knowtrace.operators import metrics, report, select, smoothing
from knowtrace.plans import bindings as B
from knowtrace.plans.catalog import register
from knowtrace.plans.oracle import DAILY, MONTHLY, RESULTS, with_

TOP_DAY = 3
TOP_MONTH = 10
TOP_MONTH_MIN_VIEWS = 100_000
TREND_MIN_SAMPLES = 100
TREND_RUN = "gpt-5.2_1995-01-01_to_2001-12-31_topmonth-100_minviews-500000.csv"


def _topn_sql(period_fmt: str, n: int, min_views: int | None) -> str:
    where = f"WHERE pageviews >= {min_views}" if min_views else ""
    return with_(RESULTS) + f"""SELECT name, death_date, pageviews, rank FROM (
  SELECT name, death_date, pageviews,
         CAST(row_number() OVER (PARTITION BY strftime(death_date, '{period_fmt}')
                                 ORDER BY pageviews DESC, row_key) AS BIGINT) AS rank
  FROM results {where}) t
WHERE rank <= {n}"""


@register("top_n_day", _topn_sql("%Y-%m-%d", TOP_DAY, None))
def top_n_day(spark, sf_dir):
    r = select.select_top(B.results(spark, sf_dir), tie=["row_key"], top_per_day=TOP_DAY)
    return r.select("name", "death_date", "pageviews", "rank")


@register("top_n_month", _topn_sql("%Y-%m", TOP_MONTH, TOP_MONTH_MIN_VIEWS))
def top_n_month(spark, sf_dir):
    r = select.select_top(
        B.results(spark, sf_dir, min_views=TOP_MONTH_MIN_VIEWS),
        tie=["row_key"],
        top_per_month=TOP_MONTH,
        min_views_n=TOP_MONTH_MIN_VIEWS,
    )
    return r.select("name", "death_date", "pageviews", "rank")


@register(
    "daily_moving_avg",
    with_(
        RESULTS,
        DAILY,
        "s AS (SELECT day, accuracy, row_number() OVER (ORDER BY day) AS pos FROM daily WHERE accuracy IS NOT NULL)",
        "p AS (SELECT count(*) AS n, least(7, count(*) // 3) AS w FROM s)",
    )
    + """SELECT s.day, s.accuracy,
  CASE WHEN p.n > 7 AND s.pos >= p.w THEN
    round((SELECT sum(s2.accuracy * (1.0 / p.w)) FROM s s2 WHERE s2.pos BETWEEN s.pos - p.w + 1 AND s.pos), 6)
  END AS moving_avg,
  CASE WHEN p.n > 7 THEN CAST(p.w AS BIGINT) END AS width
FROM s, p""",
)
def daily_moving_avg(spark, sf_dir):
    """Daily accuracy (NULL days dropped first) with the adaptive valid-mode average."""
    daily = select.known_accuracy(metrics.accuracy_by(B.results(spark, sf_dir), "day")).select("day", "accuracy")
    ma = smoothing.moving_average_valid(daily, "accuracy", "day")
    return ma.select(
        "day", "accuracy", F.round("moving_avg", 6).alias("moving_avg"), F.col("window").cast("bigint").alias("width")
    )


@register(
    "monthly_moving_avg",
    with_(RESULTS, MONTHLY)
    + f"""SELECT month, accuracy, correct + incorrect AS n_known,
  round(avg(accuracy) OVER (ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS moving_avg,
  'GPT 5.2' AS model, 'All deaths with minimum 500 thousand views' AS subtitle
FROM monthly WHERE accuracy IS NOT NULL AND correct + incorrect >= {TREND_MIN_SAMPLES}""",
)
def monthly_moving_avg(spark, sf_dir):
    """Month accuracy, minimum-sample filter *before* the 3-month trailing average,
    with the model and subtitle parsed from the run name."""
    t = report.monthly_trend(B.results(spark, sf_dir), TREND_MIN_SAMPLES, TREND_RUN)
    return t.withColumn("moving_avg", F.round("moving_avg", 6))


#: Order priorities play the runs.
RUN_RESULTS = RESULTS.replace("o_orderkey AS row_key", "o_orderkey AS row_key, o_orderpriority AS run")
RUN_DAILY = DAILY.replace("SELECT strftime", "SELECT run, strftime").replace("GROUP BY 1", "GROUP BY 1, 2")
RUN_MONTHLY = MONTHLY.replace("SELECT strftime", "SELECT run, strftime").replace("GROUP BY 1", "GROUP BY 1, 2")


def _run_results(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_key"), F.col("o_orderpriority").alias("run"))
    return B.results(spark, sf_dir).join(o, "row_key")


@register(
    "run_daily_series",
    with_(
        RUN_RESULTS,
        RUN_DAILY,
        "s AS (SELECT run, day, accuracy, row_number() OVER (PARTITION BY run ORDER BY day) AS pos FROM daily WHERE accuracy IS NOT NULL)",
        "p AS (SELECT run, count(*) AS n, least(7, count(*) // 3) AS w FROM s GROUP BY run)",
    )
    + """SELECT s.run, s.day, s.accuracy,
  CASE WHEN p.n > 7 AND s.pos >= p.w THEN
    round((SELECT sum(s2.accuracy * (1.0 / p.w)) FROM s s2 WHERE s2.run = s.run AND s2.pos BETWEEN s.pos - p.w + 1 AND s.pos), 6)
  END AS moving_avg,
  CASE WHEN p.n > 7 THEN CAST(p.w AS BIGINT) END AS width
FROM s JOIN p ON s.run = p.run""",
)
def run_daily_series(spark, sf_dir):
    """C1 for five runs at once."""
    out = report.daily_series(_run_results(spark, sf_dir), keys=["run"])
    return out.select("run", "day", "accuracy", F.round("moving_avg", 6).alias("moving_avg"), F.col("window").cast("bigint").alias("width"))


@register(
    "run_monthly_trend",
    with_(RUN_RESULTS, RUN_MONTHLY)
    + """SELECT run, month, accuracy, correct + incorrect AS n_known,
  round(avg(accuracy) OVER (PARTITION BY run ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS moving_avg
FROM monthly WHERE correct + incorrect >= 20 AND accuracy IS NOT NULL""",
)
def run_monthly_trend(spark, sf_dir):
    """C5 for five runs at once."""
    out = report.monthly_trend(_run_results(spark, sf_dir), min_samples=20, keys=["run"])
    return out.select("run", "month", "accuracy", "n_known", F.round("moving_avg", 6).alias("moving_avg"))


@register(
    "run_log_bins",
    with_(
        RUN_RESULTS,
        "valid AS (SELECT run, pageviews AS v, knows FROM results WHERE knows IS NOT NULL AND pageviews > 0)",
        "b AS (SELECT run, min(v)::DOUBLE AS lo, max(v)::DOUBLE AS hi FROM valid GROUP BY run)",
        """e AS (SELECT run, i, CASE WHEN i = 0 THEN lo WHEN i = 10 THEN hi ELSE greatest(lo, least(hi, pow(10.0, i * ((log10(hi) - log10(lo)) / 10.0) + log10(lo)))) END AS edge
  FROM b, range(0, 11) r(i))""",
        "bins AS (SELECT l.run, l.i AS bin, l.edge AS low, h.edge AS high FROM e l JOIN e h ON h.run = l.run AND h.i = l.i + 1)",
    )
    + """SELECT bins.run, CAST(bin AS INTEGER) AS bin, round(low, 4) AS low, round(high, 4) AS high, count(*) FILTER (WHERE knows) AS correct, count(*) AS total
FROM valid JOIN bins ON valid.run = bins.run AND v >= low AND (v < high OR (bin = 9 AND v = high)) GROUP BY bins.run, bin, low, high""",
)
def run_log_bins(spark, sf_dir):
    """A5/C3 for five runs at once, each with edges of its own."""
    from knowtrace.operators.bins import accuracy_by_log_bins

    out = accuracy_by_log_bins(_run_results(spark, sf_dir), keys=["run"])
    return out.select("run", "bin", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), "correct", "total")
