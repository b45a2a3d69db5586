"""Report frames: the data behind each chart and the text report.

All of these read an already-aggregated series (days, months, bins), so the
single-partition windows inside them see calendar-sized inputs only.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knowtrace.functions.core import mid_month, pct_text, py_fixed, thousands
from knowtrace.functions.labels import model_title, views_subtitle
from knowtrace.operators import bins, metrics, select, smoothing


def daily_series(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Day, accuracy (NULL days dropped), valid-mode moving average; a series for each group of ``keys``."""
    daily = select.known_accuracy(metrics.accuracy_by(results, [*keys, "day"])).select(*keys, "day", "accuracy")
    return smoothing.moving_average_valid(daily, "accuracy", "day", keys=keys)


def monthly_bars(results: DataFrame) -> DataFrame:
    """Month, mid-month anchor date, accuracy, n known, the bar's label."""
    m = select.known_accuracy(metrics.accuracy_by(results, "month"))
    n = F.col("correct") + F.col("incorrect")
    label = F.concat(py_fixed("accuracy", 0), F.lit("%\n(n="), n.cast("string"), F.lit(")"))
    return m.select("month", mid_month("month").alias("anchor"), "accuracy", n.alias("n"), label.alias("label"))


def monthly_trend(results: DataFrame, min_samples: int = 1, run: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Months with enough known rows, 3-month trailing average, model and subtitle of the run.

    With ``keys`` (such as those of ``ingest.with_run_dimensions``) each group is a trend of its own.
    """
    m = metrics.accuracy_by(results, [*keys, "month"])
    m = select.known_accuracy(select.min_samples(m, min_samples))
    out = smoothing.moving_average_trailing(m, "accuracy", "month", 3, keys).select(
        *keys, "month", "accuracy", (F.col("correct") + F.col("incorrect")).alias("n_known"), "moving_avg"
    )
    if run is not None:
        out = out.withColumn("model", model_title(F.lit(run))).withColumn("subtitle", views_subtitle(F.lit(run)))
    return out


def report_rows(results: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """The text report as (seq, section, text) rows: overall, view statistics per outcome, by month.

    ``seq`` is the order to print them in.  ``stats``: :func:`metrics.pageview_stats`, if at hand.
    """
    o = metrics.overall_summary(results)

    def line(label, count_col, pct_col):
        return F.concat(F.lit(label), F.col(count_col).cast("string"), F.lit(" ("), pct_text(pct_col), F.lit(")"))

    overall = o.select(
        F.posexplode(
            F.array(
                F.concat(F.lit("Total tested: "), F.col("total").cast("string")),
                line("  Knows death: ", "correct", "pct_correct"),
                line("  Doesn't know: ", "incorrect", "pct_incorrect"),
                F.when(F.col("unknown") > 0, line("  Errors: ", "unknown", "pct_unknown")),
            )
        ).alias("seq", "text")
    ).where(F.col("text").isNotNull()).select(F.col("seq").cast("bigint").alias("seq"), F.lit("overall").alias("section"), "text")
    st = (metrics.pageview_stats(results) if stats is None else stats).where("count > 0")
    stats = st.select(
        F.when(F.col("knows"), F.lit(10)).otherwise(F.lit(11)).cast("bigint").alias("seq"),
        F.lit("stats").alias("section"),
        F.concat(
            F.when(F.col("knows"), F.lit("  Deaths model KNOWS (n=")).otherwise(F.lit("  Deaths model DOESN'T KNOW (n=")),
            F.col("count").cast("string"),
            F.lit("): Min: "),
            thousands("min_views"),
            F.lit("  Max: "),
            thousands("max_views"),
            F.lit("  Mean: "),
            py_fixed("mean_views", 0, grouping=True),
            F.lit("  Median: "),
            py_fixed("median_views", 0, grouping=True),
        ).alias("text"),
    )
    m = metrics.accuracy_by(results, "month")
    months = m.select(
        # months of the calendar, not rows of the input
        (F.lit(100) + F.row_number().over(Window.orderBy("month")) - 1).cast("bigint").alias("seq"),
        F.lit("month").alias("section"),
        F.concat(
            F.lit("  "),
            F.col("month"),
            F.lit(": "),
            pct_text("accuracy"),
            F.lit(" ("),
            F.col("correct").cast("string"),
            F.lit("/"),
            (F.col("correct") + F.col("incorrect")).cast("string"),
            F.lit(" known)"),
        ).alias("text"),
    )
    return overall.unionByName(stats).unionByName(months)


class Report(Mapping):
    """Frames by name; each is built when it is first asked for, and then kept."""

    def __init__(self, builders: dict[str, Callable[[], DataFrame]]):
        self._builders, self._frames = builders, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self._builders[name]()
        return self._frames[name]

    def __iter__(self):
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)


def recall_report(results: DataFrame, num_bins: int = 10, min_samples: int = 1, run: str | None = None) -> Report:
    """Every report frame of one results table.  Nothing runs on the call itself;
    asking for the view statistics (or the rows that print them) starts one job.
    """
    out = Report(
        {
            "by_day": lambda: metrics.accuracy_by(results, "day"),
            "by_month": lambda: metrics.accuracy_by(results, "month"),
            "overall": lambda: metrics.overall_summary(results),
            "pageview_stats": lambda: metrics.pageview_stats(results),
            "daily_series": lambda: daily_series(results),
            "monthly_bars": lambda: monthly_bars(results),
            "bins": lambda: bins.accuracy_by_log_bins(results, num_bins),
            "rug": lambda: bins.rug_points(results),
            "monthly_trend": lambda: monthly_trend(results, min_samples, run),
            "report_rows": lambda: report_rows(results, out["pageview_stats"]),
        }
    )
    return out
