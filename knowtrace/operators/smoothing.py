"""Moving averages over an already-aggregated period series.

Both run on the output of a period aggregate (one row per day or month), so
the series is bounded by the calendar, not by the data; the global-order
window below therefore sees a few thousand rows at most whatever the input
size.  Never call these on raw rows.

With ``keys`` every group (a run, say) is a series of its own: the window is partitioned by
the keys and the adaptive width comes from the group's count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def moving_average_valid(
    series: DataFrame,
    value: str = "accuracy",
    order: str = "day",
    max_window: int = 7,
    min_points: int | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Adaptive-width simple moving average in numpy ``'valid'`` mode.

    width ``w = min(max_window, n // 3)``; only defined when ``n > max_window``;
    the first ``w - 1`` points get NULL; each average is stamped on the last
    point of its window.  The window counts data points, not calendar days.
    Frame bounds must be literals, so the frame is the fixed
    ``max_window``-row frame and the width is applied with ``slice``.
    """
    min_points = max_window if min_points is None else min_points
    w_ord = Window.partitionBy(*keys).orderBy(order) if keys else Window.orderBy(order)
    frame = w_ord.rowsBetween(-(max_window - 1), Window.currentRow)
    # The point count is a scalar subquery (a window count by key); lambdas may not hold
    # one, so it is attached as a column before the width enters the slice/aggregate.
    counted = F.count(F.lit(1)).over(Window.partitionBy(*keys)) if keys else series.select(F.count(F.lit(1))).scalar()
    series = series.withColumn("__n", counted)
    n = F.col("__n")
    width = F.least(F.lit(max_window), F.floor(n / 3).cast("int"))
    out = series.withColumn("__pos", F.row_number().over(w_ord)).withColumn(
        "__frame", F.collect_list(F.col(value).cast("double")).over(frame)
    )
    weight = F.lit(1.0) / width
    avg = F.aggregate(F.slice("__frame", -width, width), F.lit(0.0), lambda acc, x: acc + x * weight)
    defined = (n > F.lit(min_points)) & (F.col("__pos") >= width)
    return (
        out.withColumn("moving_avg", F.when(defined, avg))
        .withColumn("window", F.when(n > F.lit(min_points), width))
        .drop("__pos", "__frame", "__n")
    )


def moving_average_trailing(
    series: DataFrame, value: str = "accuracy", order: str = "month", window: int = 3, keys: Sequence[str] = ()
) -> DataFrame:
    """Trailing mean with an expanding head (first points average what exists)."""
    ordered = Window.partitionBy(*keys).orderBy(order) if keys else Window.orderBy(order)
    frame = ordered.rowsBetween(-(window - 1), Window.currentRow)
    return series.withColumn("moving_avg", F.avg(F.col(value).cast("double")).over(frame))
