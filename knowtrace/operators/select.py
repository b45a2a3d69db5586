"""Filters, period top-N and ordering.

Filters are plain ``where`` so Catalyst pushes them into the Parquet scan.
The top-N is ``row_number() <= n`` over a period window, which Spark plans as
a ``WindowGroupLimit`` on both sides of the shuffle: a period that holds a
third of all rows is cut to ``n`` rows per map task before it moves.  The
filter order of the reference is kept: minimum views runs *before* top-N.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knowtrace.functions.core import day_key, month_key


def _as_date(d: str | _dt.date | None) -> _dt.date | None:
    if d is None or isinstance(d, _dt.date):
        return d
    return _dt.datetime.strptime(d, "%Y-%m-%d").date()


def date_range(df: DataFrame, start=None, end=None, date_col: str = "death_date") -> DataFrame:
    """Inclusive ``start <= d <= end``; either end may be None (unbounded)."""
    start, end = _as_date(start), _as_date(end)
    if start is not None and end is not None and start > end:
        raise ValueError("start date must not be after end date")
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col(date_col) >= F.lit(start))
    if end is not None:
        cond = cond & (F.col(date_col) <= F.lit(end))
    return df.where(cond) if (start is not None or end is not None) else df


def min_views(df: DataFrame, n: int | None, views: str = "pageviews") -> DataFrame:
    """Keep ``views >= n``; 0 or None means no filter (the reference tests truthiness)."""
    if not n:
        return df
    return df.where(F.col(views) >= F.lit(int(n)))


def drop_missing_article(df: DataFrame, views: str = "pageviews") -> DataFrame:
    """Drop rows whose article had no view rows (NULL), keep zero views."""
    return df.where(F.col(views).isNotNull())


def valid_for_bins(df: DataFrame, views: str = "pageviews", knows: str = "knows") -> DataFrame:
    """Known outcome and strictly positive views."""
    return df.where(F.col(knows).isNotNull() & (F.col(views) > 0))


def min_samples(stats: DataFrame, n: int = 1) -> DataFrame:
    """P5: keep periods with at least ``n`` known (correct + incorrect) rows."""
    return stats.where((F.col("correct") + F.col("incorrect")) >= F.lit(int(n)))


def known_accuracy(stats: DataFrame) -> DataFrame:
    """Drop periods whose accuracy is NULL."""
    return stats.where(F.col("accuracy").isNotNull())


def split_outcomes(df: DataFrame, knows: str = "knows") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(known true, known false, errored)."""
    k = F.col(knows)
    return df.where(k), df.where(~k), df.where(k.isNull())


def outcome_label(knows: str = "knows") -> Column:
    k = F.col(knows)
    return F.when(k, F.lit("knows")).when(~k, F.lit("does_not_know")).otherwise(F.lit("error"))


def period_key(per: str, date_col: str = "death_date") -> Column:
    if per == "day":
        return day_key(date_col)
    if per == "month":
        return month_key(date_col)
    raise ValueError(f"unknown period {per!r}")


def top_n(
    df: DataFrame,
    per: str,
    n: int | None,
    tie: Sequence[str | Column],
    views: str = "pageviews",
    date_col: str = "death_date",
    rank_col: str | None = "rank",
) -> DataFrame:
    """The ``n`` highest-view rows per day or month.

    ``tie`` is required: the reference's stable sort keeps input order for
    equal views, which a distributed engine cannot see, so callers name the
    columns that decide ties (D2).  ``n`` of 0/None means all: the rows come back
    as they are, unranked and unsorted (the rank is NULL), as in the reference.
    """
    if not tie:
        raise ValueError("top_n needs explicit tie-break columns")
    if not n:
        return df.withColumn(rank_col, F.lit(None).cast("bigint")) if rank_col else df
    order = [F.col(views).desc()] + [F.col(t) if isinstance(t, str) else t for t in tie]
    w = Window.partitionBy(period_key(per, date_col)).orderBy(*order)
    rn = F.row_number().over(w)
    out = df.withColumn("__rn", rn).where(F.col("__rn") <= F.lit(int(n)))
    if rank_col:
        out = out.withColumn(rank_col, F.col("__rn").cast("bigint"))
    return out.drop("__rn")


def select_top(
    df: DataFrame,
    tie: Sequence[str | Column],
    top_per_day: int | None = None,
    top_per_month: int | None = None,
    min_views_n: int | None = None,
    views: str = "pageviews",
    date_col: str = "death_date",
) -> DataFrame:
    """P2 then W1/W2, exactly one period at most (the two are mutually exclusive)."""
    if top_per_day is not None and top_per_month is not None:
        raise ValueError("top_per_day and top_per_month are mutually exclusive")
    df = min_views(df, min_views_n, views)
    if top_per_month is not None:
        return top_n(df, "month", top_per_month, tie, views, date_col)
    if top_per_day is not None:
        return top_n(df, "day", top_per_day, tie, views, date_col)
    return df


def selection_order(per: str | None, tie: Sequence[str], views: str = "pageviews", date_col: str = "death_date") -> list[Column]:
    """The row order the reference emits after selection (period, views desc, tie)."""
    cols: list[Column] = []
    if per is not None:
        cols.append(period_key(per, date_col).asc())
    cols += [F.col(views).desc()] + [F.col(t).asc() for t in tie]
    return cols


def order_entities(df: DataFrame, tie: Sequence[str] = ("name",), date_col: str = "death_date", views: str = "pageviews") -> DataFrame:
    """O1: date ascending, views descending, then the tie columns."""
    return df.orderBy(F.col(date_col).asc(), F.col(views).desc(), *[F.col(t).asc() for t in tie])
