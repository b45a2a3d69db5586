"""Tri-state accuracy and count aggregates.

Every aggregate here is a plain ``groupBy().agg()`` so Spark plans a partial
(map-side) aggregate before the shuffle: a hot key (one day holding a third of
all rows) is reduced to one row per task before it moves.  Accuracy is recall
(every subject did die), kept under the reference's name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knowtrace.functions.core import accuracy_pct, day_key, month_key


def _tri_counts(knows: str) -> list[Column]:
    k = F.col(knows)
    return [
        F.count_if(k).alias("correct"),
        F.count_if(~k).alias("incorrect"),
        F.count_if(k.isNull()).alias("unknown"),
        F.count(F.lit(1)).alias("total"),
    ]


def accuracy_by(
    results: DataFrame,
    keys: str | Sequence[str | Column] = "month",
    date_col: str = "death_date",
    knows: str = "knows",
) -> DataFrame:
    """A1/A2: correct / incorrect / unknown / total and accuracy per key.

    ``keys='day'`` or ``'month'`` derive the period from ``date_col``; any other
    list of columns (e.g. ``['run', 'month']``) is used as given.  Unknown rows
    count in ``total`` but not in ``accuracy``; accuracy is NULL when nothing
    is known.
    """
    if isinstance(keys, str):
        keys = [keys]
    key_cols: list[Column] = []
    for k in keys:
        if k == "day":
            key_cols.append(day_key(date_col).alias("day"))
        elif k == "month":
            key_cols.append(month_key(date_col).alias("month"))
        else:
            key_cols.append(F.col(k) if isinstance(k, str) else k)
    agg = results.groupBy(*key_cols).agg(*_tri_counts(knows))
    return agg.withColumn("accuracy", accuracy_pct("correct", F.col("correct") + F.col("incorrect")))


def rollup_accuracy(daily: DataFrame, to: str = "month") -> DataFrame:
    """A2 from A1 counts (E3): re-aggregate day rows into months without a second scan."""
    if to != "month":
        raise ValueError("only day -> month roll-up is defined")
    m = F.substring("day", 1, 7).alias("month")
    agg = daily.groupBy(m).agg(*(F.sum(c).cast("bigint").alias(c) for c in ("correct", "incorrect", "unknown", "total")))
    return agg.withColumn("accuracy", accuracy_pct("correct", F.col("correct") + F.col("incorrect")))


def overall_summary(results: DataFrame, knows: str = "knows") -> DataFrame:
    """A3: one row with counts and percentages of *all* rows (errors included)."""
    agg = results.agg(*_tri_counts(knows))
    total = F.col("total").cast("double")
    return agg.select(
        "total",
        "correct",
        "incorrect",
        "unknown",
        (F.try_divide(F.col("correct").cast("double"), total) * 100.0).alias("pct_correct"),
        (F.try_divide(F.col("incorrect").cast("double"), total) * 100.0).alias("pct_incorrect"),
        (F.try_divide(F.col("unknown").cast("double"), total) * 100.0).alias("pct_unknown"),
    )


def exact_median(df: DataFrame, group: str, value: str) -> DataFrame:
    """Exact median of ``value`` per ``group`` (mean of the two middle values
    when the count is even), computed without gathering a group in one task.

    1. ``(group, value) -> n``: a partial aggregate, so a hot value is one row.
    2. Global sort of those rows (range-partitioned; distinct keys split
       evenly), reliably checkpointed so every branch reads the same partitions.
    3. Per (partition, group) sums -> offsets of each partition inside its
       group (a few rows per partition, broadcast).
    4. Running sum inside each range partition -> each value covers the ranks
       ``[start, end)`` of its group; keep the values covering the middle ranks.
    """
    return _median_of_counts(_sorted_counts(df, group, value), group, value)


def _sorted_counts(df: DataFrame, group: str, value: str) -> DataFrame:
    """``group, value, __n`` in order with the partition's number, checkpointed (steps 1 and 2 above)."""
    from knowtrace.session import cut_lineage

    vc = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("__n"))
    return cut_lineage(vc.orderBy(group, value).withColumn("__pid", F.spark_partition_id()))


def _median_of_counts(tagged: DataFrame, group: str, value: str) -> DataFrame:
    part = tagged.groupBy("__pid", group).agg(F.sum("__n").alias("__pn"))
    before = Window.partitionBy(group).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("__off", F.coalesce(F.sum("__pn").over(before), F.lit(0)))
    totals = part.groupBy(group).agg(F.sum("__pn").alias("__total"))
    run = Window.partitionBy("__pid", group).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = tagged.withColumn("__cum", F.sum("__n").over(run))
    # Groups are the caller's, so no broadcast is asked for; few ones are broadcast at run time.
    cum = cum.join(part.select("__pid", group, "__off"), ["__pid", group])
    cum = cum.join(totals, group)
    end = F.col("__off") + F.col("__cum")
    start = end - F.col("__n")
    lo = F.floor((F.col("__total") - 1) / 2)
    hi = F.floor(F.col("__total") / 2)
    covers = lambda r: (start <= r) & (r < end)
    v = F.col(value).cast("double")
    picked = cum.where(covers(lo) | covers(hi))
    return picked.groupBy(group).agg(
        ((F.sum(F.when(covers(lo), v)) + F.sum(F.when(covers(hi), v))) / 2.0).alias("median")
    )


def pageview_stats(results: DataFrame, views: str = "pageviews", knows: str = "knows") -> DataFrame:
    """A4: min, max, mean, exact median and count of views per known outcome.

    One scan: count, min, max, mean and the exact median all come from the
    checkpointed counts ``(outcome, views) -> n`` (distinct values, not rows), and
    no outcome is gathered in one task.  Views of 0 are included (unlike the bin
    operator).  An outcome without rows has a row of zeros.
    """
    known = results.where(F.col(knows).isNotNull()).select(
        F.col(knows).alias("knows"), F.col(views).cast("bigint").alias("v")
    )
    vc = _sorted_counts(known, "knows", "v")
    n = F.col("__n")
    stats = vc.groupBy("knows").agg(
        F.min("v").alias("min_views"),
        F.max("v").alias("max_views"),
        (F.sum(F.col("v") * n).cast("double") / F.sum(n)).alias("mean_views"),
        F.sum(n).cast("bigint").alias("count"),
    )
    med = _median_of_counts(vc, "knows", "v").withColumnRenamed("median", "median_views")
    outcomes = results.sparkSession.range(2).select((F.col("id") == 1).alias("knows"))
    both = outcomes.join(stats.join(med, "knows"), "knows", "left").na.fill(0)
    return both.select("knows", "min_views", "max_views", "mean_views", "median_views", "count")


def count_by_month(entities: DataFrame, date_col: str = "death_date") -> DataFrame:
    """Row count per 'YYYY-MM'."""
    return entities.groupBy(month_key(date_col).alias("month")).agg(F.count(F.lit(1)).alias("n"))


def reject_summary(rejects: DataFrame, by: Sequence[str] = ("code",)) -> DataFrame:
    """Rejected-entry count per reason (optionally per page)."""
    return rejects.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def response_status_counts(responses: DataFrame, status: str = "status") -> DataFrame:
    """Succeeded / processing / errored counts."""
    return responses.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def missing_by_month(attached: DataFrame, views: str = "pageviews", date_col: str = "death_date") -> DataFrame:
    """Entries whose article has no view rows at all, per month."""
    return attached.groupBy(month_key(date_col).alias("month")).agg(
        F.count_if(F.col(views).isNull()).alias("missing"),
        F.count(F.lit(1)).alias("entries"),
    )
