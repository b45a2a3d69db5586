"""60-day view totals per entity: interval join + sum.

Domain shape: ``views`` is a daily series (one row per article and day, for
the article's whole life), ``entities`` is much smaller.  Joining on the
article alone would pair every entity with *every* day of its article and
filter afterwards; instead each distinct (article, date) key is exploded into
the day buckets its window touches and equi-joined on (article, bucket):

* the join key is (article, day bucket) with the exact range as residual
  condition, so each key meets only the view days around it and a hot
  article is spread over as many keys as it has buckets;
* the range filter is a scalar-subquery bound on ``day``, so a day-partitioned
  view table is pruned before the shuffle;
* the join is a sort-merge join whatever the planner's estimate: it takes the spans for about as large as the columns of
  the entity file they come from, so it would send them, many times that, through the driver to be broadcast;
* buckets are as wide as the window, so a key becomes two rows at most and meets no more than two windows of days.

An entity with no view row in its window gets NULL ("article missing", the
reference's 404) and is dropped by P3; zero views stay 0.  Totals are keyed
by (title, date), not by title alone (D3).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def title_key(c: str | Column) -> Column:
    """The view-table key of a title (spaces become underscores)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.replace(c, F.lit(" "), F.lit("_"))


def daily_views(views: DataFrame, article: str = "article", day: str = "day", value: str = "views") -> DataFrame:
    """Normalise any (article, day, views) source; a missing value counts as 0."""
    return views.select(
        title_key(article).alias("article"),
        F.col(day).cast("date").alias("day"),
        F.coalesce(F.col(value).cast("bigint"), F.lit(0)).alias("views"),
    )


def _bucket(day: Column, width: int) -> Column:
    return F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / F.lit(width)).cast("bigint")


def window_totals(
    keys: DataFrame,
    views: DataFrame,
    before: int = 1,
    after: int = 58,
    bucket_days: int | None = None,
) -> DataFrame:
    """(article, date) -> total views over ``[date - before, date + after]``; no row without a view row.

    Range join as bucketed equi-join: each distinct key is exploded into the
    ``bucket_days``-wide day buckets its window touches (two at most, as wide as
    the window by default), joined to the views on (article, bucket), and the
    exact day range is the residual condition.  The view side is shuffled once,
    and a hot article spreads over its buckets.
    """
    bucket_days = bucket_days or before + after + 1
    keys = keys.select("article", "date")
    bounds = keys.select(F.struct(F.min("date").alias("lo"), F.max("date").alias("hi"))).scalar()
    daily = views.where(
        (F.col("day") >= F.date_sub(bounds.getField("lo"), before))
        & (F.col("day") <= F.date_add(bounds.getField("hi"), after))
    ).select(
        F.col("article").alias("__va"), F.col("day").alias("__vd"), F.col("views").alias("__v"), _bucket(F.col("day"), bucket_days).alias("__vb")
    )
    lo_day, hi_day = F.date_sub("date", before), F.date_add("date", after)
    spans = keys.distinct().select(
        "article",
        "date",
        F.explode(F.sequence(_bucket(lo_day, bucket_days), _bucket(hi_day, bucket_days))).alias("__b"),
    )
    cond = (
        (spans["article"] == daily["__va"])
        & (spans["__b"] == daily["__vb"])
        & (daily["__vd"] >= F.date_sub(spans["date"], before))
        & (daily["__vd"] <= F.date_add(spans["date"], after))
    )
    joined = spans.hint("merge").join(daily, cond)
    return joined.groupBy("article", "date").agg(F.sum("__v").alias("total"))


def attach_pageviews(
    entities: DataFrame,
    views: DataFrame,
    title: str = "article_title",
    date_col: str = "death_date",
    out: str = "pageviews",
    before: int = 1,
    after: int = 58,
) -> DataFrame:
    """Add ``out`` = views summed over the 60-day window (both ends inclusive).

    ``views`` must already be normalised by :func:`daily_views`.
    """
    keyed = entities.withColumn("__article", title_key(title)).withColumn("__date", F.col(date_col))
    keys = keyed.select(F.col("__article").alias("article"), F.col("__date").alias("date")).where(
        F.col("article").isNotNull() & F.col("date").isNotNull()
    )
    totals = window_totals(keys, views, before, after).select(
        F.col("article").alias("__article"), F.col("date").alias("__date"), F.col("total").cast("bigint").alias(out)
    )
    return keyed.hint("merge").join(totals, ["__article", "__date"], "left").drop("__article", "__date")
