"""Bind the driver's generic tables to the roles the operators expect.

The operators take column names; these functions map the TPC-H-style
tables onto the domain (SURVEY 5.1):

* ``results`` / ``entities``  <- ``orders``: name = order key, date = order
  date, views = floor(total price), outcome = status F -> 'True',
  O -> 'False', P -> '' (unknown), read through the exact-match tri-state.
* ``daily_views``            <- ``lineitem``: article = order key,
  day = ship date, views = quantity.
* answers                    <- ``conversations``: a user turn and the next
  assistant turn of the same conversation.

Each binding returns a lazy DataFrame over the whole table; Catalyst prunes
the columns the query does not use and pushes its filters into the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knowtrace.functions.core import tri_state
from knowtrace.operators.pageviews import daily_views


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def outcome_text(status: str = "o_orderstatus"):
    s = F.col(status)
    return F.when(s == "F", F.lit("True")).when(s == "O", F.lit("False")).otherwise(F.lit(""))


def scan_filter(
    df: DataFrame, ts_col: str | None = None, start=None, end=None, value_col: str | None = None, min_value=None
) -> DataFrame:
    """Predicates on the *stored* columns, equivalent to the derived-column
    filters the operators apply (date = to_date(ts), views = floor(value)), so
    Parquet gets them as PushedFilters and skips row groups.

    ``to_date(ts) in [start, end]``  <=>  ``start <= ts < end + 1 day``;
    ``floor(v) >= n`` (integer n)    <=>  ``v >= n``.
    """
    import datetime as _dt

    def as_day(d):
        return d if isinstance(d, _dt.date) else _dt.date.fromisoformat(str(d))

    if ts_col is not None and start is not None:
        lo = _dt.datetime.combine(as_day(start), _dt.time())
        df = df.where(F.col(ts_col) >= F.lit(lo).cast("timestamp_ntz"))
    if ts_col is not None and end is not None:
        hi = _dt.datetime.combine(as_day(end) + _dt.timedelta(days=1), _dt.time())
        df = df.where(F.col(ts_col) < F.lit(hi).cast("timestamp_ntz"))
    if value_col is not None and min_value:
        df = df.where(F.col(value_col) >= F.lit(float(int(min_value))))
    return df


def results(spark: SparkSession, sf_dir: str, start=None, end=None, min_views=None) -> DataFrame:
    o = scan_filter(table(spark, sf_dir, "orders"), "o_orderdate", start, end, "o_totalprice", min_views)
    return o.select(
        F.col("o_orderkey").cast("string").alias("name"),
        F.to_date("o_orderdate").alias("death_date"),
        F.concat(F.lit("customer "), F.col("o_custkey").cast("string"), F.lit(" order")).alias("description"),
        F.floor("o_totalprice").cast("bigint").alias("pageviews"),
        tri_state(outcome_text()).alias("knows"),
        F.col("o_orderkey").alias("row_key"),
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity rows before view totals: title = name = order key."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("name"),
        F.col("o_orderkey").cast("string").alias("article_title"),
        F.to_date("o_orderdate").alias("death_date"),
        F.concat(F.lit("customer "), F.col("o_custkey").cast("string"), F.lit(" order")).alias("description"),
        F.col("o_orderkey").alias("row_key"),
    )


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return daily_views(
        li.select(
            F.col("l_orderkey").cast("string").alias("article"),
            F.to_date("l_shipdate").alias("day"),
            F.col("l_quantity").cast("bigint").alias("views"),
        )
    )


def person_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily views under the article names of the rendered month pages."""
    li = table(spark, sf_dir, "lineitem")
    return daily_views(
        li.select(
            F.concat(F.lit("Person_"), F.col("l_orderkey").cast("string")).alias("article"),
            F.to_date("l_shipdate").alias("day"),
            F.col("l_quantity").cast("bigint").alias("views"),
        )
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, prompt, answer): each user turn with the next turn if it is the assistant's.

    ``lead`` over the conversation is a window partitioned by conversation,
    so a long conversation stays one bounded group.
    """
    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    nxt = c.select(
        "conv_id",
        "turn",
        "role",
        F.col("text").alias("prompt"),
        F.lead("role").over(w).alias("next_role"),
        F.lead("text").over(w).alias("next_text"),
    )
    return nxt.where(F.col("role") == "user").select(
        "conv_id",
        "turn",
        "prompt",
        F.when(F.col("next_role") == "assistant", F.col("next_text")).alias("answer"),
    )


def conv_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests from conversations: each user turn, numbered 0.. in (conv_id, turn) order.

    ``request_id`` is the ordinal as text (the typed family's id rule).
    """
    from knowtrace.operators.requests import with_ordinal

    a = answers(spark, sf_dir)
    a = with_ordinal(a, [F.col("conv_id").asc(), F.col("turn").asc()], "position")
    return a.withColumn("request_id", F.col("position").cast("string"))
