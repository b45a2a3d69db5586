"""Log-spaced histogram of accuracy by views.

Plan: one global min/max aggregate that Spark runs as a scalar subquery
(one row, broadcast as a literal), then one arithmetic bin column per row
and one ``groupBy(bin)`` with partial aggregation.  The reference scans every row
once per bin; this is a single pass after the min/max.

Edge modes (D1):
* ``clamped`` (default): interior edges are ``10 ** (log_lo + i * step)``;
  the first and last edge are the exact min and max, so no row is lost.
* ``float``: every edge is ``10 ** y`` as in the reference (rows at the ends
  can fall outside all bins through rounding, as they do there).
Bins are half-open ``[low, high)`` except the last, which is closed; empty
bins are omitted; ``mid`` is the geometric mean ``sqrt(low * high)``.

With ``keys`` each group (a run, say) has edges of its own: its min and max are one
row of a small aggregate that is joined back by key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowtrace.operators.select import valid_for_bins


def log_edges(lo: Column, hi: Column, num_bins: int, mode: str = "clamped") -> Column:
    """Array of ``num_bins + 1`` log-spaced edges between lo and hi."""
    log_lo, log_hi = F.log10(lo.cast("double")), F.log10(hi.cast("double"))
    step = (log_hi - log_lo) / F.lit(float(num_bins))
    raw = F.transform(
        F.sequence(F.lit(0), F.lit(num_bins)),
        lambda i: F.when(i == num_bins, F.pow(F.lit(10.0), log_hi)).otherwise(
            F.pow(F.lit(10.0), i.cast("double") * step + log_lo)
        ),
    )
    if mode == "float":
        return raw
    if mode != "clamped":
        raise ValueError("edges must be 'clamped' or 'float'")
    lo_d, hi_d = lo.cast("double"), hi.cast("double")
    # Interior edges are clamped into [lo, hi] so the array stays monotonic even
    # when rounding pushes 10**log10(x) past x (e.g. min == max).
    return F.transform(
        raw,
        lambda e, i: F.when(i == 0, lo_d).when(i == num_bins, hi_d).otherwise(F.greatest(lo_d, F.least(hi_d, e))),
    )


def edge_at(i: Column, lo: Column, hi: Column, num_bins: int, mode: str = "clamped") -> Column:
    """Edge ``i`` of :func:`log_edges` as a scalar expression (no array per row)."""
    lo_d, hi_d = lo.cast("double"), hi.cast("double")
    log_lo, log_hi = F.log10(lo_d), F.log10(hi_d)
    step = (log_hi - log_lo) / F.lit(float(num_bins))
    raw = F.when(i == num_bins, F.pow(F.lit(10.0), log_hi)).otherwise(F.pow(F.lit(10.0), i.cast("double") * step + log_lo))
    if mode == "float":
        return raw
    if mode != "clamped":
        raise ValueError("edges must be 'clamped' or 'float'")
    return F.when(i == 0, lo_d).when(i == num_bins, hi_d).otherwise(F.greatest(lo_d, F.least(hi_d, raw)))


def with_bounds(valid: DataFrame, views: str = "pageviews", keys: Sequence[str] = ()) -> DataFrame:
    """Attach ``__lo`` and ``__hi``, the least and most views of the row's group (of all rows without keys)."""
    bounds = [F.min(views).alias("__lo"), F.max(views).alias("__hi")]
    if not keys:
        # One row (a global aggregate): broadcast-join it so the bounds are plain columns.  As a
        # scalar subquery it would be copied into every one of the many expressions that read it.
        one = valid.agg(*bounds).withColumn("__one", F.lit(1))
        return valid.withColumn("__one", F.lit(1)).join(F.broadcast(one), "__one").drop("__one")
    # one row a group, of any number of groups: the planner measures the side before it broadcasts it
    own = valid.groupBy(*[F.col(k).alias(f"__of_{k}") for k in keys]).agg(*bounds)
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys])
    return valid.join(own, same).drop(*[f"__of_{k}" for k in keys])


def with_log_bin(
    valid: DataFrame, num_bins: int = 10, views: str = "pageviews", mode: str = "clamped", keys: Sequence[str] = ()
) -> tuple[DataFrame, Column]:
    """Attach ``bin`` (NULL when a row falls outside every bin) and return the edge column.

    The bin is the index of the last edge <= v (last bin closed).  It is
    estimated from ``log10(v)`` and corrected by one step against the exact
    edge values, so it equals the edge comparison without building or
    scanning an edge array per row (array lambdas run interpreted).
    """
    valid = with_bounds(valid, views, keys)
    lo, hi = F.col("__lo"), F.col("__hi")
    edge = lambda i: edge_at(i, lo, hi, num_bins, mode)
    n = F.lit(num_bins)
    v = F.col(views).cast("double")
    log_lo = F.log10(lo.cast("double"))
    step = (F.log10(hi.cast("double")) - log_lo) / F.lit(float(num_bins))
    est = F.least(F.greatest(F.floor((F.log10(v) - log_lo) / step), F.lit(0)), n).cast("int")
    valid = valid.withColumn("__k", F.when(step > 0, est))
    k = F.col("__k")
    fixed = F.when(v < edge(k), k - 1).when((k < n) & (v >= edge(k + 1)), k + 1).otherwise(k)
    # min == max: every edge is the same value e; the last edge <= v is n when e <= v.
    same = F.when(v >= edge(n), n).otherwise(F.lit(-1))
    valid = valid.withColumn("__last", F.when(step > 0, fixed).otherwise(same))
    last = F.col("__last")
    bin_col = F.when(last < 0, F.lit(None)).when(last < n, last).when(v == edge(n), n - 1)
    return valid.withColumn("bin", bin_col.cast("int")).drop("__k", "__last"), log_edges(lo, hi, num_bins, mode)


def accuracy_by_log_bins(
    results: DataFrame,
    num_bins: int = 10,
    views: str = "pageviews",
    knows: str = "knows",
    edges: str = "clamped",
    keys: Sequence[str] = (),
) -> DataFrame:
    """``bin, low, high, mid, correct, total, accuracy`` for non-empty bins (of each group of ``keys``)."""
    valid = valid_for_bins(results, views, knows)
    binned, edge_col = with_log_bin(valid, num_bins, views, edges, keys)
    # __lo/__hi are constants of the group, grouping by them adds no split.
    agg = binned.where(F.col("bin").isNotNull()).groupBy(*keys, "bin", "__lo", "__hi").agg(
        F.count_if(F.col(knows)).alias("correct"),
        F.count(F.lit(1)).alias("total"),
    )
    low = edge_at(F.col("bin"), F.col("__lo"), F.col("__hi"), num_bins, edges)
    high = edge_at(F.col("bin") + 1, F.col("__lo"), F.col("__hi"), num_bins, edges)
    return agg.select(
        *keys,
        "bin",
        low.alias("low"),
        high.alias("high"),
        F.sqrt(low * high).alias("mid"),
        "correct",
        "total",
        (F.col("correct").cast("double") / F.col("total") * 100.0).alias("accuracy"),
    )


def rug_points(results: DataFrame, views: str = "pageviews", knows: str = "knows") -> DataFrame:
    """C4: individual views of known-true and known-false rows with views > 0."""
    valid = valid_for_bins(results, views, knows)
    return valid.select(
        F.when(F.col(knows), F.lit("knows")).otherwise(F.lit("does_not_know")).alias("outcome"),
        F.col(views).alias("views"),
    )
