"""Collection job and resumable month ingestion.

Resume rule of the reference: a month counts as done when *any* output row
falls in it (D8), so a month that produced no rows is tried again and a
partly written month is never refilled.  ``pending_months`` is a left-anti
join of the wanted months (one row per month, tiny) against the distinct
months already present (a partial aggregate over the existing output).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knowtrace.functions.core import month_key
from knowtrace.operators import pageviews, select
from knowtrace.operators import wikitext as W
from knowtrace.session import cut_lineage
from knowtrace.sources import csv_io


def completed_months(existing: DataFrame, date_col: str = "death_date") -> DataFrame:
    """A10: distinct 'YYYY-MM' keys present in the existing output."""
    return existing.select(month_key(date_col).alias("month")).where(F.col("month").isNotNull()).distinct()


def pending_months(spark: SparkSession, start, end, existing: DataFrame | None, date_col: str = "death_date") -> DataFrame:
    """Months of ``[start, end]`` with no existing row, ascending (``year, month, month_start, month key``)."""
    wanted = W.month_starts(spark, start, end).withColumn("month_key", F.date_format("month_start", "yyyy-MM"))
    if existing is None:
        return wanted
    done = completed_months(existing, date_col)
    return wanted.join(done, wanted["month_key"] == done["month"], "left_anti")


def collect_entities(
    pages: DataFrame,
    views: DataFrame,
    start,
    end,
    title: str = "title",
    months: DataFrame | None = None,
    corrections: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """T4 (one pass): month pages in range -> parse -> corrections -> date filter
    -> 60-day views -> drop rows without an article.  Returns ``(entities, rejects)``.

    ``months`` restricts the pages further (``pending_months`` for a resume).
    Rows that ``corrections`` (J5) repairs get their views like any other.
    """
    spark = pages.sparkSession
    months = months if months is not None else W.month_starts(spark, start, end)
    wanted = W.month_pages(pages, months, title)
    # Entities, rejects and the view join (date bounds, day spans, join back) all
    # read the parsed rows: checkpoint them once rather than parse for each.
    parsed = cut_lineage(W.parse_all(wanted))
    ent = parsed.where(F.col("code") == "ok").select(*W.ENTITY_COLS)
    rejects = parsed.where(F.col("code") != "ok").select(*W.REJECT_COLS)
    if corrections is not None:
        ent = ent.unionByName(W.apply_corrections(rejects, corrections), allowMissingColumns=True)
    ent = select.date_range(ent, start, end)
    att = select.drop_missing_article(pageviews.attach_pageviews(ent, views))
    return att, rejects


def union_existing(new: DataFrame, existing: DataFrame, cols: Sequence[str] = ("name", "death_date", "description", "pageviews")) -> DataFrame:
    """Existing rows (also those outside the requested range) plus the new ones."""
    return existing.select(*cols).unionByName(new.select(*cols))


def ingest_months(pages: DataFrame, views: DataFrame, existing: DataFrame | None, start, end, title: str = "title") -> DataFrame:
    """K4: collect only the pending months and append them to what exists.

    The caller writes the result (``write_entities``); re-running with the
    written output as ``existing`` adds nothing for months already present.
    """
    spark = pages.sparkSession
    todo = pending_months(spark, start, end, existing)
    new, _ = collect_entities(pages, views, start, end, title, months=todo)
    new = new.select("name", "death_date", "description", "pageviews")
    if existing is None:
        return new
    return union_existing(new, existing)


def append_months(pages: DataFrame, views: DataFrame, path: str, start, end, title: str = "title", corrections: DataFrame | None = None) -> bool:
    """K4: collect the months that the entity CSV at ``path`` lacks and append them to it.

    Files already there are neither read beyond their dates nor written again;
    a second run on its own output finds nothing to do.  Returns whether rows came.
    """
    spark = pages.sparkSession
    todo = pending_months(spark, start, end, csv_io.read_entities(spark, path, missing_ok=True))
    new, _ = collect_entities(pages, views, start, end, title, months=todo, corrections=corrections)
    return csv_io.write_entities(new, path, mode="append")


def with_run_dimensions(results: DataFrame, run_col: str = "run") -> DataFrame:
    """Model title, subtitle and minimum views parsed from each row's run name."""
    from knowtrace.functions.labels import min_views_of, model_title, views_subtitle

    r = F.col(run_col)
    return results.withColumn("model", model_title(r)).withColumn("subtitle", views_subtitle(r)).withColumn(
        "min_views", min_views_of(r)
    )
