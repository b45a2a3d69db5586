"""Registered queries: page line state, entry parsing, rejects, suggestions,
corrections and month pages (T1, T4, W5-W8, X1-X17, J5, A8, S3, U1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from knowtrace.operators import ingest, metrics, pageviews
from knowtrace.operators import wikitext as W
from knowtrace.plans import bindings as B
from knowtrace.plans.catalog import register
from knowtrace.plans.oracle import with_
from knowtrace.plans.render import SQL_EMITTED, SQL_SOURCES, render_pages
from knowtrace.session import cut_lineage

COLLECT_START, COLLECT_END = "1996-03-01", "1997-06-30"
PAGES_START, PAGES_END = "1996-01-15", "1996-12-31"

SUGGESTION_SQL = "suggestion"


@register(
    "page_lines",
    with_(SQL_SOURCES, SQL_EMITTED) + "SELECT line, CAST(day AS INTEGER) AS day, parent_item FROM emitted",
)
def page_lines(spark, sf_dir):
    lines = W.page_lines(render_pages(spark, sf_dir))
    return lines.select("line", "day", "parent_item")


ENTITIES_SQL = """SELECT CASE WHEN shape = 1 THEN replace(c_name_sp, '#', ' ') ELSE t END AS name,
  t AS article_title, d AS death_date,
  CASE WHEN shape = 1 THEN descr || ' (since ' || year || ', active)' ELSE descr END AS description
FROM ok"""


@register(
    "parse_entries",
    with_(SQL_SOURCES, "ok AS (SELECT *, n2 AS c_name_sp FROM src WHERE shape IN (0, 1, 2, 3, 7))") + ENTITIES_SQL,
)
def parse_entries(spark, sf_dir):
    ent, _ = W.parse_pages(render_pages(spark, sf_dir))
    return ent.select("name", "article_title", "death_date", "description")


@register(
    "reject_summary",
    with_(SQL_SOURCES)
    + """SELECT CASE shape WHEN 4 THEN 'one_word' WHEN 5 THEN 'colon' WHEN 6 THEN 'one_word' ELSE 'foreign_only' END AS code,
  count(*) AS n
FROM src WHERE shape IN (4, 5, 6, 8) GROUP BY 1""",
)
def reject_summary(spark, sf_dir):
    _, rej = W.parse_pages(render_pages(spark, sf_dir))
    return metrics.reject_summary(rej)


@register(
    "suggest_descriptions",
    with_(SQL_SOURCES)
    + f"""SELECT CASE shape WHEN 5 THEN 'colon' WHEN 8 THEN 'foreign_only' ELSE 'one_word' END AS code,
  CASE shape WHEN 5 THEN 'File:' || t || '.jpg' WHEN 8 THEN NULL ELSE t END AS parsed_name,
  CASE shape WHEN 5 THEN descr WHEN 8 THEN NULL ELSE 'buyer' END AS parsed_description,
  CASE shape WHEN 5 THEN descr WHEN 8 THEN NULL WHEN 6 THEN {SUGGESTION_SQL} ELSE 'buyer' END AS suggested_description,
  CASE WHEN shape = 6 THEN grp END AS parent_item
FROM src WHERE shape IN (4, 5, 6, 8)""",
)
def suggest_descriptions(spark, sf_dir):
    _, rej = W.parse_pages(render_pages(spark, sf_dir))
    return rej.select("code", "parsed_name", "parsed_description", "suggested_description", "parent_item")


def _corrections(rej):
    """Fix every one-word reject by accepting the suggestion; fix file links by
    typing the name inside them; leave the rest (skip)."""
    name = F.when(F.col("code") == "colon", F.regexp_extract("parsed_name", r"^File:(.*)\.jpg$", 1)).otherwise(F.lit(""))
    action = F.when(F.col("code").isin("one_word", "colon"), F.lit("fix")).otherwise(F.lit("skip"))
    return rej.select("page_id", "line_no", action.alias("action"), name.alias("name"), F.lit("").alias("description"))


@register(
    "corrections",
    with_(SQL_SOURCES)
    + f"""SELECT t AS name, t AS article_title, d AS death_date,
  CASE shape WHEN 4 THEN 'buyer' WHEN 5 THEN descr ELSE {SUGGESTION_SQL} END AS description
FROM src WHERE shape IN (4, 5, 6)""",
)
def corrections(spark, sf_dir):
    _, rej = W.parse_pages(render_pages(spark, sf_dir))
    # The rejects feed both sides of the corrections join: parse once, reliably checkpointed.
    rej = cut_lineage(rej)
    fixed = W.apply_corrections(rej, _corrections(rej))
    return fixed.select("name", "article_title", "death_date", "description")


@register(
    "parse_pages_round_trip",
    with_(
        SQL_SOURCES,
        f"ok AS (SELECT *, n2 AS c_name_sp FROM src WHERE shape IN (0, 1, 2, 3, 7) "
        f"AND d BETWEEN DATE '{COLLECT_START}' AND DATE '{COLLECT_END}')",
        f"ent AS ({ENTITIES_SQL.replace('FROM ok', ', okey FROM ok')})",
        """v AS (SELECT 'Person_' || CAST(l_orderkey AS VARCHAR) AS article, CAST(l_shipdate AS DATE) AS day,
         CAST(l_quantity AS BIGINT) AS views FROM lineitem)""",
    )
    + """SELECT e.name, e.death_date, e.description, CAST(sum(v.views) AS BIGINT) AS pageviews
FROM ent e JOIN v ON v.article = replace(e.article_title, ' ', '_')
  AND v.day BETWEEN e.death_date - 1 AND e.death_date + 58
GROUP BY e.okey, e.name, e.death_date, e.description""",
)
def parse_pages_round_trip(spark, sf_dir):
    """T4 end to end: pages in range -> parse -> date filter -> 60-day views -> drop missing."""
    li = B.table(spark, sf_dir, "lineitem")
    views = pageviews.daily_views(
        li.select(
            F.concat(F.lit("Person_"), F.col("l_orderkey").cast("string")).alias("article"),
            F.to_date("l_shipdate").alias("day"),
            F.col("l_quantity").cast("bigint").alias("views"),
        )
    )
    ent, _ = ingest.collect_entities(render_pages(spark, sf_dir), views, COLLECT_START, COLLECT_END)
    return ent.select("name", "death_date", "description", "pageviews")


@register(
    "month_pages",
    with_(SQL_SOURCES)
    + f"""SELECT 'Deaths in ' || strftime(d, '%B %Y') AS title, count(DISTINCT block) AS pages
FROM src WHERE d BETWEEN DATE_TRUNC('month', DATE '{PAGES_START}') AND DATE '{PAGES_END}'
GROUP BY 1""",
)
def month_pages(spark, sf_dir):
    pages = render_pages(spark, sf_dir)
    got = W.month_pages(pages, W.month_starts(spark, PAGES_START, PAGES_END))
    return got.groupBy("title").agg(F.count(F.lit(1)).alias("pages"))
