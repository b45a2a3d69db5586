"""Registered queries: CSV round trip, run labels and run comparison, number
labels, resume by month, text report (S1, S2, K1, K2, K4-K6, U1-U3, J4,
X22, X23, X28, T3, C6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from knowtrace.functions import labels as L
from knowtrace.functions.core import month_key
from knowtrace.operators import ingest, ledger, metrics, report, select
from knowtrace.plans import bindings as B
from knowtrace.plans.catalog import register
from knowtrace.plans.oracle import MONTHLY, RESULTS, with_
from knowtrace.plans.q_requests import PRIORITY_MODELS
from knowtrace.plans.q_wikitext import ENTITIES_SQL
from knowtrace.plans.render import SQL_SOURCES, render_pages
from knowtrace.session import cut_lineage, work_path
from knowtrace.sources import csv_io

RESUME_EXISTING_BEFORE = "1998-01-01"
RESUME_START, RESUME_END = "1997-07-01", "1999-12-31"
PENDING_START, PENDING_END = "1994-06-01", "2002-03-31"

# Run parameters per order priority (each priority plays one model run).
RUN_MIN_VIEWS = {"1-URGENT": 500_000, "2-HIGH": 1_500_000, "3-MEDIUM": 2_000_000, "4-NOT SPECIFIED": 999_500, "5-LOW": None}
# Expected parse of those names (Python title-case/upper-case rules, read off by hand).
RUN_TITLES = {
    "1-URGENT": ("Gemini 3 Pro Preview", "All deaths with minimum 500 thousand views"),
    "2-HIGH": ("Gemini 3 Flash Preview", "All deaths with minimum 1.5 million views"),
    "3-MEDIUM": ("Claude Opus 4 5", "All deaths with minimum 2 million views"),
    "4-NOT SPECIFIED": ("GPT 5.2", "All deaths with minimum 1000 thousand views"),
    "5-LOW": ("O3Mini High", "Knowledge of deaths by month"),
}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _results_with_text(spark, sf_dir):
    """Results whose text fields carry commas, quotes and newlines."""
    o = B.table(spark, sf_dir, "orders")
    r = B.results(spark, sf_dir)
    return r.join(o.select(F.col("o_orderkey").alias("row_key"), "o_orderpriority"), "row_key").select(
        "name",
        "death_date",
        F.concat(F.lit("customer "), F.col("description"), F.lit(", order")).alias("description"),
        "pageviews",
        "knows",
        F.concat(F.lit('Answer "'), F.col("o_orderpriority"), F.lit('", then\nmore')).alias("response"),
    )


@register(
    "csv_round_trip",
    with_(RESULTS)
    + """SELECT r.name, r.death_date, 'customer ' || r.description || ', order' AS description, r.pageviews, r.knows,
  'Answer "' || o.o_orderpriority || '", then' || chr(10) || 'more' AS response
FROM results r JOIN orders o ON o.o_orderkey = r.row_key""",
)
def csv_round_trip(spark, sf_dir):
    """K2 then S1: every field quoted, quotes doubled, embedded newlines kept, tri-state exact."""
    path = work_path(spark, "csv_round_trip")
    csv_io.write_results(_results_with_text(spark, sf_dir), path)
    back = csv_io.read_results(spark, path)
    return back.select("name", "death_date", "description", "pageviews", "knows", "response")


@register(
    "mixed_headers",
    with_(RESULTS) + "SELECT name, death_date, CASE WHEN row_key % 3 = 0 THEN '' ELSE description END AS description, pageviews, knows FROM results",
)
def mixed_headers(spark, sf_dir):
    """Files of one folder with two headers (other column order, one column absent, one more) are read by their own."""
    path = work_path(spark, "mixed_headers")
    r = B.results(spark, sf_dir).select("name", "death_date", "description", "pageviews", "knows", F.lit("").alias("response"), "row_key")
    csv_io.write_results(r.where("row_key % 3 <> 0").drop("row_key"), path)
    knows = F.when(F.col("knows"), "True").when(~F.col("knows"), "False").otherwise("")
    other = r.where("row_key % 3 = 0").select(knows.alias("llm_knows_death"), F.lit("x, y").alias("note"), F.col("pageviews").cast("string").alias("pageviews"), "name", F.col("death_date").cast("string").alias("death_date"))
    other.write.mode("append").options(**csv_io.WRITE_OPTS).csv(path)
    return csv_io.read_results(spark, path).select("name", "death_date", "description", "pageviews", "knows")


@register(
    "file_order_ties",
    with_(RESULTS)
    + """SELECT name, month, rank, 0::BIGINT AS breaks FROM (
  SELECT name, strftime(death_date, '%Y-%m') AS month, CAST(row_number() OVER (PARTITION BY strftime(death_date, '%Y-%m') ORDER BY pageviews // 100000 DESC, death_date, row_key) AS BIGINT) AS rank
  FROM results) t WHERE rank <= 10""",
)
def file_order_ties(spark, sf_dir):
    """K1/O1, then W2 over S2 (D2): equal views keep the order of the sorted files; what lies there is in order."""
    path = work_path(spark, "file_order")
    r = B.results(spark, sf_dir).select("name", "death_date", "description", F.floor(F.col("pageviews") / 100_000).cast("long").alias("pageviews"), "row_key")
    csv_io.write_entities(r, path, tie="row_key")
    breaks = csv_io.order_breaks(spark, path).agg(F.count(F.lit(1)).alias("breaks"))
    top = select.top_n(csv_io.read_entities(spark, path, order=True), "month", 10, ["file_order"])
    return top.select("name", month_key("death_date").alias("month"), "rank").join(F.broadcast(breaks))


def _run_label_col():
    model = None
    mv = None
    for p, m in PRIORITY_MODELS:
        cond = F.col("o_orderpriority") == p
        model = F.when(cond, F.lit(m)) if model is None else model.when(cond, F.lit(m))
        v = RUN_MIN_VIEWS[p]
        lit = F.lit(v).cast("bigint") if v is not None else F.lit(None).cast("bigint")
        mv = F.when(cond, lit) if mv is None else mv.when(cond, lit)
    return L.run_label(model, F.lit("1995-01-01"), F.lit("2001-12-31"), top_per_month=F.lit(0), min_views=mv)


def _case(col: str, mapping: dict[str, str]) -> str:
    return f"CASE {col} " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in mapping.items()) + " END"


@register(
    "compare_runs",
    with_(RESULTS)
    + f"""SELECT {_case('o.o_orderpriority', {k: v[0] for k, v in RUN_TITLES.items()})} AS model,
  {_case('o.o_orderpriority', {k: v[1] for k, v in RUN_TITLES.items()})} AS subtitle,
  strftime(r.death_date, '%Y-%m') AS month,
  count(*) FILTER (WHERE knows) AS correct, count(*) FILTER (WHERE NOT knows) AS incorrect,
  count(*) FILTER (WHERE knows IS NULL) AS unknown, count(*) AS total,
  CAST(count(*) FILTER (WHERE knows) AS DOUBLE) / nullif(count(*) FILTER (WHERE knows IS NOT NULL), 0) * 100 AS accuracy
FROM results r JOIN orders o ON o.o_orderkey = r.row_key
GROUP BY 1, 2, 3""",
)
def compare_runs(spark, sf_dir):
    """K6 + T3: write one run per priority as ``run=<label>`` partitions, read them
    all back, parse model and subtitle from the run name, accuracy by (model, month)."""
    o = B.table(spark, sf_dir, "orders")
    r = B.results(spark, sf_dir).join(o.select(F.col("o_orderkey").alias("row_key"), "o_orderpriority"), "row_key")
    runs = r.select("name", "death_date", "description", "pageviews", "knows", F.lit("").alias("response"), _run_label_col().alias("run"))
    path = work_path(spark, "runs")
    csv_io.write_results(runs, path)
    back = csv_io.read_results(spark, path)
    dims = ingest.with_run_dimensions(back)
    return metrics.accuracy_by(dims, ["model", "subtitle", "month"])


def _compact_sql(x: str) -> str:
    return (
        f"(CASE WHEN {x} >= 1000000 THEN replace(printf('%.1f', {x} / 1000000.0) || ' million', '.0 million', ' million')"
        f" WHEN {x} >= 1000 THEN printf('%.0f', {x} / 1000.0) || ' thousand' ELSE CAST({x} AS VARCHAR) END)"
    )


@register(
    "number_labels",
    with_(RESULTS)
    + f"""SELECT strftime(death_date, '%Y-%m') AS month, CAST(sum(pageviews) AS BIGINT) AS total_views,
  {_compact_sql('sum(pageviews)')} AS total_label, {_compact_sql('min(pageviews)')} AS min_label,
  {_compact_sql('max(pageviews)')} AS max_label, {_compact_sql('avg(pageviews)::BIGINT * 3')} AS scaled_label
FROM results GROUP BY 1""",
)
def number_labels(spark, sf_dir):
    """X22 on per-month view aggregates (exact Python rounding, ties included)."""
    r = B.results(spark, sf_dir)
    agg = r.groupBy(month_key("death_date").alias("month")).agg(
        F.sum("pageviews").alias("total_views"),
        F.min("pageviews").alias("mn"),
        F.max("pageviews").alias("mx"),
        F.avg("pageviews").alias("av"),
    )
    return agg.select(
        "month",
        F.col("total_views").cast("bigint").alias("total_views"),
        L.compact_number("total_views").alias("total_label"),
        L.compact_number("mn").alias("min_label"),
        L.compact_number("mx").alias("max_label"),
        L.compact_number(F.round("av").cast("bigint") * 3).alias("scaled_label"),
    )


@register(
    "file_labels",
    with_(
        RESULTS,
        f"""g AS (
  SELECT o.o_orderpriority AS prio, {_case('o.o_orderpriority', dict(PRIORITY_MODELS))} AS model,
         min(r.death_date) AS d, count(*) AS n,
         CASE WHEN o.o_orderpriority = '5-LOW' THEN NULL ELSE min(r.pageviews) * 100 END AS mv
  FROM results r JOIN orders o ON o.o_orderkey = r.row_key GROUP BY o.o_orderpriority)""",
    )
    + f"""SELECT replace(replace(model, '/', '-'), ':', '-') || '_' || CAST(d AS VARCHAR) || '_to_' || CAST(d AS VARCHAR)
    || '_topmonth-' || CASE WHEN n % 7 > 0 THEN CAST(n % 7 AS VARCHAR) ELSE 'all' END
    || '_minviews-' || coalesce(CAST(mv AS VARCHAR), 'none') || '.csv' AS label,
  {_case('prio', {k: v[0] for k, v in RUN_TITLES.items()})} AS model,
  CASE WHEN mv IS NULL THEN 'Knowledge of deaths by month'
       ELSE 'All deaths with minimum ' || {_compact_sql('mv')} || ' views' END AS subtitle
FROM g""",
)
def file_labels(spark, sf_dir):
    """K6 names built from per-run aggregates, then parsed back."""
    o = B.table(spark, sf_dir, "orders")
    r = B.results(spark, sf_dir).join(o.select(F.col("o_orderkey").alias("row_key"), "o_orderpriority"), "row_key")
    model = None
    for p, m in PRIORITY_MODELS:
        cond = F.col("o_orderpriority") == p
        model = F.when(cond, F.lit(m)) if model is None else model.when(cond, F.lit(m))
    g = r.groupBy("o_orderpriority").agg(
        F.min("death_date").alias("d"), F.count(F.lit(1)).alias("n"), F.min("pageviews").alias("minpv")
    )
    mv = F.when(F.col("o_orderpriority") == "5-LOW", F.lit(None).cast("bigint")).otherwise(F.col("minpv") * 100)
    g = g.withColumn("model", model).withColumn("mv", mv)
    label = L.run_label("model", F.col("d"), F.col("d"), top_per_month=F.col("n") % 7, min_views="mv")
    g = g.withColumn("label", label)
    return g.select("label", L.model_title("label").alias("model"), L.views_subtitle("label").alias("subtitle"))


def _months_sql(start: str, end: str) -> str:
    return (
        f"SELECT strftime(m, '%Y-%m') AS month_key FROM generate_series(DATE_TRUNC('month', DATE '{start}'), "
        f"DATE '{end}', INTERVAL 1 MONTH) AS g(m)"
    )


@register(
    "pending_months",
    _months_sql(PENDING_START, PENDING_END)
    + " EXCEPT SELECT DISTINCT strftime(CAST(o_orderdate AS DATE), '%Y-%m') FROM orders",
)
def pending_months(spark, sf_dir):
    """Months of the range not present in the existing output (the orders)."""
    todo = ingest.pending_months(spark, PENDING_START, PENDING_END, B.entities(spark, sf_dir))
    return todo.select("month_key")


@register(
    "resume_union",
    with_(
        RESULTS,
        SQL_SOURCES,
        f"""ok AS (SELECT *, n2 AS c_name_sp FROM src WHERE shape IN (0, 1, 2, 3, 7)
  AND d BETWEEN DATE '{RESUME_EXISTING_BEFORE}' AND DATE '{RESUME_END}')""",
        f"ent AS ({ENTITIES_SQL.replace('FROM ok', ', okey FROM ok')})",
        """v AS (SELECT 'Person_' || CAST(l_orderkey AS VARCHAR) AS article, CAST(l_shipdate AS DATE) AS day,
         CAST(l_quantity AS BIGINT) AS views FROM lineitem)""",
    )
    + f"""SELECT name, death_date, description, pageviews FROM results WHERE death_date < DATE '{RESUME_EXISTING_BEFORE}'
UNION ALL SELECT e.name, e.death_date, e.description, CAST(sum(v.views) AS BIGINT)
FROM ent e JOIN v ON v.article = replace(e.article_title, ' ', '_')
  AND v.day BETWEEN e.death_date - 1 AND e.death_date + 58
GROUP BY e.okey, e.name, e.death_date, e.description""",
)
def resume_union(spark, sf_dir):
    """The existing output covers every month before 1998; a run for
    mid-1997..1999 collects only 1998-1999 from the pages and keeps the rest."""
    existing = B.results(spark, sf_dir).where(F.col("death_date") < F.lit(RESUME_EXISTING_BEFORE))
    existing = existing.select("name", "death_date", "description", "pageviews")
    views = B.person_views(spark, sf_dir)
    out = ingest.ingest_months(render_pages(spark, sf_dir), views, existing, RESUME_START, RESUME_END)
    # K1/K5 then S2: the merged table is written as the versioned entity CSV and read back.
    base = work_path(spark, "resume") + "/deaths.csv"
    csv_io.write_entities(out, base, version="1.0")
    back = csv_io.read_entities(spark, csv_io.versioned_path(base, "1.0"))
    return back.select("name", "death_date", "description", "pageviews")


@register(
    "month_ledger",
    with_(
        SQL_SOURCES,
        "ok AS (SELECT *, n2 AS c_name_sp FROM src WHERE shape IN (0, 1, 2, 3, 7))",
        f"ent AS ({ENTITIES_SQL.replace('FROM ok', ', okey FROM ok')})",
        """v AS (SELECT 'Person_' || CAST(l_orderkey AS VARCHAR) AS article, CAST(l_shipdate AS DATE) AS day,
         CAST(l_quantity AS BIGINT) AS views FROM lineitem)""",
        """totals AS (SELECT e.death_date, CAST(sum(v.views) AS BIGINT) AS pageviews
FROM ent e JOIN v ON v.article = replace(e.article_title, ' ', '_') AND v.day BETWEEN e.death_date - 1 AND e.death_date + 58
GROUP BY e.okey, e.name, e.death_date, e.description)""",
        f"months AS ({_months_sql(PENDING_START, PENDING_END)})",
    )
    + """SELECT month_key, count(pageviews) AS rows, CAST(coalesce(sum(pageviews), 0) AS BIGINT) AS views, CASE WHEN month_key < '1998-01' THEN 1 ELSE 2 END AS run
FROM months LEFT JOIN totals ON strftime(death_date, '%Y-%m') = month_key GROUP BY month_key""",
)
def month_ledger(spark, sf_dir):
    """K4 with a ledger: a run up to 1997, one that ends before it commits, and one over the whole range."""
    path = work_path(spark, "month_ledger")
    pages, views = cut_lineage(render_pages(spark, sf_dir)), B.person_views(spark, sf_dir)  # rendered once for both runs
    first = ledger.collect_months(pages, views, path, PENDING_START, "1997-12-31")
    ledger.write_rows(ledger.read_months(spark, path, "1996-01-01", "1996-12-31"), path, "uncommitted")
    ledger.collect_months(pages, views, path, PENDING_START, PENDING_END)
    rows = ledger.read_months(spark, path).groupBy(month_key("death_date").alias("month_key")).agg(F.count(F.lit(1)).alias("n"), F.sum("pageviews").alias("views"))
    done = ledger.committed(spark, path).join(rows, "month_key", "left")
    run = F.when(F.col("run") == first, 1).otherwise(2)
    # what the ledger says, and nothing where what lies there differs
    return done.select("month_key", F.when(F.col("rows") == F.coalesce("n", F.lit(0)), F.col("rows")).alias("rows"), F.coalesce("views", F.lit(0)).alias("views"), run.alias("run"))


@register(
    "report_rows",
    with_(RESULTS, MONTHLY)
    + """SELECT 0 AS seq, 'overall' AS section, 'Total tested: ' || CAST(count(*) AS VARCHAR) AS text FROM results
UNION ALL SELECT 1, 'overall', '  Knows death: ' || CAST(count(*) FILTER (WHERE knows) AS VARCHAR) || ' ('
  || printf('%.1f', CAST(count(*) FILTER (WHERE knows) AS DOUBLE) / count(*) * 100) || '%)' FROM results
UNION ALL SELECT 2, 'overall', '  Doesn''t know: ' || CAST(count(*) FILTER (WHERE NOT knows) AS VARCHAR) || ' ('
  || printf('%.1f', CAST(count(*) FILTER (WHERE NOT knows) AS DOUBLE) / count(*) * 100) || '%)' FROM results
UNION ALL SELECT 3, 'overall', '  Errors: ' || CAST(count(*) FILTER (WHERE knows IS NULL) AS VARCHAR) || ' ('
  || printf('%.1f', CAST(count(*) FILTER (WHERE knows IS NULL) AS DOUBLE) / count(*) * 100) || '%)' FROM results
  HAVING count(*) FILTER (WHERE knows IS NULL) > 0
UNION ALL SELECT CASE WHEN knows THEN 10 ELSE 11 END, 'stats', CASE WHEN knows THEN '  Deaths model KNOWS (n=' ELSE '  Deaths model DOESN''T KNOW (n=' END
  || CAST(count(*) AS VARCHAR) || '): Min: ' || format('{:,}', min(pageviews)) || '  Max: ' || format('{:,}', max(pageviews))
  || '  Mean: ' || format('{:,.0f}', avg(pageviews)) || '  Median: ' || format('{:,.0f}', CAST(median(pageviews) AS DOUBLE))
  FROM results WHERE knows IS NOT NULL GROUP BY knows
UNION ALL SELECT 99 + row_number() OVER (ORDER BY month), 'month', '  ' || month || ': ' || CASE WHEN accuracy IS NULL THEN 'N/A' ELSE printf('%.1f', accuracy) || '%' END
  || ' (' || CAST(correct AS VARCHAR) || '/' || CAST(correct + incorrect AS VARCHAR) || ' known)' FROM monthly""",
)
def report_rows(spark, sf_dir):
    """The text report (overall, view statistics per outcome, by month) as rows."""
    return report.recall_report(B.results(spark, sf_dir))["report_rows"]
