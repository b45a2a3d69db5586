"""Month pages -> entity rows and reject rows (T1, W5-W8, J5, S3, A8 input).

The reference walks each page line by line with a small state machine
(current day, stop at an end section, group header look-ahead, parent text
for sub-items).  Here a page stays one row and its text is cut where that
state changes, so no line is shuffled or sorted and a task holds one page at
a time, however many pages it reads:

* W6 ended   = the text is cut at its first end header
* W5 day     = it is split before each day header (not at other headings); what comes before the first has no day
* W7 grouped = a section is split before each worded line that is no sub-item, so a piece is such a line and the
  sub-items and blank lines after it; a top bullet is grouped if its piece holds a sub-item
* W8 parent  = the text of a grouped bullet, for its sub-items up to the first blank line

Lines are numbered before the cuts, as ``<number>:<line>``.  The entry chain
(X1-X14) then runs as plain column expressions on the emitted lines only.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knowtrace.functions import wikitext as X
from knowtrace.functions.core import PY_WS_CLASS, pystrip


# A line's number, white space within a line, and the day and end headers of numbered lines (as ``X.RE_DAY``, ``X.RE_END``).
_NO, _WS = r"[0-9]+:", r"[\s&&[^\n]]*"
_DAY_HEADER = rf"{_NO}==+{_WS}([0-9]{{1,2}}){_WS}==+"
_FROM_END = rf"(?iU)(?:^|\n){_NO}==+{_WS}(?:{'|'.join(X.END_SECTIONS)}){_WS}==+(?s:.*)"
_BEFORE_DAY = rf"(?U)\n(?={_DAY_HEADER})"
_BEFORE_WORDED = rf"\n(?!{_NO}(?:\*\*|{PY_WS_CLASS}*(?:\n|\z)))"


def _emitted(pages: DataFrame, page_id: str, year: str, month: str, text: str) -> DataFrame:
    """The lines the reference parses, page by page."""
    # Pages are spread first: the per-line regex work then runs in parallel whatever
    # the input layout (one small file is one task), and the shuffle moves page texts.
    numbered = F.transform(F.split(F.col(text), "\n", -1), lambda ln, i: F.concat((i + 1).cast("string"), F.lit(":"), ln))
    of_page = ["page_id", "year", "month"]
    df = pages.repartition(F.col(page_id)).select(
        F.col(page_id).alias("page_id"), F.col(year).alias("year"), F.col(month).alias("month"), F.array_join(numbered, "\n").alias("numbered")
    )
    df = df.withColumn("numbered", F.regexp_replace("numbered", _FROM_END, ""))
    df = df.select(*of_page, F.explode(F.split("numbered", _BEFORE_DAY, -1)).alias("section"))
    df = df.where(F.col("section").rlike(f"(?U)^{_DAY_HEADER}"))
    df = df.withColumn("day", F.regexp_extract("section", f"(?U)^{_DAY_HEADER}", 1).cast("int"))
    df = df.select(*of_page, "day", F.explode(F.split("section", _BEFORE_WORDED, -1)).alias("piece"))
    df = df.where(F.col("piece").contains("[["))
    head = F.substring_index("piece", "\n", 1)
    # sub-items before the first blank line, which ends the group
    linked = F.regexp_replace("piece", rf"\n{_NO}(?!\*\*)(?s:.*)", "")
    df = df.select(
        *of_page,
        "day",
        _after_number(head).alias("head"),
        F.col("piece").rlike(rf"\n{_NO}\*\*").alias("has_sub"),
        (F.length(linked) - F.length(F.replace(linked, F.lit("\n"), F.lit("")))).alias("linked"),
        F.split("piece", "\n", -1).alias("lines"),
    )
    df = df.select(*of_page, "day", X.is_top_bullet("head").alias("top"), "head", "has_sub", "linked", F.posexplode("lines").alias("pos", "numbered"))
    df = df.select(
        *of_page, "day", "top", "head", "has_sub", "linked", "pos",
        F.substring_index("numbered", ":", 1).cast("int").alias("line_no"), _after_number(F.col("numbered")).alias("line"),
    )
    sub = X.is_sub_bullet("line")
    parent = F.when(sub & F.col("top") & (F.col("pos") <= F.col("linked")), pystrip("head"))
    emit = F.col("line").contains("[[") & F.when(F.col("pos") == 0, F.col("top") & ~F.col("has_sub")).otherwise(sub)
    return df.where(emit).select(*of_page, "line_no", "line", "day", parent.alias("parent_item"), sub.alias("is_sub"))


def _after_number(numbered: Column) -> Column:
    return F.substring(numbered, F.instr(numbered, ":") + F.lit(1), F.length(numbered))


def page_lines(pages: DataFrame, page_id: str = "page_id", year: str = "year", month: str = "month", text: str = "text") -> DataFrame:
    """The lines the reference would hand to its entry parser, with day and parent.

    Output: ``page_id, year, month, line_no (1-based), line, day, parent_item, is_sub``.
    """
    return _emitted(pages, page_id, year, month, text)


def _staged(df: DataFrame, steps: list[tuple[str, object]]) -> DataFrame:
    """Apply ``(name, fn)`` steps, each reading the previous step's column.

    Every step is its own projection: the guarded rewrites read their input
    twice (marker test + rewrite), and a column reference there costs nothing
    where an inlined expression would be evaluated twice per level.
    """
    for name, fn in steps:
        df = df.withColumn(name, fn)
    return df


def _entry_columns(lines: DataFrame, fix_circa: bool = False) -> DataFrame:
    """X1-X12 on the emitted lines, staged over projections so each regex runs
    once per line.  The rows leave through a generator: it is a barrier for
    filter push-down, so later filters on the outcome read these columns
    instead of re-inlining the chain."""
    df = _staged(
        lines,
        [
            ("__e1", X.strip_bullets("line")),
            ("__e2", X.strip_comments("__e1")),
            ("__e3", X.strip_ext_links("__e2")),
            ("__entry", X.norm_circa("__e3")),
        ],
    )
    df = df.withColumn("__link", X.lead_link("__entry")).withColumn("__foreign", X.foreign_link("__e3"))
    ok = F.col("__link").getField("ok")
    after = F.col("__link").getField("rest")
    df = df.withColumn("__content", F.when(ok, X.has_content(after)))
    df = _staged(
        df,
        [
            ("__d0", F.when(F.col("__content"), after)),
            ("__d1", X.drop_age("__d0", fix_circa)),
            ("__d2", X.unwrap_links("__d1")),
            ("__d3", X.strip_markup("__d2")),
            ("__d4", X.trim_punct("__d3")),
            ("__pre", X.drop_year_range("__d4")),
            ("__cut", X.cut_index("__pre")),
            ("__desc", X.apply_cut("__pre", "__cut")),
        ],
    )
    row = F.struct(
        *lines.columns,
        "__entry",
        "__foreign",
        ok.alias("__link_ok"),
        F.when(ok, F.col("__link").getField("title")).alias("__title"),
        F.when(ok, F.col("__link").getField("name")).alias("__name"),
        "__content",
        "__desc",
    )
    return df.select(F.inline(F.array(row)))


def _finish(emitted: DataFrame) -> DataFrame:
    """X13-X16 on the emitted lines (date from the page's day, then the code)."""
    parsed = F.struct(
        F.col("__entry").alias("entry"),
        F.col("__foreign").alias("foreign"),
        F.col("__link_ok").alias("link_ok"),
        F.col("__title").alias("article_title"),
        F.col("__name").alias("name"),
        F.col("__content").alias("content"),
        F.col("__desc").alias("description"),
        X.page_date("year", "month", "day").alias("death_date"),
    )
    df = emitted.withColumn("__p", parsed)
    df = df.withColumn("code", X.entry_code(F.col("__p")))
    pf = lambda n: F.col("__p").getField(n)
    named = F.col("code").isin("ok", *X.NAME_CHECKED)
    return df.select(
        "page_id",
        "line_no",
        "line",
        "parent_item",
        "year",
        "month",
        "day",
        pf("name").alias("name"),
        pf("article_title").alias("article_title"),
        pf("death_date").alias("death_date"),
        pf("description").alias("description"),
        "code",
        F.when(F.col("code") == "foreign_only", F.lit("warning")).when(F.col("code") != "ok", F.lit("error")).alias(
            "severity"
        ),
        F.when(named, X.name_warnings(pf("name"))).otherwise(F.array().cast("array<string>")).alias("warnings"),
        F.when(named, pf("name")).alias("parsed_name"),
        F.when(named, pf("description")).alias("parsed_description"),
        F.when(named, X.suggest_description(pf("description"), "parent_item")).alias("suggested_description"),
    )


def parse_all(
    pages: DataFrame, page_id: str = "page_id", year: str = "year", month: str = "month", text: str = "text", fix_circa: bool = False
) -> DataFrame:
    """Every parsed line with its ``code`` ('ok' or the reject reason).

    ``fix_circa`` reads ``{{circa}} 73,`` as an age (D4); by default it becomes the description, as in the reference.
    """
    return _finish(_entry_columns(_emitted(pages, page_id, year, month, text), fix_circa))


ENTITY_COLS = ["name", "article_title", "death_date", "description", "page_id", "line_no", "parent_item", "warnings"]
REJECT_COLS = [
    "page_id",
    "line_no",
    "line",
    "parent_item",
    "code",
    "severity",
    "parsed_name",
    "parsed_description",
    "suggested_description",
    "year",
    "month",
    "day",
]


def parse_pages(pages: DataFrame, **cols: str | bool) -> tuple[DataFrame, DataFrame]:
    """``(entities, rejects)``; one ``code`` column splits a single parse."""
    parsed = parse_all(pages, **cols)
    return parsed.where(F.col("code") == "ok").select(*ENTITY_COLS), parsed.where(F.col("code") != "ok").select(*REJECT_COLS)


def apply_corrections(rejects: DataFrame, corrections: DataFrame) -> DataFrame:
    """The reference's interactive fix-up as a join with a corrections table.

    ``corrections``: ``page_id, line_no, action ('skip'|'fix'), name, description``.
    'skip' or no correction drops the reject; a blank name keeps the parsed
    name and a blank description keeps the suggestion (the parsed description
    when there is none); still-empty values or an impossible date drop the
    row.  Corrected rows use the name as article title, as the reference does.
    """
    c = corrections.select(
        F.col("page_id").alias("__pid"),
        F.col("line_no").alias("__ln"),
        F.col("action").alias("__action"),
        F.col("name").alias("__name"),
        F.col("description").alias("__desc"),
    )
    r = rejects.where(F.col("code").isin(*X.CORRECTABLE))
    j = r.join(c, (r["page_id"] == c["__pid"]) & (r["line_no"] == c["__ln"]), "inner").where(F.col("__action") == "fix")
    blank_to_null = lambda col: F.when(pystrip(col) != "", pystrip(col))
    name = F.coalesce(blank_to_null(F.col("__name")), F.col("parsed_name"))
    desc = F.coalesce(blank_to_null(F.col("__desc")), F.col("suggested_description"))
    date = X.page_date("year", "month", "day")
    out = j.select(
        name.alias("name"),
        name.alias("article_title"),
        date.alias("death_date"),
        desc.alias("description"),
        "page_id",
        "line_no",
        "parent_item",
    )
    return out.where(
        F.col("name").isNotNull() & (F.col("name") != "") & F.col("description").isNotNull() & (F.col("description") != "")
        & F.col("death_date").isNotNull()
    )


def month_starts(spark: SparkSession, start, end) -> DataFrame:
    """One row per month touched by ``[start, end]`` (``year, month, month_start``), ascending."""
    s = start if isinstance(start, _dt.date) else _dt.date.fromisoformat(str(start))
    e = end if isinstance(end, _dt.date) else _dt.date.fromisoformat(str(end))
    if s > e:
        raise ValueError("start date must not be after end date")
    seq = F.sequence(F.trunc(F.lit(s), "MM"), F.lit(e), F.expr("INTERVAL 1 MONTH"))
    m = spark.range(1).select(F.explode(seq).alias("month_start"))
    return m.select(F.year("month_start").alias("year"), F.month("month_start").alias("month"), "month_start")


def month_pages(pages: DataFrame, months: DataFrame, title: str = "title") -> DataFrame:
    """S3: pages whose title is the month title of a wanted month; a missing page gives no rows.

    ``months`` is small (one row per month of the range) and is broadcast.
    """
    wanted = months.select("year", "month", X.month_title("year", "month").alias("__title"))
    return pages.join(F.broadcast(wanted), pages[title] == wanted["__title"], "left_semi")


def reject_summary_by_page(rejects: DataFrame) -> DataFrame:
    """A8 as the reference prints it: one error count per page."""
    return rejects.groupBy("page_id").agg(F.count(F.lit(1)).alias("errors"))
