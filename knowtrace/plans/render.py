"""Render monthly death-list pages from ``orders x customer x nation`` (test binding).

The driver ships no wiki text, so pages are rendered in-query from real rows
and then parsed back; SQL over the same source rows states what the parse
must return.  One page = one month x one block of 64 consecutive order keys,
so every page (and every window partition of the parser) is bounded no matter
how large the tables grow or how skewed customers are.

Each order renders one entry in one of ten shapes (``o_orderkey % 10``):
0 plain, 1 piped link + age range + parenthesised comma, 2 leading comment +
inner link, 3 no age, 4 one-word description, 5 file link (colon),
6 sub-item under a group header, 7 sub-item after a blank line (standalone),
8 inter-language template, 9 no link at all (ignored).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knowtrace.functions.wikitext import month_title
from knowtrace.plans.bindings import table

BLOCK = 64


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    oc = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, F.col("c_nationkey") == n["n_nationkey"])
    d = F.to_date("o_orderdate")
    return oc.select(
        F.col("o_orderkey").alias("okey"),
        d.alias("d"),
        F.year(d).alias("year"),
        F.month(d).alias("month"),
        F.dayofmonth(d).alias("day"),
        F.floor(F.col("o_orderkey") / BLOCK).cast("bigint").alias("block"),
        F.concat(F.lit("Person "), F.col("o_orderkey").cast("string")).alias("t"),
        F.replace(F.col("c_name"), F.lit("#"), F.lit(" ")).alias("n2"),
        (F.lit(20) + F.col("o_custkey") % 70).cast("int").alias("age"),
        F.col("n_name").alias("nat"),
        F.lower("c_mktsegment").alias("seg"),
        F.col("c_mktsegment").alias("kind"),
        (F.col("o_custkey") % 3).cast("int").alias("hform"),
        F.col("o_orderpriority").alias("prio"),
        (F.col("o_orderkey") % 10).cast("int").alias("shape"),
    )


def _desc() -> Column:
    return F.concat_ws(" ", F.col("nat"), F.col("seg"), F.lit("buyer"))


def _group_header() -> Column:
    """Three header forms (``o_custkey % 3``): plural, singular description, 'people'."""
    k, nat, f = F.col("kind"), F.col("nat"), F.col("hform")
    return (
        F.when(f == 0, F.concat(F.lit("* Notable "), k, F.lit("s killed in the "), nat, F.lit(" crash:")))
        .when(f == 1, F.concat(F.lit("* "), k, F.lit(" market buyer killed in the "), nat, F.lit(" crash:")))
        .otherwise(F.concat(F.lit("* "), k, F.lit(" people killed in the "), nat, F.lit(" attack:")))
    )


def entry_lines() -> Column:
    """array<string>: the lines one order contributes (1 to 3)."""
    t, age = F.col("t"), F.col("age").cast("string")
    s = F.col("shape")
    one = lambda *parts: F.array(F.concat(*parts))
    return (
        F.when(s == 0, one(F.lit("* [["), t, F.lit("]], "), age, F.lit(", "), _desc(), F.lit(", "), F.col("prio"), F.lit(".")))
        .when(
            s == 1,
            one(
                F.lit("* [["), t, F.lit("|"), F.col("n2"), F.lit("]], "), age, F.lit("–"), (F.col("age") + 1).cast("string"),
                F.lit(", "), _desc(), F.lit(" (since "), F.col("year").cast("string"), F.lit(", active), "), F.col("prio"),
            ),
        )
        .when(
            s == 2,
            one(
                F.lit("* <!--D-->[["), t, F.lit("]], "), age, F.lit(", [["), F.col("nat"), F.lit("|"), F.col("nat"),
                F.lit("]] "), F.col("seg"), F.lit(" buyer"),
            ),
        )
        .when(s == 3, one(F.lit("* [["), t, F.lit("]], "), _desc()))
        .when(s == 4, one(F.lit("* [["), t, F.lit("]], "), age, F.lit(", buyer.")))
        .when(s == 5, one(F.lit("* [[File:"), t, F.lit(".jpg]], "), age, F.lit(", "), _desc()))
        .when(s == 6, F.array(_group_header(), F.concat(F.lit("** [["), t, F.lit("]], "), age, F.lit(", buyer"))))
        .when(
            s == 7,
            F.array(_group_header(), F.lit(""), F.concat(F.lit("** [["), t, F.lit("]], "), age, F.lit(", "), _desc())),
        )
        .when(s == 8, one(F.lit("* {{ill|"), t, F.lit("|de}}, "), age, F.lit(", [["), F.col("nat"), F.lit("]] buyer")))
        .otherwise(one(F.lit("* "), t, F.lit(" (no article), "), age, F.lit(", "), _desc()))
    )


def render_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, title, year, month, text`` - one row per (month, key block)."""
    src = _sources(spark, sf_dir)
    page = F.concat(F.format_string("%04d-%02d", F.col("year"), F.col("month")), F.lit("/"), F.col("block").cast("string"))
    items = src.select(
        page.alias("page_id"),
        "year",
        "month",
        "day",
        "okey",
        F.posexplode(entry_lines()).alias("k", "text"),
    )
    grouped = items.groupBy("page_id", "year", "month").agg(
        F.sort_array(F.collect_list(F.struct("day", "okey", "k", "text"))).alias("items")
    )

    def header(day):
        d = day.cast("string")
        return F.when(day % 2 == 0, F.concat(F.lit("=="), d, F.lit("=="))).otherwise(
            F.concat(F.lit("=== "), d, F.lit(" ==="))
        )

    # A day header goes before the first line of each day (items are sorted by day).
    body = F.flatten(
        F.transform(
            "items",
            lambda x, i: F.when(
                (i == 0) | (x.getField("day") != F.get(F.col("items"), i - 1).getField("day")),
                F.array(header(x.getField("day")), x.getField("text")),
            ).otherwise(F.array(x.getField("text"))),
        )
    )
    intro = F.array(
        F.lit("{{Short description|None}}"),
        F.concat(F.lit("The following notable deaths occurred in "), month_title("year", "month"), F.lit(".")),
        F.concat(F.lit("* [[Intro "), F.col("page_id"), F.lit("]], 40, listed before the first day")),
    )
    end_head = F.when(F.col("month") % 2 == 0, F.lit("== References ==")).otherwise(F.lit("==See also=="))
    outro = F.array(end_head, F.lit("* [[After end]], 40, Danish painter"), F.lit("{{reflist}}"))
    text = F.array_join(F.concat(intro, body, outro), "\n")
    return grouped.select("page_id", month_title("year", "month").alias("title"), "year", "month", text.alias("text"))


# --- the same rendering stated in SQL, for the oracles -------------------------

SQL_SOURCES = f"""src AS (
  SELECT o.o_orderkey AS okey, CAST(o.o_orderdate AS DATE) AS d,
         year(o.o_orderdate) AS year, month(o.o_orderdate) AS month, day(o.o_orderdate) AS day,
         o.o_orderkey // {BLOCK} AS block,
         'Person ' || CAST(o.o_orderkey AS VARCHAR) AS t,
         replace(c.c_name, '#', ' ') AS n2,
         CAST(20 + o.o_custkey % 70 AS INTEGER) AS age,
         n.n_name AS nat, lower(c.c_mktsegment) AS seg, o.o_orderpriority AS prio,
         CAST(o.o_orderkey % 10 AS INTEGER) AS shape,
         n.n_name || ' ' || lower(c.c_mktsegment) || ' buyer' AS descr,
         c.c_mktsegment AS kind,
         CASE o.o_custkey % 3
           WHEN 0 THEN '* Notable ' || c.c_mktsegment || 's killed in the ' || n.n_name || ' crash:'
           WHEN 1 THEN '* ' || c.c_mktsegment || ' market buyer killed in the ' || n.n_name || ' crash:'
           ELSE '* ' || c.c_mktsegment || ' people killed in the ' || n.n_name || ' attack:' END AS grp,
         CASE o.o_custkey % 3 WHEN 1 THEN c.c_mktsegment || ' market buyer' ELSE c.c_mktsegment || ' buyer' END
           AS suggestion
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey)"""

# Emitted lines (what the line-state windows must hand to the entry parser).
SQL_EMITTED = """emitted AS (
  SELECT okey, shape, d, year, month, day, t, descr, grp, nat, suggestion,
         CASE shape
           WHEN 0 THEN '* [[' || t || ']], ' || age || ', ' || descr || ', ' || prio || '.'
           WHEN 1 THEN '* [[' || t || '|' || n2 || ']], ' || age || '–' || (age + 1) || ', ' || descr
                       || ' (since ' || year || ', active), ' || prio
           WHEN 2 THEN '* <!--D-->[[' || t || ']], ' || age || ', [[' || nat || '|' || nat || ']] ' || seg || ' buyer'
           WHEN 3 THEN '* [[' || t || ']], ' || descr
           WHEN 4 THEN '* [[' || t || ']], ' || age || ', buyer.'
           WHEN 5 THEN '* [[File:' || t || '.jpg]], ' || age || ', ' || descr
           WHEN 6 THEN '** [[' || t || ']], ' || age || ', buyer'
           WHEN 7 THEN '** [[' || t || ']], ' || age || ', ' || descr
           WHEN 8 THEN '* {{ill|' || t || '|de}}, ' || age || ', [[' || nat || ']] buyer'
         END AS line,
         CASE WHEN shape = 6 THEN grp END AS parent_item
  FROM src WHERE shape <> 9)"""
