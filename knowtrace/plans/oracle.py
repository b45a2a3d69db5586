"""DuckDB SQL that states, independently of the Spark code, what each registered
query must return.  Tables are the driver's views (``orders``, ``lineitem``, ...).

Parity rules (SURVEY 5.3): counts are BIGINT on both sides, a zero
denominator gives NULL, averages are rounded to 6 decimals and bin edges to 4,
every output column is aliased to the same name as the Spark query.
"""

from __future__ import annotations

# Shared CTE bodies ---------------------------------------------------------

RESULTS = """results AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS name,
         CAST(o_orderdate AS DATE) AS death_date,
         'customer ' || CAST(o_custkey AS VARCHAR) || ' order' AS description,
         CAST(floor(o_totalprice) AS BIGINT) AS pageviews,
         CASE o_orderstatus WHEN 'F' THEN TRUE WHEN 'O' THEN FALSE END AS knows,
         o_orderkey AS row_key
  FROM orders)"""

TRI = """count(*) FILTER (WHERE knows) AS correct,
  count(*) FILTER (WHERE NOT knows) AS incorrect,
  count(*) FILTER (WHERE knows IS NULL) AS unknown,
  count(*) AS total,
  CAST(count(*) FILTER (WHERE knows) AS DOUBLE)
    / nullif(count(*) FILTER (WHERE knows IS NOT NULL), 0) * 100 AS accuracy"""

MONTHLY = f"""monthly AS (
  SELECT strftime(death_date, '%Y-%m') AS month, {TRI}
  FROM results GROUP BY 1)"""

DAILY = f"""daily AS (
  SELECT strftime(death_date, '%Y-%m-%d') AS day, {TRI}
  FROM results GROUP BY 1)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
