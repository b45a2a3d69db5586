"""DuckDB snippets for the answer-parsing rules (the SQL side of X19-X21)."""

from __future__ import annotations

CONV_REQ = """conv AS (
  SELECT conv_id, turn, role, text,
         lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
         lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text
  FROM conversations),
req AS (
  SELECT conv_id, turn, text AS prompt,
         CASE WHEN next_role = 'assistant' THEN next_text END AS answer,
         CAST(row_number() OVER (ORDER BY conv_id, turn) - 1 AS BIGINT) AS position,
         CAST(row_number() OVER (ORDER BY conv_id, turn) - 1 AS VARCHAR) AS request_id
  FROM conv WHERE role = 'user')"""


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _flags(x: str) -> tuple[str, str]:
    norm = f"lower({strip(f'coalesce({x}, {chr(39)}{chr(39)})')})"
    return f"contains({norm}, 'yes')", f"contains({norm}, 'no')"


def knows(x: str) -> str:
    y, n = _flags(x)
    return f"(CASE WHEN {y} AND {n} THEN NULL WHEN {y} THEN FALSE WHEN {n} THEN TRUE END)"


def error(x: str) -> str:
    y, n = _flags(x)
    raw = f"coalesce({x}, '')"
    return (
        f"(CASE WHEN {y} AND {n} THEN 'Ambiguous response (contains both ''yes'' and ''no''): ''' || {raw} || ''''"
        f" WHEN NOT {y} AND NOT {n} THEN 'Invalid response (no ''yes'' or ''no'' found): ''' || {raw} || '''' END)"
    )


def response(x: str) -> str:
    """Answer, or '<answer> (parse error: <msg>)'."""
    e = error(x)
    return f"(CASE WHEN {e} IS NULL THEN coalesce({x}, '') ELSE coalesce({x}, '') || ' (parse error: ' || {e} || ')' END)"
