"""Registered queries: one per operator family of SURVEY section 2.

Every query reads the driver tables under ``sf_dir`` (whole tables, no
sampling) through :mod:`knowtrace.plans.bindings` and returns a lazy
DataFrame.  The matching DuckDB statement sits next to it so a reader can
check both at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


# Import the query modules for their registrations (order = SURVEY order).
def _load() -> None:
    from knowtrace.plans import q_metrics  # noqa: F401
    from knowtrace.plans import q_windows  # noqa: F401
    from knowtrace.plans import q_requests  # noqa: F401
    from knowtrace.plans import q_wikitext  # noqa: F401
    from knowtrace.plans import q_io  # noqa: F401
    from knowtrace.plans import q_stream  # noqa: F401


_loaded = False


def queries() -> dict[str, QueryFn]:
    global _loaded
    if not _loaded:
        _load()
        _loaded = True
    return dict(REGISTRY)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLE)

