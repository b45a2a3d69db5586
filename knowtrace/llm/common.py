"""What the operators of this package share: word patterns, written intermediate tables, checked joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowtrace.session import work_path

#: A word is a run of characters other than these six, a gap a run of these six.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

#: Rows up to which a table is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    """The words of a text as array<string>; null and blank texts give an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pinned(df: DataFrame, kind: str) -> DataFrame:
    """Write a table to the shared work folder and read it back: cuts lineage, survives lost executors."""
    path = work_path(df.sparkSession, kind) + "/t"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checked(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table, marked for broadcast when its counted rows are few enough; otherwise as it is."""
    return F.broadcast(df) if df.count() <= max_rows else df


def blob_buckets(df: DataFrame, text_col: str, bytes_each: int = 16 << 20) -> int:
    """Buckets that hold ``bytes_each`` of text each, at least the session's shuffle partitions."""
    total = df.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // bytes_each))
