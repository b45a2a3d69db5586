"""JSONL request sink and response sources.

Files are read with ``spark.read.text`` (splittable, one row per line) and
parsed with ``from_json`` / ``try_parse_json``; nothing is read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knowtrace.sources.publish import publish
from knowtrace.operators.responses import line_seq, parse_jsonl_lines, parse_typed_results


def write_requests_jsonl(requests: DataFrame, path: str, payload: str = "payload", mode: str = "overwrite") -> bool:
    """K3: one request JSON object per line (``{"key": "request-<i>", "request": {...}}``).

    Empty input writes nothing and leaves an earlier file alone (the reference skips an empty run);
    returns whether rows came.
    """
    return publish(requests.select(F.col(payload).alias("value")), path, lambda w, folder: w.text(folder), mode)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with a sequence that preserves line order inside each file."""
    return spark.read.text(path).select("value", line_seq().alias("seq"))


def read_responses_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Keyed JSONL result file(s) -> normalised responses (see ``parse_jsonl_lines``)."""
    return parse_jsonl_lines(read_lines(spark, path))


def read_responses_typed(spark: SparkSession, path: str) -> DataFrame:
    """One typed result entry per line -> normalised responses."""
    return parse_typed_results(read_lines(spark, path))
