"""Response parsing and reconciliation by id.

Every response source is normalised to one frame

    ``request_id STRING, status STRING, text STRING, error STRING, seq``

where ``text`` is the (stripped) answer of a succeeded response and ``error``
the ready-made message of any other outcome.  ``score`` turns that into the
tri-state plus the response text; ``join_responses`` attaches it to the
requests with the ``'No result'`` default.  Last-write-wins per id is a hash
aggregate of one fixed-width number a row and an equi-join that moves the wide rows once.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knowtrace.functions.answers import (
    INLINE_NO_RESPONSE,
    INLINE_UNPARSABLE,
    NO_CANDIDATES,
    NO_RESPONSE_OR_ERROR,
    NO_RESULT,
    PARSING_ERROR_PREFIX,
    error_text,
    first_text,
    key_index,
    response_text,
    yes_no_safe,
)
from knowtrace.functions.core import pystrip
from knowtrace.session import cut_lineage

NORMALISED = ["request_id", "status", "text", "error", "seq"]

JSONL_SCHEMA = "key: STRING, response: STRING, error: STRING"
CANDIDATES_SCHEMA = "candidates ARRAY<STRUCT<content: STRUCT<parts: ARRAY<STRUCT<text: STRING>>>>>"
TYPED_SCHEMA = (
    "custom_id STRING, result STRUCT<type: STRING, message: STRUCT<content: ARRAY<STRUCT<type: STRING, text: STRING>>>>"
)
# JSON values Python treats as false (an empty or zero response means "absent").
_FALSY_JSON = ["{}", "[]", "", "0", "0.0", "false", "null"]


def _sequence(responses: DataFrame, seq: str) -> tuple[DataFrame, Column]:
    """``responses`` with what :func:`dedupe_last` needs, and the sequence as a long.

    A :func:`line_seq` becomes the number of its split (a table of one row a split) before the row's number in it.
    """
    if not isinstance(responses.schema[seq].dataType, T.StructType):
        return responses, F.col(seq).cast("long")
    splits = responses.select(F.col(f"{seq}.file").alias("__file"), F.col(f"{seq}.block").alias("__block")).distinct()
    splits = splits.withColumn("__split", F.row_number().over(Window.orderBy("__file", "__block")))
    same = F.col(f"{seq}.file").eqNullSafe(F.col("__file")) & F.col(f"{seq}.block").eqNullSafe(F.col("__block"))
    row = F.col(f"{seq}.row").bitwiseAND(F.lit((1 << 33) - 1))
    return responses.join(splits, same, "left"), F.shiftleft(F.col("__split").cast("long"), 33).bitwiseOR(row)


def dedupe_last(responses: DataFrame, key: str = "request_id", seq: str = "seq") -> DataFrame:
    """Keep the last row per id by ``seq`` (later lines replace earlier ones).

    Rows of one id and sequence are told apart by a hash of their other columns (the greatest wins); equal rows
    count as one.  A null sequence is the earliest.
    """
    others = [c for c in responses.columns if c not in (key, seq)]
    rows, number = _sequence(responses, seq)
    # number, then hash, in one decimal: a buffer of fixed width, so Spark aggregates by hash
    number = F.coalesce(number, F.lit(-(1 << 63))).cast("decimal(19,0)")
    tie = F.xxhash64(F.lit(0), *others).bitwiseAND(F.lit((1 << 62) - 1)).cast("decimal(19,0)")
    rows = rows.select(*responses.columns, (number * F.lit(1 << 62).cast("decimal(19,0)") + tie).cast("decimal(38,0)").alias("__rank"))
    last = rows.groupBy(F.col(key).alias("__key")).agg(F.max("__rank").alias("__last"))
    kept = rows.join(last, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__rank") == F.col("__last")), "left_semi")
    # equal rows: all columns are the key, nothing is held beside it
    return kept.select(key, *others, seq).distinct()


def score(responses: DataFrame, whole_word: bool = False) -> DataFrame:
    """T2 core: succeeded -> tri-state + answer (or answer with parse error); else the error text."""
    ok = F.col("status") == "succeeded"
    parsed = yes_no_safe("text", whole_word)
    return responses.withColumn("knows", F.when(ok, parsed.getField("knows"))).withColumn(
        "response", F.when(ok, response_text("text", parsed.getField("error"))).otherwise(F.col("error"))
    )


def join_responses(requests: DataFrame, scored: DataFrame, key: str = "request_id") -> DataFrame:
    """Every request exactly once; unmatched -> (NULL, 'No result'); extra responses dropped.

    ``scored`` must be unique per key (use :func:`dedupe_last`).
    """
    right = scored.select(F.col(key).alias("__rid"), F.col("knows").alias("__knows"), F.col("response").alias("__resp"))
    joined = requests.join(right, requests[key] == right["__rid"], "left")
    return joined.withColumn("knows", F.col("__knows")).withColumn(
        "response", F.coalesce(F.col("__resp"), F.lit(NO_RESULT))
    ).drop("__rid", "__knows", "__resp")


def parse_jsonl_lines(lines: DataFrame, value: str = "value", seq: str = "seq") -> DataFrame:
    """Keyed JSONL result lines -> normalised responses.

    Blank lines, lines that are not JSON objects and keys that are not
    ``request-<int>`` are skipped (their request later reads 'No result').
    The request id is the integer index as text, so ``request-05`` answers
    request 5 as in the reference.
    """
    raw = F.col(value)
    # Parsed as the one element of an array: malformed text, text behind the object and
    # other kinds of values are then no such array.  The last of repeated keys counts.
    one = F.from_json(F.concat(F.lit("["), raw, F.lit("]")), f"ARRAY<STRUCT<{JSONL_SCHEMA}>>")
    parsed = lines.withColumn("__a", one).where(F.size("__a") == 1).withColumn("__o", F.get("__a", F.lit(0)))
    parsed = parsed.withColumn("__idx", key_index(F.col("__o").getField("key"))).where(F.col("__idx").isNotNull())
    resp = F.col("__o").getField("response")
    err = F.col("__o").getField("error")
    resp_true = resp.isNotNull() & ~resp.isin(*_FALSY_JSON)
    cands = F.from_json(resp, CANDIDATES_SCHEMA).getField("candidates")
    has_cands = F.coalesce(F.size(cands) > 0, F.lit(False))
    parts = F.get(cands, F.lit(0)).getField("content").getField("parts")
    answer = pystrip(F.coalesce(first_text(parts), F.lit("")))
    status = F.when(resp_true & has_cands, F.lit("succeeded")).otherwise(F.lit("errored"))
    error = (
        F.when(resp_true & has_cands, F.lit(None).cast("string"))
        .when(resp_true, F.lit(NO_CANDIDATES))
        .when(err.isNotNull(), error_text(err))
        .otherwise(F.lit(NO_RESPONSE_OR_ERROR))
    )
    return parsed.select(
        F.col("__idx").cast("string").alias("request_id"),
        status.alias("status"),
        F.when(resp_true & has_cands, answer).alias("text"),
        error.alias("error"),
        F.col(seq).alias("seq"),
    )


def parse_typed_results(entries: DataFrame, value: str = "value", seq: str = "seq") -> DataFrame:
    """``{custom_id, result{type, message{content[{text}]}}}`` entries -> normalised responses.

    A non-succeeded entry gives ``'Error: <type>'``; a succeeded one without
    a first text block gives ``'Error parsing response: ...'`` (the message
    after the colon is ours, the reference prints a Python exception).
    """
    o = F.from_json(F.col(value), TYPED_SCHEMA)
    e = entries.withColumn("__o", o).where(F.col("__o").getField("custom_id").isNotNull())
    typ = F.col("__o").getField("result").getField("type")
    content = F.col("__o").getField("result").getField("message").getField("content")
    first = F.get(content, F.lit(0))
    ok = typ == "succeeded"
    has_text = first.getField("text").isNotNull()
    err = (
        F.when(ok & first.isNull(), F.lit(PARSING_ERROR_PREFIX + "list index out of range"))
        .when(ok & ~has_text, F.lit(PARSING_ERROR_PREFIX + "first content block has no text"))
        .when(~ok | typ.isNull(), error_text(F.coalesce(typ, F.lit("None"))))
    )
    return e.select(
        F.col("__o").getField("custom_id").alias("request_id"),
        F.when(ok & has_text, F.lit("succeeded")).otherwise(F.lit("errored")).alias("status"),
        F.when(ok & has_text, pystrip(first.getField("text"))).alias("text"),
        err.alias("error"),
        F.col(seq).alias("seq"),
    )


def responses_by_position(inline: DataFrame, position: str = "position") -> DataFrame:
    """Inline responses matched by list position.

    Input columns: ``position, has_response, text, error``.  A response
    without text -> 'Error: Could not parse response'; no response but an
    error -> 'Error: <error>'; neither -> 'Error: No response'.
    """
    has, txt, err = F.col("has_response"), F.col("text"), F.col("error")
    ok = has & txt.isNotNull()
    return inline.select(
        F.col(position).cast("string").alias("request_id"),
        F.when(ok, F.lit("succeeded")).otherwise(F.lit("errored")).alias("status"),
        F.when(ok, pystrip(txt)).alias("text"),
        F.when(has & txt.isNull(), F.lit(INLINE_UNPARSABLE))
        .when(~has & err.isNotNull(), error_text(err))
        .when(~has, F.lit(INLINE_NO_RESPONSE))
        .alias("error"),
        F.col(position).cast("bigint").alias("seq"),
    )


def warn_on_mismatch(requests: DataFrame, inline: DataFrame) -> bool:
    """Warn where there are not as many responses as requests; nothing else changes."""
    both = count_mismatch(requests, inline).first()
    if both.mismatch:
        warnings.warn(f"{both.responses} inline responses to {both.requests} requests", stacklevel=2)
    return both.mismatch


def count_mismatch(requests: DataFrame, inline: DataFrame) -> DataFrame:
    """One row with both counts and whether they differ (:func:`warn_on_mismatch`)."""
    r = requests.select(F.count(F.lit(1)).alias("n")).scalar()
    i = inline.select(F.count(F.lit(1)).alias("n")).scalar()
    return requests.sparkSession.range(1).select(
        r.alias("requests"), i.alias("responses"), (r != i).alias("mismatch")
    )


def prefix_before_error(df: DataFrame, order: str, is_error: Column) -> DataFrame:
    """Rows strictly before the first fatal row (sequential family's stop-and-save).

    The rows are cut first: both reads below then see the same answers, and a
    responder upstream is asked once.
    """
    df = cut_lineage(df)
    first_bad = df.where(is_error).select(F.min(order)).scalar()
    return df.where(first_bad.isNull() | (F.col(order) < first_bad))


def limit_ladder(start: int = 200, cap: int = 800) -> list[int]:
    """Output limits tried in order: double until the cap (200, 400, 800)."""
    out, cur = [start], start
    while cur < cap:
        cur = min(cur * 2, cap)
        out.append(cur)
    return out


def resolve_attempts(
    attempts: DataFrame,
    key: str = "request_id",
    attempt: str = "attempt",
    text: str = "text",
    finish: str = "finish",
    limit: str = "limit",
    reasoning: bool = True,
    cap: int = 800,
) -> DataFrame:
    """The terminal attempt per request.

    An attempt is retried only when its text is empty, it stopped for
    length, reasoning is on and its limit is below the cap.  The terminal
    attempt is the first non-retryable one, else the last.
    """
    empty = F.col(text).isNull() | (pystrip(F.col(text)) == "")
    retry = empty & (F.col(finish) == "length") & F.lit(bool(reasoning)) & (F.col(limit) < F.lit(cap))
    cols = [c for c in attempts.columns if c != key]
    # numbers only in the buffers (aggregated by hash); the wide row is fetched by its attempt
    agg = attempts.groupBy(F.col(key).alias("__key")).agg(
        F.coalesce(F.min(F.when(~retry, F.col(attempt))), F.max(attempt)).alias("__final"),
        F.count(F.lit(1)).alias("attempts"),
    )
    same = F.col(key).eqNullSafe(F.col("__key")) & F.col(attempt).eqNullSafe(F.col("__final"))
    return attempts.join(agg, same).select(key, *cols, "attempts").distinct()


def apply_responder(
    requests: DataFrame,
    fn: Callable[[str], str],
    prompt_col: str = "prompt",
    id_col: str = "request_id",
    max_per_batch: int | None = None,
) -> DataFrame:
    """call a user-supplied answering function on every prompt, batch by batch.

    Without ``max_per_batch`` the function takes one prompt.  With it, the
    function takes a list of at most that many prompts and returns as many answers.

    Runs as ``mapInPandas`` (Arrow batches, one Python worker per task); an
    exception in ``fn`` becomes an ``errored`` row, never a failed task.
    Output is in the normalised response shape.
    """
    schema = T.StructType(
        [
            T.StructField("request_id", T.StringType()),
            T.StructField("status", T.StringType()),
            T.StructField("text", T.StringType()),
            T.StructField("error", T.StringType()),
        ]
    )

    def run(batches):
        for pdf in batches:
            ids, statuses, texts, errors = [], [], [], []
            step = max_per_batch or 1
            for at in range(0, len(pdf), step):
                part = pdf.iloc[at : at + step]
                asked = list(part[prompt_col])
                try:
                    got = list(fn(asked)) if max_per_batch else [fn(asked[0])]
                    if len(got) != len(asked):
                        raise ValueError(f"{len(got)} answers to {len(asked)} prompts")
                    answers = [("succeeded", "" if t is None else str(t).strip(), None) for t in got]
                except Exception as e:  # the responder's failure is data, not a task failure
                    answers = [("errored", None, f"Error: {type(e).__name__}: {e}")] * len(asked)
                ids += list(part[id_col])
                for st, t, er in answers:
                    statuses.append(st)
                    texts.append(t)
                    errors.append(er)
            yield pd.DataFrame({"request_id": ids, "status": statuses, "text": texts, "error": errors})

    out = requests.select(F.col(id_col).cast("string").alias(id_col), F.col(prompt_col)).mapInPandas(run, schema)
    return out.withColumn("seq", F.lit(0).cast("bigint"))


def line_seq() -> Column:
    """Line order inside text files read by ``spark.read.text``: (file, split start, row id).

    Rows of one split are contiguous and increasing in ``monotonically_increasing_id``,
    and splits of one file are ordered by their start offset.
    """
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
