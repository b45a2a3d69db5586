"""The sequential job as one loop: ask, retry by limit, stop at the first fatal answer.

A frontier moves over the request positions in ranges.  Inside a range every request
is asked under the first limit; those whose answer came back empty because it ran out of room
are asked again, alone, under the doubled limit, until the cap.  A request that fails
or whose final answer is neither yes nor no is fatal: the loop ends with its range, later ranges
are never asked, and the result is what stands before it.  Ranges start small and double, so an
early failure costs few calls and a long run takes few rounds.

Every round is a distributed job whose answers are written to the shared folder before
anything reads them: a round is asked once whoever looks at it, and a lost executor repeats its
own tasks only.  The driver sees counts and the fatal position.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowtrace.functions.core import pystrip
from knowtrace.operators.responses import limit_ladder, score
from knowtrace.session import stored, work_path

#: prompt, limit -> text (None or empty if there is none), finish reason.
Responder = Callable[[str, int], "tuple[str | None, str]"]

ANSWERS = "position long, text string, finish string, error string"
SCORED = "position long, knows boolean, response string, limit int, attempts int"


class Asked(NamedTuple):
    """``results``: the requests before the fatal one, with knows, response, limit and attempts.

    ``fatal``: no row, or the one request that ended the run.  ``rounds``: one row a job (range, limit, asked).
    """

    results: DataFrame
    fatal: DataFrame
    rounds: DataFrame


def ask_once(frontier: DataFrame, fn: Responder, prompt: str = "prompt") -> DataFrame:
    """One round: position, limit, text, finish, error (``Error: <kind>: <message>`` where ``fn`` raised)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for position, text, limit in zip(pdf["position"], pdf["prompt"], pdf["limit"]):
                try:
                    answer, finish = fn(text, int(limit))
                    out.append((position, answer, finish, None))
                except Exception as e:  # the responder's failure is data, not a task failure
                    out.append((position, None, None, f"Error: {type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["position", "text", "finish", "error"])

    asked = frontier.select("position", F.col(prompt).alias("prompt"), "limit").mapInPandas(run, ANSWERS)
    return asked.withColumn("text", pystrip(F.coalesce("text", F.lit(""))))


def ask_sequential(
    requests: DataFrame,
    fn: Responder,
    reasoning: bool = False,
    first_limit: int | None = None,
    cap: int = 800,
    first_range: int = 256,
    most_range: int = 1 << 20,
    whole_word: bool = False,
    prompt: str = "prompt",
    tasks: int | None = None,
) -> Asked:
    """Ask ``requests`` (dense 0-based ``position``, :func:`requests.with_ordinal`) in order of position.

    ``reasoning`` allows retries; the limits are those of :func:`responses.limit_ladder` from ``first_limit``
    (default 200 with reasoning, else 5) to ``cap``.  ``tasks``: how many tasks ask at once (default: the session's parallelism).
    """
    spark = requests.sparkSession
    first_limit = first_limit or (200 if reasoning else 5)
    limits = limit_ladder(first_limit, cap) if reasoning else [first_limit]
    tasks = tasks or spark.sparkContext.defaultParallelism
    rows = stored(requests, "ask-requests")  # sorted by position: a range reads its row groups only
    last = rows.agg(F.max("position")).first()[0]
    told = work_path(spark, "ask-scored")  # one folder a range
    rounds: list[tuple[int, int, int, int]] = []
    at, size, stop = 0, first_range, None
    while last is not None and at <= last and stop is None:
        here = rows.where(F.col("position").between(at, at + size - 1))
        frontier, done = here.select("position", prompt), []
        for turn, limit in enumerate(limits):
            answers = stored(ask_once(frontier.repartition(tasks).withColumn("limit", F.lit(limit)), fn, prompt), "ask-answers")
            again = F.col("error").isNull() & (F.col("text") == "") & F.coalesce(F.col("finish") == "length", F.lit(False))
            again = again if turn + 1 < len(limits) else F.lit(False)
            asked, retried = answers.select(F.count(F.lit(1)), F.count_if(again)).first()
            rounds.append((at, at + size - 1, limit, asked))
            done.append(answers.where(~again).withColumn("limit", F.lit(limit)).withColumn("attempts", F.lit(turn + 1)))
            if not retried:
                break
            frontier = here.select("position", prompt).join(answers.where(again).select("position"), "position", "left_semi")
        final = done[0]
        for more in done[1:]:
            final = final.unionByName(more)
        status = F.when(F.col("error").isNull(), F.lit("succeeded")).otherwise(F.lit("errored"))
        scored = score(final.withColumn("status", status), whole_word).select("position", "knows", "response", "limit", "attempts")
        scored.write.parquet(f"{told}/first={at}")
        scored = spark.read.schema(SCORED).parquet(f"{told}/first={at}")
        stop = scored.where(F.col("knows").isNull()).agg(F.min("position")).first()[0]
        at, size = at + size, min(size * 2, most_range)
    every = spark.read.schema(SCORED).parquet(told).drop("first") if rounds else spark.createDataFrame([], SCORED)
    out = rows.join(every, "position")
    results = out if stop is None else out.where(F.col("position") < stop)
    fatal = out.where(F.lit(False)) if stop is None else out.where(F.col("position") == stop)
    return Asked(results, fatal, spark.createDataFrame(rounds, "first long, last long, limit int, asked long"))
