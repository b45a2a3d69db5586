"""The sequential ask loop: every call counted, retries by limit, the stop."""

import os

import pytest

from knowtrace.operators import ask
from knowtrace.operators import responses as S


def _requests(spark, n):
    return spark.range(n).selectExpr("id AS position", "CAST(id AS STRING) AS request_id", "CONCAT('q', id) AS prompt")


def _responder(folder, fatal=None):
    """Answers q<i>; needs 150, 350 or 700 of room by i % 3.  Leaves one file a call."""

    def fn(prompt, limit):
        i = int(prompt[1:])
        with open(os.path.join(folder, f"{i}-{limit}-{os.urandom(4).hex()}"), "w"):
            pass
        if i == fatal:
            return "maybe", "stop"
        return ("", "length") if limit < (150, 350, 700)[i % 3] else ("No" if i % 2 else " Yes ", "stop")

    return fn


def _calls(folder):
    return sorted(tuple(map(int, f.split("-")[:2])) for f in os.listdir(folder))


def test_every_request_is_asked_once_a_limit(spark, tmp_path):
    out = ask.ask_sequential(_requests(spark, 40), _responder(str(tmp_path)), reasoning=True, first_range=8, tasks=3)
    got = {r.position: (r.knows, r.response, r.limit, r.attempts) for r in out.results.collect()}
    turn = lambda i: (200, 400, 800)[i % 3]
    assert got == {i: (bool(i % 2), "No" if i % 2 else "Yes", turn(i), i % 3 + 1) for i in range(40)}
    assert out.fatal.count() == 0
    # looking at the result again asks nothing again
    assert out.results.count() == 40
    assert _calls(tmp_path) == sorted((i, x) for i in range(40) for x in (200, 400, 800) if x <= turn(i))
    assert [tuple(r) for r in out.rounds.where("limit = 200").orderBy("first").collect()] == [(0, 7, 200, 8), (8, 23, 200, 16), (24, 55, 200, 16)]


@pytest.mark.parametrize("fatal", [0, 5, 9, 23, 39])
def test_nothing_beyond_the_failing_range_is_asked(spark, tmp_path, fatal):
    out = ask.ask_sequential(_requests(spark, 40), _responder(str(tmp_path), fatal), reasoning=True, first_range=8)
    assert sorted(r.position for r in out.results.collect()) == list(range(fatal))
    assert [(r.position, r.knows, r.response.split(" (parse error")[0]) for r in out.fatal.collect()] == [(fatal, None, "maybe")]
    end = next(e for e in (8, 24, 56) if fatal < e)
    assert {i for i, _ in _calls(tmp_path)} == set(range(min(end, 40)))


def test_failures_and_empty_answers_are_fatal(spark, tmp_path):
    def fails(prompt, limit):
        if prompt == "q3":
            raise RuntimeError("no service")
        return "No", "stop"

    out = ask.ask_sequential(_requests(spark, 6), fails)
    assert out.results.count() == 3 and out.fatal.first().response == "Error: RuntimeError: no service"
    # without reasoning an answer without room is final, and so fatal
    out = ask.ask_sequential(_requests(spark, 6), lambda p, n: ("", "length"))
    assert out.results.count() == 0 and out.fatal.first().position == 0
    assert [(r.limit, r.asked) for r in out.rounds.collect()] == [(5, 6)]
    # at the cap too
    out = ask.ask_sequential(_requests(spark, 2), lambda p, n: (None, "length"), reasoning=True)
    assert [(r.limit, r.asked) for r in out.rounds.orderBy("limit").collect()] == [(200, 2), (400, 2), (800, 2)]
    assert out.results.count() == 0


def test_no_requests(spark):
    out = ask.ask_sequential(_requests(spark, 0), lambda p, n: ("No", "stop"))
    assert out.results.count() == out.fatal.count() == out.rounds.count() == 0
    assert {"request_id", "prompt", "knows", "response", "limit", "attempts"} <= set(out.results.columns)


def test_equals_attempts_resolved_and_cut(spark, tmp_path):
    """The loop, and W11 then W10 over all attempts ever possible."""
    fn = _responder(str(tmp_path), 17)
    loop = ask.ask_sequential(_requests(spark, 30), fn, reasoning=True, first_range=4).results
    rows = [(i, k, x, *fn(f"q{i}", x)) for i in range(30) for k, x in enumerate((200, 400, 800))]
    attempts = spark.createDataFrame(rows, "position long, attempt int, limit int, text string, finish string")
    last = S.resolve_attempts(attempts, key="position").withColumn("status", S.F.lit("succeeded")).withColumn("error", S.F.lit(None).cast("string"))
    last = last.withColumn("text", S.pystrip(S.F.col("text")))
    cut = S.prefix_before_error(S.score(last), "position", S.F.col("knows").isNull())
    cols = ["position", "knows", "response", "limit"]
    assert sorted(map(tuple, loop.select(*cols).collect())) == sorted(map(tuple, cut.select(*cols).collect())) and loop.count() == 17
