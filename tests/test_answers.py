"""Goldens for answer parsing and response reconciliation (FIXTURES section 4)."""

from pyspark.sql import functions as F

from knowtrace.functions import answers as A
from knowtrace.operators import responses as S


def _parse(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "a string")
    rows = df.select("a", A.yes_no("a").alias("k"), A.yes_no_error("a").alias("e")).collect()
    return {r.a: (r.k, r.e) for r in rows}


def test_yes_no_goldens(spark):
    got = _parse(spark, ["No", "no.", "Nope", "Yes", " YES ", "I don't know", "Yes and no", "", "Maybe"])
    assert got["No"][0] is True and got["no."][0] is True and got["Nope"][0] is True
    assert got["Yes"][0] is False and got[" YES "][0] is False
    assert got["I don't know"][0] is True  # substring quirk kept (D7)
    assert got["Yes and no"] == (None, "Ambiguous response (contains both 'yes' and 'no'): 'Yes and no'")
    assert got[""] == (None, "Invalid response (no 'yes' or 'no' found): ''")
    assert got["Maybe"][1] == "Invalid response (no 'yes' or 'no' found): 'Maybe'"


def test_whole_word_opt_in(spark):
    df = spark.createDataFrame([("I don't know",), ("no",)], "a string")
    got = [r.k for r in df.select(A.yes_no("a", whole_word=True).alias("k")).collect()]
    assert got == [None, True]


def test_response_text_with_parse_error(spark):
    df = spark.createDataFrame([("Maybe",)], "a string")
    r = df.select(A.response_text("a", A.yes_no_error("a")).alias("t")).first()
    assert r.t == "Maybe (parse error: Invalid response (no 'yes' or 'no' found): 'Maybe')"


JSONL = [
    '{"key":"request-0","response":{"candidates":[{"content":{"parts":[{"text":" No "}]}}]}}',
    '{"key":"request-1","response":{"candidates":[]}}',
    '{"key":"request-2","error":{"code":500}}',
    '{"key":"request-3","response":{}}',
    '{"key":"request-4","response":{"candidates":[{"content":{"parts":[{"thought":true},{"text":"Yes"}]}}]}}',
    "not json at all",
    '{"key":"request-x","response":{}}',
    '{"key":"request-6","response":{"candidates":[{"content":{"parts":[{"text":"Yes"}]}}]}}',
    '{"key":"request-6","response":{"candidates":[{"content":{"parts":[{"text":"No"}]}}]}}',
    "",
]


def test_jsonl_responses_goldens(spark):
    lines = spark.createDataFrame([(v, i) for i, v in enumerate(JSONL)], "value string, seq long")
    scored = S.score(S.dedupe_last(S.parse_jsonl_lines(lines)))
    req = spark.createDataFrame([(str(i),) for i in range(8)], "request_id string")
    got = {r.request_id: (r.knows, r.response) for r in S.join_responses(req, scored).collect()}
    assert got["0"] == (True, "No")
    assert got["1"] == (None, "Error: No candidates in response")
    assert got["2"] == (None, 'Error: {"code":500}')
    assert got["3"] == (None, "Error: No response or error in result")
    assert got["4"] == (False, "Yes")
    assert got["5"] == (None, "No result")  # its line was not JSON
    assert got["6"] == (True, "No")  # last write wins
    assert got["7"] == (None, "No result")
    assert len(got) == 8  # one row per request


def test_typed_results(spark):
    entries = [
        '{"custom_id":"0","result":{"type":"succeeded","message":{"content":[{"type":"text","text":"No"}]}}}',
        '{"custom_id":"1","result":{"type":"errored"}}',
        '{"custom_id":"2","result":{"type":"succeeded","message":{"content":[]}}}',
    ]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(entries)], "value string, seq long")
    got = {r.request_id: (r.knows, r.response) for r in S.score(S.parse_typed_results(df)).collect()}
    assert got["0"] == (True, "No")
    assert got["1"] == (None, "Error: errored")
    assert got["2"] == (None, "Error parsing response: list index out of range")


def test_prefix_before_error(spark):
    df = spark.createDataFrame([(0, True), (1, False), (2, None), (3, True)], "position long, knows boolean")
    got = S.prefix_before_error(df, "position", F.col("knows").isNull()).orderBy("position").collect()
    assert [r.position for r in got] == [0, 1]


def test_retry_ladder(spark):
    assert S.limit_ladder(200, 800) == [200, 400, 800]
    rows = [
        ("a", 0, 200, "", "length"),
        ("a", 1, 400, "No", "stop"),
        ("b", 0, 200, "", "length"),
        ("b", 1, 400, "", "length"),
        ("b", 2, 800, "", "length"),
        ("c", 0, 200, "", "stop"),
    ]
    df = spark.createDataFrame(rows, "request_id string, attempt int, limit int, text string, finish string")
    got = {r.request_id: r.attempt for r in S.resolve_attempts(df).collect()}
    assert got == {"a": 1, "b": 2, "c": 0}


def test_responder_errors_become_rows(spark):
    def fn(p):
        if p == "boom":
            raise ValueError("bad")
        return "No"

    df = spark.createDataFrame([("0", "hello"), ("1", "boom")], "request_id string, prompt string")
    got = {r.request_id: (r.status, r.error) for r in S.apply_responder(df, fn).collect()}
    assert got["0"] == ("succeeded", None)
    assert got["1"] == ("errored", "Error: ValueError: bad")


def test_jsonl_keeps_every_valid_line(spark):
    ok = '{"candidates":[{"content":{"parts":[{"text":"%s"}]}}]}'
    lines = [
        '{"key":"request-3000000000","response":%s}' % (ok % "No"),
        '{"key":"request-1","key":"request-2","response":%s}' % (ok % "Yes"),
        '{"key":"request-4","response":%s} trailing' % (ok % "No"),
        '{"key":"request-5","response":%s} {"a":1}' % (ok % "No"),
        '{"key":"request-6","response":',
        '[{"key":"request-7"}]',
        "",
        '{"key":"request-8","response":%s}' % (ok % "a } { b"),
    ]
    df = spark.createDataFrame([(x, i) for i, x in enumerate(lines)], "value string, seq long")
    got = {r.request_id: r.text for r in S.parse_jsonl_lines(df).collect()}
    assert got == {"3000000000": "No", "2": "Yes", "8": "a } { b"}


def test_responder_takes_lists(spark):
    def fn(prompts):
        if "boom" in prompts:
            raise ValueError("bad")
        return [f"{len(prompts)} {p}" for p in prompts]

    df = spark.createDataFrame([(str(i), "boom" if i == 4 else f"p{i}") for i in range(6)], "request_id string, prompt string").coalesce(1)
    got = {r.request_id: (r.status, r.text) for r in S.apply_responder(df, fn, max_per_batch=2).collect()}
    assert got["0"] == ("succeeded", "2 p0") and got["4"] == got["5"] == ("errored", None)


def test_each_request_is_asked_once(spark):
    asked = spark.sparkContext.accumulator(0)

    def fn(p):
        asked.add(1)
        return "" if p == "p12" else "No"

    df = spark.createDataFrame([(str(i), f"p{i}") for i in range(20)], "request_id string, prompt string")
    scored = S.score(S.apply_responder(df, fn))
    got = S.prefix_before_error(scored.withColumn("position", F.col("request_id").cast("long")), "position", F.col("knows").isNull())
    assert got.count() == 12 and asked.value == 20


def test_sequential_envelope(spark):
    import json

    from knowtrace.operators import requests as R

    df = spark.createDataFrame([("Ann", "singer")], "name string, description string")
    for reasoning, want in ((False, (5, 0, "none")), (True, (200, 1, "low"))):
        r = R.build_requests(df, [F.col("name")], "gpt-9", reasoning=reasoning).first()
        got = json.loads(r.payload)
        assert [m["role"] for m in got["messages"]] == ["system", "user"] and got["messages"][1]["content"] == "Is Ann, singer, still alive?"
        assert (got["max_completion_tokens"], got["temperature"], got["reasoning_effort"]) == want and got["model"] == "gpt-9"
