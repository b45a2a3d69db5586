"""Registered queries: prompts, settings, request envelopes, response parsing
and reconciliation (P9-P13, J3, J6, W9-W12, X19-X25, S5-S7, K3, F1, A9, T2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from knowtrace.functions import answers as A
from knowtrace.functions.core import pystrip
from knowtrace.operators import ask
from knowtrace.operators import requests as R
from knowtrace.operators import responses as S
from knowtrace.operators import select
from knowtrace.plans import bindings as B
from knowtrace.plans.catalog import register
from knowtrace.plans.oracle import RESULTS, with_
from knowtrace.plans.oracle_answers import CONV_REQ, error, knows, response, strip
from knowtrace.session import work_path
from knowtrace.sources.jsonl import read_responses_jsonl, write_requests_jsonl

TOP_MONTH = 10
MIN_VIEWS = 100_000
REASONING_VIEWS = 250_000
SEQUENTIAL_MODEL = "gpt-5.2"
TYPED_MODEL = "claude-opus-4-5"
JSONL_MODEL = "gemini-3-flash-preview"

# Model per order priority, used to exercise the family routing on real rows.
PRIORITY_MODELS = [
    ("1-URGENT", "gemini-3-pro-preview"),
    ("2-HIGH", "Gemini-3-Flash-Preview"),
    ("3-MEDIUM", "claude-opus-4-5"),
    ("4-NOT SPECIFIED", "gpt-5.2"),
    ("5-LOW", "o3mini-high"),
]


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@register(
    "prompts",
    with_(RESULTS) + "SELECT name, 'Is ' || name || ', ' || description || ', still alive?' AS prompt FROM results",
)
def prompts(spark, sf_dir):
    r = B.results(spark, sf_dir)
    return r.select("name", R.prompt("name", "description").alias("prompt"))


def _priority_model_sql() -> str:
    whens = " ".join(f"WHEN {_sql_str(p)} THEN {_sql_str(m)}" for p, m in PRIORITY_MODELS)
    return f"CASE o_orderpriority {whens} END"


#: Fixed values, stated apart from the library's own table so that a wrong one shows.
SETTINGS_SQL = """settings(family, level, max_tokens, temperature, system, effort, thinking_type, thinking_budget, thinking_level) AS (VALUES
  ('sequential', 'off', 5, 0.0, 'Answer only "Yes" or "No". Nothing else.', 'none', NULL, NULL, NULL),
  ('sequential', 'on', 200, 1.0, 'Answer only "Yes" or "No". Nothing else. Produce minimal reasoning.', 'low', NULL, NULL, NULL),
  ('batch-typed', 'off', 2, 0.0, 'Answer only "Yes" or "No". Nothing else. If unsure, answer "Yes".', NULL, 'disabled', NULL, NULL),
  ('batch-typed', 'on', 1026, 1.0, 'Answer only "Yes" or "No". Nothing else. Produce minimal reasoning. If unsure, answer "Yes".', NULL, 'enabled', 1024, NULL),
  ('batch-jsonl', 'disabled', 5, 0.0, 'Answer only "Yes" or "No". Nothing else.', NULL, NULL, NULL, NULL),
  ('batch-jsonl', 'minimal', 5, 0.0, 'Answer only "Yes" or "No". Nothing else.', NULL, NULL, NULL, 'MINIMAL'),
  ('batch-jsonl', 'low', 200, 1.0, 'Answer only "Yes" or "No". Nothing else. Produce minimal reasoning.', NULL, NULL, NULL, 'LOW'))"""


@register(
    "settings_join",
    with_(
        f"""m AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS name, {_priority_model_sql()} AS model,
         floor(o_totalprice) >= {REASONING_VIEWS} AS reasoning FROM orders)""",
        """f AS (
  SELECT name, model, reasoning,
         CASE WHEN contains(lower(model), 'gemini') THEN 'batch-jsonl'
              WHEN contains(lower(model), 'claude') THEN 'batch-typed' ELSE 'sequential' END AS family
  FROM m)""",
        """l AS (
  SELECT *, CASE WHEN family = 'batch-jsonl' THEN
                   CASE WHEN reasoning OR contains(lower(model), 'gemini-3-pro') THEN 'low' ELSE 'disabled' END
                 WHEN reasoning THEN 'on' ELSE 'off' END AS level
  FROM f)""",
        SETTINGS_SQL,
    )
    + """SELECT l.name, l.model, l.family, l.level, CAST(s.max_tokens AS INTEGER) AS max_tokens,
  CAST(s.temperature AS DOUBLE) AS temperature, s.system, s.effort, s.thinking_type,
  CAST(s.thinking_budget AS INTEGER) AS thinking_budget, s.thinking_level
FROM l LEFT JOIN settings s ON s.family = l.family AND s.level = l.level""",
)
def settings_join(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders")
    model = None
    for p, m in PRIORITY_MODELS:
        cond = F.col("o_orderpriority") == p
        model = F.when(cond, F.lit(m)) if model is None else model.when(cond, F.lit(m))
    df = o.select(
        F.col("o_orderkey").cast("string").alias("name"),
        model.alias("model"),
        (F.floor("o_totalprice") >= REASONING_VIEWS).alias("reasoning"),
    )
    df = df.withColumn("family", A.model_family("model")).withColumn(
        "level", R.settings_level("family", "reasoning", "model")
    )
    df = R.attach_settings(df)
    return df.select("name", "model", "family", "level", "max_tokens", "temperature", "system", "effort", "thinking_type", "thinking_budget", "thinking_level")


def _selected(spark, sf_dir):
    r = B.results(spark, sf_dir, min_views=MIN_VIEWS)
    return select.select_top(r, tie=["row_key"], top_per_month=TOP_MONTH, min_views_n=MIN_VIEWS)


_SELECTED_SQL = with_(
    RESULTS,
    f"""sel AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY strftime(death_date, '%Y-%m') ORDER BY pageviews DESC, row_key) AS rn
    FROM results WHERE pageviews >= {MIN_VIEWS}) t WHERE rn <= {TOP_MONTH})""",
    """ord AS (
  SELECT *, CAST(row_number() OVER (ORDER BY strftime(death_date, '%Y-%m'), pageviews DESC, row_key) - 1 AS BIGINT)
           AS position,
         'Is ' || name || ', ' || description || ', still alive?' AS prompt
  FROM sel)""",
)


def _order():
    return select.selection_order("month", ["row_key"])


@register(
    "requests_typed",
    _SELECTED_SQL
    + f"""SELECT position, CAST(position AS VARCHAR) AS request_id, prompt,
  json_object('custom_id', CAST(position AS VARCHAR),
    'params', json_object('model', {_sql_str(TYPED_MODEL)}, 'max_tokens', 2, 'temperature', 0,
      'system', 'Answer only "Yes" or "No". Nothing else. If unsure, answer "Yes".',
      'messages', json_array(json_object('role', 'user', 'content', prompt)),
      'thinking', json_object('type', 'disabled')))::VARCHAR AS payload
FROM ord""",
)
def requests_typed(spark, sf_dir):
    req = R.build_requests(_selected(spark, sf_dir), _order(), TYPED_MODEL, reasoning=False)
    return req.select("position", "request_id", "prompt", "payload")


@register(
    "requests_sequential",
    _SELECTED_SQL
    + f"""SELECT position, CAST(position AS VARCHAR) AS request_id, prompt,
  json_object('model', {_sql_str(SEQUENTIAL_MODEL)},
    'messages', json_array(
      json_object('role', 'system', 'content', 'Answer only "Yes" or "No". Nothing else. Produce minimal reasoning.'),
      json_object('role', 'user', 'content', prompt)),
    'max_completion_tokens', 200, 'temperature', 1, 'service_tier', 'flex', 'reasoning_effort', 'low')::VARCHAR AS payload
FROM ord""",
)
def requests_sequential(spark, sf_dir):
    """T5 as one job, P12 sequential shape."""
    run = R.build_run(B.results(spark, sf_dir), SEQUENTIAL_MODEL, ["row_key"], top_per_month=TOP_MONTH, min_views=MIN_VIEWS, reasoning=True)
    return run.select("position", "request_id", "prompt", "payload")


@register(
    "requests_jsonl",
    _SELECTED_SQL
    + f"""SELECT position, 'request-' || CAST(position AS VARCHAR) AS request_id, prompt,
  json_object('key', 'request-' || CAST(position AS VARCHAR),
    'request', json_object(
      'contents', json_array(json_object('parts', json_array(json_object('text', prompt)), 'role', 'user')),
      'systemInstruction', json_object('parts', json_array(json_object('text', 'Answer only "Yes" or "No". Nothing else. Produce minimal reasoning.'))),
      'generationConfig', json_object('temperature', 1.0::DOUBLE, 'maxOutputTokens', 200,
                                      'thinkingConfig', json_object('thinkingLevel', 'LOW'))))::VARCHAR AS payload
FROM ord""",
)
def requests_jsonl(spark, sf_dir):
    """P12 JSONL shape, written with the K3 sink and read back line by line."""
    req = R.build_requests(_selected(spark, sf_dir), _order(), JSONL_MODEL, reasoning=True)
    path = work_path(spark, "requests_jsonl")
    write_requests_jsonl(req, path)
    lines = spark.read.text(path)
    key = F.get_json_object("value", "$.key")
    back = lines.select(
        key.alias("request_id"),
        F.get_json_object("value", "$.request.contents[0].parts[0].text").alias("prompt"),
        F.col("value").alias("payload"),
    )
    return back.select(
        F.split_part("request_id", F.lit("-"), F.lit(2)).cast("bigint").alias("position"), "request_id", "prompt", "payload"
    )


# --- answers from conversations ---------------------------------------------


@register(
    "yes_no_parse",
    with_(CONV_REQ)
    + f"""SELECT conv_id, turn, {knows(strip('answer'))} AS knows, {error(strip('answer'))} AS error
FROM req WHERE answer IS NOT NULL""",
)
def yes_no_parse(spark, sf_dir):
    a = B.answers(spark, sf_dir).where(F.col("answer").isNotNull())
    parsed = A.yes_no_safe(pystrip("answer"))
    return a.select("conv_id", "turn", parsed.getField("knows").alias("knows"), parsed.getField("error").alias("error"))


@register(
    "response_text",
    with_(CONV_REQ) + f"SELECT conv_id, turn, {response(strip('answer'))} AS response FROM req WHERE answer IS NOT NULL",
)
def response_text_q(spark, sf_dir):
    a = B.answers(spark, sf_dir).where(F.col("answer").isNotNull())
    t = pystrip("answer")
    return a.select("conv_id", "turn", A.response_text(t, A.yes_no_error(t)).alias("response"))


def _succeeded(req):
    """Answers as succeeded responses (no answer -> no response row)."""
    return req.where(F.col("answer").isNotNull()).select(
        "request_id",
        F.lit("succeeded").alias("status"),
        pystrip("answer").alias("text"),
        F.lit(None).cast("string").alias("error"),
        F.col("position").alias("seq"),
    )


@register(
    "join_responses",
    with_(CONV_REQ)
    + f"""SELECT request_id, CASE WHEN answer IS NOT NULL THEN {knows(strip('answer'))} END AS knows,
  CASE WHEN answer IS NULL THEN 'No result' ELSE {response(strip('answer'))} END AS response
FROM req""",
)
def join_responses_q(spark, sf_dir):
    req = B.conv_requests(spark, sf_dir)
    scored = S.score(S.dedupe_last(_succeeded(req)))
    return S.join_responses(req, scored).select("request_id", "knows", "response")


# JSONL result lines rendered from the answers.  variant = conv_id % 7:
# 0 plain; 1 text in the second part; 2 error object; 3 no candidates;
# 4 empty response; 5 duplicate key (first line superseded); 6 malformed line.
# Every conversation with conv_id % 5 = 0 also gets two lines with keys that
# are rejected ('request-x', 'other-<i>').
ERR_OBJ = '{"code":500,"message":"internal"}'


def _jsonl_lines(req):
    key = F.concat(F.lit("request-"), F.col("position").cast("string"))
    v = F.col("conv_id") % 7
    part = lambda thought, text: F.struct(thought.alias("thought"), text.alias("text"))
    no_bool = F.lit(None).cast("boolean")
    no_str = F.lit(None).cast("string")
    parts = F.when(
        v == 1, F.array(part(F.lit(True), no_str), part(no_bool, F.col("answer")))
    ).otherwise(F.array(part(no_bool, F.col("answer"))))
    cand = F.struct(F.struct(parts.alias("parts")).alias("content"))
    ok_line = F.to_json(F.struct(key.alias("key"), F.struct(F.array(cand).alias("candidates")).alias("response")))
    stale = F.to_json(
        F.struct(
            key.alias("key"),
            F.struct(
                F.array(F.struct(F.struct(F.array(part(no_bool, F.col("prompt"))).alias("parts")).alias("content"))).alias(
                    "candidates"
                )
            ).alias("response"),
        )
    )
    err_line = F.concat(F.lit('{"key":"'), key, F.lit('","error":' + ERR_OBJ + "}"))
    nocand = F.concat(F.lit('{"key":"'), key, F.lit('","response":{"candidates":[]}}'))
    empty = F.concat(F.lit('{"key":"'), key, F.lit('","response":{}}'))
    broken = F.concat(F.lit('{"key":"'), key, F.lit('","response":'))
    main = (
        F.when(v == 2, err_line).when(v == 3, nocand).when(v == 4, empty).when(v == 6, broken).otherwise(ok_line)
    )
    line = lambda value, sub: F.struct(value.alias("value"), F.lit(sub).alias("sub"))
    lines = F.array(
        F.when(v == 5, line(stale, 0)),
        line(main, 1),
        F.when(F.col("conv_id") % 5 == 0, line(F.lit('{"key":"request-x","response":{}}'), 2)),
        F.when(
            F.col("conv_id") % 5 == 0,
            line(F.concat(F.lit('{"key":"other-'), F.col("position").cast("string"), F.lit('"}')), 3),
        ),
    )
    rows = req.where(F.col("answer").isNotNull()).select("position", F.explode(F.filter(lines, lambda x: x.isNotNull())).alias("l"))
    return rows.select(
        F.col("l.value").alias("value"),
        F.struct(F.col("position"), F.col("l.sub").alias("sub")).alias("seq"),
    )


@register(
    "jsonl_responses",
    with_(CONV_REQ)
    + f"""SELECT request_id,
  CASE WHEN answer IS NOT NULL AND conv_id % 7 IN (0, 1, 5) THEN {knows(strip('answer'))} END AS knows,
  CASE WHEN answer IS NULL OR conv_id % 7 = 6 THEN 'No result'
       WHEN conv_id % 7 = 2 THEN 'Error: {ERR_OBJ}'
       WHEN conv_id % 7 = 3 THEN 'Error: No candidates in response'
       WHEN conv_id % 7 = 4 THEN 'Error: No response or error in result'
       ELSE {response(strip('answer'))} END AS response
FROM req""",
)
def jsonl_responses(spark, sf_dir):
    req = B.conv_requests(spark, sf_dir)
    # The result lines go through real files: a sorted write keeps line order
    # within each file and file names (part-NNNNN) in key order, which is the
    # order the reader's sequence (file, split start, row) restores.
    path = work_path(spark, "responses_jsonl")
    _jsonl_lines(req).orderBy("seq").select("value").write.mode("overwrite").text(path)
    parsed = read_responses_jsonl(spark, path)
    scored = S.score(S.dedupe_last(parsed))
    return S.join_responses(req, scored).select("request_id", "knows", "response")


@register(
    "dedupe_last",
    """SELECT conv_id, arg_max(role, turn) AS role, arg_max(text, turn) AS text, max(turn) AS seq
FROM conversations GROUP BY conv_id""",
)
def dedupe_last_q(spark, sf_dir):
    c = B.table(spark, sf_dir, "conversations")
    return S.dedupe_last(c.select("conv_id", "role", "text", F.col("turn").alias("seq")), key="conv_id", seq="seq")


# Typed result entries: variant = conv_id % 4: 0 succeeded with text,
# 1 succeeded with no content, 2 errored, 3 expired; no answer -> canceled.
def _typed_entries(req):
    v = F.col("conv_id") % 4
    typ = (
        F.when(F.col("answer").isNull(), F.lit("canceled"))
        .when(v == 2, F.lit("errored"))
        .when(v == 3, F.lit("expired"))
        .otherwise(F.lit("succeeded"))
    )
    content = F.when(
        (v == 0) & F.col("answer").isNotNull(),
        F.array(F.struct(F.lit("text").alias("type"), F.col("answer").alias("text"))),
    ).when(v == 1, F.array().cast("array<struct<type:string,text:string>>"))
    msg = F.struct(content.alias("content"))
    entry = F.to_json(
        F.struct(
            F.col("request_id").alias("custom_id"),
            F.struct(typ.alias("type"), F.when(typ == "succeeded", msg).alias("message")).alias("result"),
        )
    )
    return req.select(entry.alias("value"), F.col("position").alias("seq"))


@register(
    "typed_responses",
    with_(CONV_REQ)
    + f"""SELECT request_id,
  CASE WHEN answer IS NOT NULL AND conv_id % 4 = 0 THEN {knows(strip('answer'))} END AS knows,
  CASE WHEN answer IS NULL THEN 'Error: canceled'
       WHEN conv_id % 4 = 1 THEN 'Error parsing response: list index out of range'
       WHEN conv_id % 4 = 2 THEN 'Error: errored'
       WHEN conv_id % 4 = 3 THEN 'Error: expired'
       ELSE {response(strip('answer'))} END AS response
FROM req""",
)
def typed_responses(spark, sf_dir):
    req = B.conv_requests(spark, sf_dir)
    scored = S.score(S.dedupe_last(S.parse_typed_results(_typed_entries(req))))
    return S.join_responses(req, scored).select("request_id", "knows", "response")


@register(
    "response_status_counts",
    with_(CONV_REQ)
    + """SELECT CASE WHEN answer IS NULL THEN 'canceled' WHEN conv_id % 4 = 2 THEN 'errored'
            WHEN conv_id % 4 = 3 THEN 'expired' ELSE 'succeeded' END AS status, count(*) AS n
FROM req GROUP BY 1""",
)
def response_status_counts(spark, sf_dir):
    from knowtrace.operators.metrics import response_status_counts as counts

    entries = _typed_entries(B.conv_requests(spark, sf_dir))
    typ = F.from_json("value", S.TYPED_SCHEMA).getField("result").getField("type")
    return counts(entries.select(typ.alias("status")))


@register(
    "inline_positional",
    with_(CONV_REQ)
    + f"""SELECT request_id,
  CASE WHEN answer IS NOT NULL AND answer <> '' THEN {knows(strip('answer'))} END AS knows,
  CASE WHEN answer IS NULL AND conv_id % 2 = 0 THEN 'Error: quota of ' || conv_id
       WHEN answer IS NULL THEN 'Error: No response'
       WHEN answer = '' THEN 'Error: Could not parse response'
       ELSE {response(strip('answer'))} END AS response
FROM req""",
)
def inline_positional(spark, sf_dir):
    req = B.conv_requests(spark, sf_dir)
    inline = req.select(
        "position",
        F.col("answer").isNotNull().alias("has_response"),
        F.when(F.col("answer") != "", F.col("answer")).alias("text"),
        F.when(F.col("answer").isNull() & (F.col("conv_id") % 2 == 0), F.concat(F.lit("quota of "), F.col("conv_id").cast("string"))).alias("error"),
    )
    S.warn_on_mismatch(req, inline)
    scored = S.score(S.responses_by_position(inline))
    return S.join_responses(req, scored).select("request_id", "knows", "response")


@register(
    "prefix_before_error",
    with_(
        CONV_REQ,
        f"""s AS (SELECT request_id, position, CASE WHEN answer IS NOT NULL THEN {knows(strip('answer'))} END AS knows,
                CASE WHEN answer IS NULL THEN 'No result' ELSE {response(strip('answer'))} END AS response FROM req)""",
    )
    + """SELECT request_id, knows, response FROM s
WHERE position < coalesce((SELECT min(position) FROM s WHERE knows IS NULL), 9223372036854775807)""",
)
def prefix_before_error(spark, sf_dir):
    """Sequential family - a missing or unparsable answer is fatal; keep what came before."""
    req = B.conv_requests(spark, sf_dir)
    joined = S.join_responses(req, S.score(_succeeded(req)))
    return S.prefix_before_error(joined, "position", F.col("knows").isNull()).select("request_id", "knows", "response")


@register(
    "retry_ladder",
    with_(CONV_REQ)
    + """SELECT request_id,
  CAST(CASE WHEN length(answer) <= 200 THEN 0 WHEN length(answer) <= 400 THEN 1 ELSE 2 END AS INTEGER) AS attempt,
  CAST(CASE WHEN length(answer) <= 200 THEN 200 WHEN length(answer) <= 400 THEN 400 ELSE 800 END AS INTEGER) AS "limit",
  CASE WHEN length(answer) <= 800 THEN 'stop' ELSE 'length' END AS finish,
  CASE WHEN length(answer) <= 800 THEN answer ELSE '' END AS text
FROM req WHERE answer IS NOT NULL""",
)
def retry_ladder(spark, sf_dir):
    """Answer length stands for the tokens a reasoning answer needs; each
    attempt under that budget comes back empty with finish 'length'."""
    req = B.conv_requests(spark, sf_dir).where(F.col("answer").isNotNull())
    ladder = S.limit_ladder(R.RETRY_START, R.RETRY_CAP)
    att = req.select(
        "request_id", "answer", F.posexplode(F.array(*[F.lit(x) for x in ladder])).alias("attempt", "limit")
    )
    fits = F.length("answer") <= F.col("limit")
    att = att.select(
        "request_id",
        F.col("attempt").cast("int").alias("attempt"),
        F.col("limit").cast("int").alias("limit"),
        F.when(fits, F.lit("stop")).otherwise(F.lit("length")).alias("finish"),
        F.when(fits, F.col("answer")).otherwise(F.lit("")).alias("text"),
    )
    out = S.resolve_attempts(att, cap=R.RETRY_CAP)
    return out.select("request_id", "attempt", "limit", "finish", "text")


def parity_responder(prompt: str) -> str:
    """Deterministic stand-in for a model: 'No' for even-length prompts, 'Yes' for odd;
    fails on an empty prompt."""
    if not prompt:
        raise ValueError("empty prompt")
    return "No" if len(prompt) % 2 == 0 else "Yes"


@register(
    "responder",
    with_(CONV_REQ)
    + """SELECT request_id,
  CASE WHEN coalesce(prompt, '') = '' THEN NULL WHEN length(prompt) % 2 = 0 THEN TRUE ELSE FALSE END AS knows,
  CASE WHEN coalesce(prompt, '') = '' THEN 'Error: ValueError: empty prompt'
       WHEN length(prompt) % 2 = 0 THEN 'No' ELSE 'Yes' END AS response
FROM req""",
)
def responder(spark, sf_dir):
    req = B.conv_requests(spark, sf_dir)
    answered = S.apply_responder(req, parity_responder)
    return S.join_responses(req, S.score(answered)).select("request_id", "knows", "response")





@register(
    "document_answers",
    f"""SELECT lang, count(*) FILTER (WHERE k) AS knows_true, count(*) FILTER (WHERE NOT k) AS knows_false,
  count(*) FILTER (WHERE k IS NULL) AS unparsed, count(*) AS total
FROM (SELECT lang, {knows(strip('text'))} AS k FROM documents) t GROUP BY lang""",
)
def document_answers(spark, sf_dir):
    """X19/X20 over whole document texts (up to 20,000 words each), by language."""
    d = B.table(spark, sf_dir, "documents")
    k = A.yes_no("text")
    return d.groupBy("lang").agg(
        F.count_if(k).alias("knows_true"),
        F.count_if(~k).alias("knows_false"),
        F.count_if(k.isNull()).alias("unparsed"),
        F.count(F.lit(1)).alias("total"),
    )


def rationed_responder(prompt: str, limit: int):
    """Deterministic stand-in for a reasoning model, asked about the order key in the prompt.

    Key mod 5 decides the room it needs; one before a multiple of 7919 needs more than the cap, which is fatal.
    """
    key = int(prompt.split(",")[0].removeprefix("Is "))
    need = 900 if (key + 1) % 7919 == 0 else (120, 120, 300, 300, 650)[key % 5]
    if limit < need:
        return "", "length"
    return ("No." if key % 2 else "Yes"), "stop"


@register(
    "ask_sequential",
    with_(
        RESULTS,
        """need AS (SELECT row_key, name, CASE WHEN (row_key + 1) % 7919 = 0 THEN 900 WHEN row_key % 5 < 2 THEN 120 WHEN row_key % 5 < 4 THEN 300 ELSE 650 END AS need
  FROM results)""",
    )
    + """SELECT name, row_number() OVER (ORDER BY row_key) - 1 AS position, row_key % 2 = 1 AS knows, CASE WHEN row_key % 2 = 1 THEN 'No.' ELSE 'Yes' END AS response,
  CASE WHEN need <= 200 THEN 200 WHEN need <= 400 THEN 400 ELSE 800 END AS "limit",
  CASE WHEN need <= 200 THEN 1 WHEN need <= 400 THEN 2 ELSE 3 END AS attempts
FROM need WHERE row_key < coalesce((SELECT min(row_key) FROM need WHERE need > 800), 9223372036854775807)""",
)
def ask_sequential(spark, sf_dir):
    """F1 + W11 + W10 as one loop: retries under doubled limits, the run ends before the first fatal answer."""
    requests = R.build_requests(B.results(spark, sf_dir).drop("knows"), [F.col("row_key").asc()], SEQUENTIAL_MODEL, reasoning=True)
    requests = requests.select("position", "request_id", "name", "prompt")
    out = ask.ask_sequential(requests, rationed_responder, reasoning=True, first_limit=R.RETRY_START, cap=R.RETRY_CAP, first_range=1024)
    return out.results.select("name", "position", "knows", "response", "limit", "attempts")
