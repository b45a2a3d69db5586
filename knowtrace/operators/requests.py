"""Request construction: prompt, settings, ids and the two envelope shapes
(P9-P13, W9, K3 payloads).

The settings table is a 7-row literal joined with an explicit broadcast: its
size is fixed by the code, not by the data.  Request ids are either a dense
0-based ordinal in selection order (the reference's ``"<i>"`` /
``"request-<i>"``) computed without a single-partition window, or a stable
hash of the entity key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knowtrace.functions.core import ColumnOrName, _c

# --- fixed values: prompt texts and limits that must equal the reference -----
PROMPT_TEMPLATE = "Is {name}, {description}, still alive?"
SYSTEM_PLAIN = 'Answer only "Yes" or "No". Nothing else.'
SYSTEM_REASONING = 'Answer only "Yes" or "No". Nothing else. Produce minimal reasoning.'
SYSTEM_TYPED = 'Answer only "Yes" or "No". Nothing else. If unsure, answer "Yes".'
SYSTEM_TYPED_REASONING = 'Answer only "Yes" or "No". Nothing else. Produce minimal reasoning. If unsure, answer "Yes".'
# (family, level, max_tokens, temperature, system, effort, thinking_type, thinking_budget, thinking_level)
SETTINGS_ROWS = [
    ("sequential", "off", 5, 0.0, SYSTEM_PLAIN, "none", None, None, None),
    ("sequential", "on", 200, 1.0, SYSTEM_REASONING, "low", None, None, None),
    ("batch-typed", "off", 2, 0.0, SYSTEM_TYPED, None, "disabled", None, None),
    ("batch-typed", "on", 1026, 1.0, SYSTEM_TYPED_REASONING, None, "enabled", 1024, None),
    ("batch-jsonl", "disabled", 5, 0.0, SYSTEM_PLAIN, None, None, None, None),
    ("batch-jsonl", "minimal", 5, 0.0, SYSTEM_PLAIN, None, None, None, "MINIMAL"),
    ("batch-jsonl", "low", 200, 1.0, SYSTEM_REASONING, None, None, None, "LOW"),
]
RETRY_START, RETRY_CAP = 200, 800
SERVICE_TIER = "flex"
# -----------------------------------------------------------------------------

SETTINGS_SCHEMA = T.StructType(
    [
        T.StructField("family", T.StringType(), False),
        T.StructField("level", T.StringType(), False),
        T.StructField("max_tokens", T.IntegerType(), False),
        T.StructField("temperature", T.DoubleType(), False),
        T.StructField("system", T.StringType(), False),
        T.StructField("effort", T.StringType(), True),
        T.StructField("thinking_type", T.StringType(), True),
        T.StructField("thinking_budget", T.IntegerType(), True),
        T.StructField("thinking_level", T.StringType(), True),
    ]
)


def prompt(name: ColumnOrName, description: ColumnOrName, template: str = PROMPT_TEMPLATE) -> Column:
    """Fill the template; a missing description becomes ''."""
    parts: list[Column] = []
    rest = template
    fields = {"{name}": F.coalesce(_c(name), F.lit("")), "{description}": F.coalesce(_c(description), F.lit(""))}
    while rest:
        hits = [(rest.find(k), k) for k in fields if rest.find(k) >= 0]
        if not hits:
            parts.append(F.lit(rest))
            break
        pos, key = min(hits)
        if pos:
            parts.append(F.lit(rest[:pos]))
        parts.append(fields[key])
        rest = rest[pos + len(key) :]
    return F.concat(*parts)


def settings_table(spark: SparkSession) -> DataFrame:
    """P10: the decision table of section 2.11 as a DataFrame."""
    return spark.createDataFrame(SETTINGS_ROWS, SETTINGS_SCHEMA)


def settings_level(family: ColumnOrName, reasoning: ColumnOrName, model: ColumnOrName, jsonl_level: str = "disabled") -> Column:
    """Which settings row applies: reasoning on/off, or the JSONL thinking level.

    The JSONL family always uses 'low' with reasoning on or for a model that
    allows no lower level; otherwise the level a caller found acceptable.
    """
    fam, r, m = _c(family), _c(reasoning), F.lower(_c(model))
    return (
        F.when(fam == "batch-jsonl", F.when(r | m.contains("gemini-3-pro"), F.lit("low")).otherwise(F.lit(jsonl_level)))
        .when(r, F.lit("on"))
        .otherwise(F.lit("off"))
    )


def attach_settings(df: DataFrame, family: str = "family", level: str = "level") -> DataFrame:
    """Broadcast-join the 7-row settings table on (family, level)."""
    st = settings_table(df.sparkSession).withColumnRenamed("family", "__fam").withColumnRenamed("level", "__lvl")
    joined = df.join(F.broadcast(st), (F.col(family) == F.col("__fam")) & (F.col(level) == F.col("__lvl")), "left")
    return joined.drop("__fam", "__lvl")


def with_ordinal(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """Dense 0-based ordinal in ``order`` without a one-partition window.

    Global sort (range-partitioned, parallel) -> per-partition row counts (one
    row per partition) -> running offsets over those few rows -> offset plus
    the row's index inside its partition.  ``order`` must be a total order.

    The sorted, tagged rows are read by two branches (counts and data).  Each
    branch would otherwise plan its own range shuffle, whose sampled bounds
    are seeded per RDD and need not agree, so the tagged frame is cut with a
    reliable checkpoint into the shared folder first (one eager job): both
    branches then read the same partitions, and a lost executor recomputes
    nothing inconsistent.
    """
    from knowtrace.session import cut_lineage

    tagged = cut_lineage(
        df.orderBy(*order)
        .withColumn("__pid", F.spark_partition_id())
        .withColumn("__mono", F.monotonically_increasing_id())
    )
    counts = tagged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"), F.min("__mono").alias("__first"))
    offsets = counts.withColumn(
        "__off",
        F.coalesce(F.sum("__n").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    )
    # One row per partition: the broadcast is bounded by the partition count.
    out = tagged.join(F.broadcast(offsets.select("__pid", "__off", "__first")), "__pid")
    return out.withColumn(name, (F.col("__off") + F.col("__mono") - F.col("__first")).cast("bigint")).drop(
        "__pid", "__mono", "__off", "__first"
    )


def hash_id(*cols: ColumnOrName) -> Column:
    """Stable request id from an entity key (scale default when no ordinal is needed).

    128 bits: 64-bit ids of some billions of entities would clash and merge answers.
    """
    parts = [F.coalesce(F.concat(F.length(_c(c).cast("string")).cast("string"), F.lit(":"), _c(c).cast("string")), F.lit("-")) for c in cols]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)


def typed_request(request_id: ColumnOrName, model: ColumnOrName, prompt_col: ColumnOrName) -> Column:
    """P12 typed shape: ``{custom_id, params{model, max_tokens, temperature, system, messages, thinking}}``.

    Needs the settings columns (``attach_settings``) in scope.
    """
    thinking = F.struct(
        F.col("thinking_type").alias("type"),
        F.col("thinking_budget").alias("budget_tokens"),
    )
    params = F.struct(
        _c(model).alias("model"),
        F.col("max_tokens").alias("max_tokens"),
        F.col("temperature").cast("int").alias("temperature"),
        F.col("system").alias("system"),
        F.array(F.struct(F.lit("user").alias("role"), _c(prompt_col).alias("content"))).alias("messages"),
        thinking.alias("thinking"),
    )
    return F.to_json(F.struct(_c(request_id).alias("custom_id"), params.alias("params")))


def jsonl_request(key: ColumnOrName, prompt_col: ColumnOrName) -> Column:
    """P12 JSONL shape: ``{key, request{contents, systemInstruction, generationConfig}}``.

    ``thinkingConfig`` appears only when a level is set (NULL fields are
    dropped by ``to_json``).
    """
    gen = F.struct(
        F.col("temperature").alias("temperature"),
        F.col("max_tokens").alias("maxOutputTokens"),
        F.when(F.col("thinking_level").isNotNull(), F.struct(F.col("thinking_level").alias("thinkingLevel"))).alias(
            "thinkingConfig"
        ),
    )
    req = F.struct(
        F.array(
            F.struct(F.array(F.struct(_c(prompt_col).alias("text"))).alias("parts"), F.lit("user").alias("role"))
        ).alias("contents"),
        F.struct(F.array(F.struct(F.col("system").alias("text"))).alias("parts")).alias("systemInstruction"),
        gen.alias("generationConfig"),
    )
    return F.to_json(F.struct(_c(key).alias("key"), req.alias("request")))


def sequential_request(model: ColumnOrName, prompt_col: ColumnOrName) -> Column:
    """P12 sequential shape: ``{model, messages[system, user], max_completion_tokens, temperature, service_tier, reasoning_effort}``.

    Needs the settings columns (``attach_settings``) in scope.
    """
    message = lambda role, text: F.struct(F.lit(role).alias("role"), _c(text).alias("content"))
    return F.to_json(
        F.struct(
            _c(model).alias("model"),
            F.array(message("system", "system"), message("user", prompt_col)).alias("messages"),
            F.col("max_tokens").alias("max_completion_tokens"),
            F.col("temperature").cast("int").alias("temperature"),
            F.lit(SERVICE_TIER).alias("service_tier"),
            F.col("effort").alias("reasoning_effort"),
        )
    )


def build_requests(
    selected: DataFrame,
    order: Sequence[Column],
    model: str,
    reasoning: bool = False,
    jsonl_level: str = "disabled",
    name: str = "name",
    description: str = "description",
) -> DataFrame:
    """T5 tail: ordinal -> prompt -> settings -> request JSON for the model's family.

    Output: ``position, request_id, prompt, family, level, max_tokens,
    temperature, system, payload`` plus the input columns.
    """
    from knowtrace.functions.answers import model_family

    df = with_ordinal(selected, order, "position")
    df = (
        df.withColumn("model", F.lit(model))
        .withColumn("family", model_family("model"))
        .withColumn("level", settings_level("family", F.lit(bool(reasoning)), "model", jsonl_level))
        .withColumn("prompt", prompt(name, description))
    )
    df = attach_settings(df)
    rid = F.when(F.col("family") == "batch-jsonl", F.concat(F.lit("request-"), F.col("position").cast("string"))).otherwise(
        F.col("position").cast("string")
    )
    df = df.withColumn("request_id", rid)
    payload = (
        F.when(F.col("family") == "batch-jsonl", jsonl_request("request_id", "prompt"))
        .when(F.col("family") == "batch-typed", typed_request("request_id", "model", "prompt"))
        .otherwise(sequential_request("model", "prompt"))
    )
    return df.withColumn("payload", payload)


def build_run(
    entities: DataFrame,
    model: str,
    tie: Sequence[str],
    start=None,
    end=None,
    top_per_day: int | None = None,
    top_per_month: int | None = None,
    min_views: int | None = None,
    reasoning: bool = False,
    jsonl_level: str = "disabled",
) -> DataFrame:
    """T5: date range -> minimum views -> top-N -> order -> requests of the model's family."""
    from knowtrace.operators import select

    chosen = entities if start is None and end is None else select.date_range(entities, start, end)
    chosen = select.select_top(chosen, tie, top_per_day, top_per_month, min_views)
    per = "month" if top_per_month else "day" if top_per_day else None
    return build_requests(chosen, select.selection_order(per, tie), model, reasoning, jsonl_level)
