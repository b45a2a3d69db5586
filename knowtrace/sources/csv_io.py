"""Entity and results CSV sources/sinks.

Wire format of the reference: UTF-8, header, every field quoted, quotes
doubled, NULL written as an empty quoted field.  Spark options that
round-trip it: read ``escape='"', multiLine=true``; write ``quoteAll=true,
escape='"'`` with leading/trailing whitespace kept.  Columns are found by their
header names, read as strings and typed afterwards; files of one path may have
different headers, each is read by its own.
``multiLine`` keeps each file in one partition, so many run files read in
parallel; one large file is one task, so keep outputs in many files.

Sinks write once, to a folder beside the target that takes its place only if rows came (:mod:`publish`).
"""

from __future__ import annotations

import csv
import os
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from knowtrace.functions.core import day_key, parse_date, tri_state, tri_state_text
from knowtrace.sources.publish import publish

ENTITY_FIELDS = ["name", "death_date", "description", "pageviews"]
RESULT_FIELDS = ENTITY_FIELDS + ["llm_knows_death", "llm_response"]

READ_OPTS = {"header": "true", "escape": '"', "multiLine": "true", "mode": "FAILFAST"}
WRITE_OPTS = {
    "header": "true",
    "quoteAll": "true",
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "emptyValue": "",
    "nullValue": "",
}


#: Files up to which headers are read by opening each; beyond it by a scan of the text.
OPENED_FILES = 512


def _first_line(spark: SparkSession, path) -> str:
    jvm = spark.sparkContext._jvm
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(path)
    try:
        return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine() or ""
    finally:
        stream.close()


def headers(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """The files of a path by their header row (one line); files without any line are left out."""
    jvm = spark.sparkContext._jvm
    text = spark.read.text(path)
    as_path = lambda uri: jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(uri))
    files = text.inputFiles()
    if len(files) <= OPENED_FILES:
        paths = [as_path(f) for f in files]
        with ThreadPoolExecutor(16) as pool:
            lines = dict(zip((p.toString() for p in paths), pool.map(lambda p: _first_line(spark, p), paths)))
    else:
        rows = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
        first = rows.where("start = 0").groupBy("file").agg(F.min_by("value", "row").alias("line"))
        lines = {as_path(r.file).toString(): r.line for r in first.toLocalIterator()}
    out: dict[tuple[str, ...], list[str]] = {}
    for name, line in lines.items():
        if line:
            out.setdefault(tuple(next(csv.reader([line.removeprefix("\ufeff")]))), []).append(name)
    return out


def _frames(spark: SparkSession, path: str) -> list[DataFrame]:
    """One path's files as strings, columns named by the header; one frame for each different header.

    Headers are read first; the rows are read with theirs as an all-string schema, so a
    ``run=<label>`` partition stays text.
    """
    found = headers(spark, path)
    read = lambda h, paths, **more: spark.read.schema(_string_schema(list(h))).options(**READ_OPTS, enforceSchema="false", **more).csv(paths)
    if len(found) == 1:
        return [read(next(iter(found)), path)]
    base = {} if any(c in path for c in "*?[{") else {"basePath": path}
    single = [h for h, files in found.items() if files == [path]]
    return [read(h, files, **({} if h in single else base)) for h, files in found.items()]


def _string_schema(fields: list[str]) -> T.StructType:
    return T.StructType([T.StructField(f, T.StringType(), True) for f in fields])


def _read(spark: SparkSession, paths, fields: list[str], missing_ok: bool, order: bool = False) -> DataFrame:
    paths = [paths] if isinstance(paths, str) else list(paths)
    parts = []
    for path in paths:
        try:
            frames = _frames(spark, path)
        except AnalysisException as e:
            if missing_ok and "PATH_NOT_FOUND" in str(e):
                continue
            raise
        for df in frames:
            # By name: other columns are left out, absent ones read as empty.  ``run`` is the
            # K6 partition column itself, so a filter on it prunes run folders.
            cols = [F.col(f"`{f}`") if f in df.columns else F.lit(None).cast("string").alias(f) for f in [*fields, "run"]]
            parts.append(df.select(*cols, F.col("_metadata.file_name").alias("file_name"), *([file_order().alias("file_order")] if order else [])))
    if parts:
        return reduce(DataFrame.unionByName, parts)
    empty = spark.createDataFrame([], _string_schema([*fields, "run", "file_name"]))
    return empty.withColumn("file_order", F.lit(None).cast("struct<file:string,row:bigint>")) if order else empty


def file_order() -> Column:
    """Order of the rows of multi-line CSV files: by file name, then as they stand in the file.

    Such a file is read by one task from its start, so the task's running number grows along it.  It is not a
    row number: take it for sorting and ties only, and attach it where the file is read.
    """
    return F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"))


def read_entities(spark: SparkSession, paths, missing_ok: bool = False, order: bool = False) -> DataFrame:
    """Entity CSV -> ``name, death_date DATE, description, pageviews BIGINT``.

    ``order`` adds ``file_order`` (:func:`file_order`), the tie column that keeps equal rows as in the file.

    ``pageviews`` is a strict cast (garbage raises, like ``int()``); a missing
    value counts as 0, as the reference's ``get('pageviews', 0)``.
    """
    df = _read(spark, paths, ENTITY_FIELDS, missing_ok, order)
    return df.select(
        F.coalesce(F.col("name"), F.lit("")).alias("name"),
        parse_date("death_date").alias("death_date"),
        F.coalesce(F.col("description"), F.lit("")).alias("description"),
        F.coalesce(F.col("pageviews").cast("bigint"), F.lit(0).cast("bigint")).alias("pageviews"),
        "file_name",
        *(["file_order"] if order else []),
    )


def read_results(spark: SparkSession, paths, missing_ok: bool = False, order: bool = False) -> DataFrame:
    """Results CSV with the exact-match tri-state (``'True'``/``'False'``/else NULL).

    ``order`` adds ``file_order``, as in :func:`read_entities`.

    ``missing_ok`` gives an empty frame for a missing path (the monthly
    script's behaviour); otherwise a missing file raises (the main script's).
    """
    df = _read(spark, paths, RESULT_FIELDS, missing_ok, order)
    return df.select(
        F.coalesce(F.col("name"), F.lit("")).alias("name"),
        parse_date("death_date").alias("death_date"),
        F.coalesce(F.col("description"), F.lit("")).alias("description"),
        F.coalesce(F.col("pageviews").cast("bigint"), F.lit(0).cast("bigint")).alias("pageviews"),
        tri_state("llm_knows_death").alias("knows"),
        F.coalesce(F.col("llm_response"), F.lit("")).alias("response"),
        "file_name",
        "run",
        *(["file_order"] if order else []),
    )


def versioned_path(base: str, version: str) -> str:
    """K5: ``deaths.csv`` -> ``deaths_v<version>.csv`` (a directory for Spark)."""
    stem, ext = os.path.splitext(base)
    return f"{stem}_v{version}{ext}"


def _write(df: DataFrame, path: str, mode: str, partition_by: list[str] | None, order: list[Column] | None = None, shown: list[Column] | None = None) -> bool:
    """Write the rows, or nothing at all for an empty run: an earlier output then stays.

    Ordered rows are sorted by the partition columns first: the writer then finds them in its own
    order and does not sort them anew within a partition.
    """
    rows = df.orderBy(*(partition_by or []), *order) if order else df
    rows = rows.select(*shown) if shown else rows

    def save(w, folder: str) -> None:
        w = w.options(**WRITE_OPTS)
        (w.partitionBy(*partition_by) if partition_by else w).csv(folder)

    return publish(rows, path, save, mode)


def order_breaks(spark: SparkSession, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """O1 on disk: where an entity CSV is not sorted by date ascending and views descending; no row if it is.

    ``partition``, ``file``, ``kind``: ``rows`` for neighbours within a file, ``files`` for the last row of a
    file and the first of the next in name order (of its partition folder).  Files are compared by their ends, so
    one row a file meets in a window; within a file the rows meet in the window of that file, as the reader has them in one task.
    """
    parts = partition_by or []
    rows = _read(spark, path, ENTITY_FIELDS, False, True)
    folder = F.regexp_extract(F.col("file_order.file"), r"^(.*)/[^/]*$", 1)
    key = F.struct(F.col("death_date").alias("day"), (-F.col("pageviews").cast("bigint")).alias("views"))
    keyed = rows.select((folder if parts else F.lit("")).alias("partition"), F.col("file_order.file").alias("file"), F.col("file_order.row").alias("row"), key.alias("key"))
    before = F.lag("key").over(Window.partitionBy("partition", "file").orderBy("row"))
    inside = keyed.withColumn("before", before).where(F.col("before") > F.col("key")).select("partition", "file", F.lit("rows").alias("kind")).distinct()
    ends = keyed.groupBy("partition", "file").agg(F.min_by("key", "row").alias("first"), F.max_by("key", "row").alias("last"))
    before = F.lag("last").over(Window.partitionBy("partition").orderBy("file"))
    across = ends.withColumn("before", before).where(F.col("before") > F.col("first")).select("partition", "file", F.lit("files").alias("kind"))
    return inside.unionByName(across)


def write_entities(
    df: DataFrame,
    path: str,
    version: str | None = None,
    mode: str = "overwrite",
    tie: str = "name",
    partition_by: list[str] | None = None,
) -> bool:
    """K1: ``name, death_date, description, pageviews`` sorted by date, views desc (O1)."""
    if version is not None:
        path = versioned_path(path, version)
    extra = partition_by or []
    columns = [*ENTITY_FIELDS, *(c for c in [tie, *extra] if c not in ENTITY_FIELDS)]
    rows = df.select(*columns)
    shown = [F.col("name"), day_key("death_date").alias("death_date"), F.col("description"), F.col("pageviews").cast("string").alias("pageviews")]
    order = [F.col("death_date").asc(), F.col("pageviews").desc(), F.col(tie).asc()]
    return _write(rows, path, mode, partition_by, order, [*shown, *extra])


def write_results(
    df: DataFrame,
    path: str,
    run: str | None = None,
    mode: str = "overwrite",
    knows: str = "knows",
    response: str = "response",
) -> bool:
    """K2/K6: the fixed six result columns; ``run`` becomes a ``run=<label>`` partition.

    Extra columns are an error (the reference's writer raises on unknown keys).
    """
    allowed = set(ENTITY_FIELDS) | {knows, response, "run"}
    extra = [c for c in df.columns if c not in allowed]
    if extra:
        raise ValueError(f"unexpected result columns: {extra}")
    out = df.select(
        F.col("name"),
        day_key("death_date").alias("death_date"),
        F.col("description"),
        F.col("pageviews").cast("string").alias("pageviews"),
        tri_state_text(knows).alias("llm_knows_death"),
        F.col(response).alias("llm_response"),
        *([F.lit(run).alias("run")] if run is not None else ([F.col("run")] if "run" in df.columns else [])),
    )
    parts = ["run"] if "run" in out.columns else None
    return _write(out, path, mode, parts)
