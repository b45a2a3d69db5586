"""Exact dedup by skew-safe combining.

Texts are normalised (each gap becomes one space) and digested.  Rows combine three
times, and each time the whole text is compared, not the digest alone: within a task
(the partial side of the first aggregate), within a salt of a digest, and over the salts.
A text with any number of copies thus reaches the last step as one row a salt.

Defined cases: null text counts as empty; a null id never wins over another id and is kept
only where all ids of the text are null; repeated rows are copies of each other; an empty
table gives no rows; other columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knowtrace.llm.common import GAP, checked, pinned


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), GAP, " ")


def combine(rows: DataFrame, salts: int = 64) -> DataFrame:
    """digest, body, keep_id, group_size: one row for each different body of (doc_id, digest, body)."""
    salted = rows.groupBy("digest", "body", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"))
    winners = salted.agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return winners.groupBy("digest", "body").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, one row a document.

    The groups are written without their texts: documents find theirs by the digest and a
    second, independent hash of the text, which tells apart texts that share a digest.
    """
    body = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), body.alias("body")).withColumn("digest", F.sha2("body", 256))
    groups = pinned(combine(rows, salts).where("group_size > 1").select("digest", F.xxhash64("body").alias("own"), "keep_id", "group_size"), "exact-groups")
    ids = pinned(rows.select("doc_id", "digest", F.xxhash64("body").alias("own")), "exact-ids")
    found = ids.join(checked(groups), ["digest", "own"], "left")
    found = found.select("doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("digest").alias("text_sha256"))
    first = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("group_size") > 1)
    # rows that repeat the winner's id as well: one of them stays
    again = F.row_number().over(Window.partitionBy("text_sha256", "doc_id").orderBy("keep_id")) == 1
    return found.where(~first).withColumn("kept", F.col("group_size") == 1).unionByName(found.where(first).withColumn("kept", again))
