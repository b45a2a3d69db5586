"""Corpus pipeline: five stages, each one of the operators of ``knowtrace.llm``.

A stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again as
the next one's docs.  All but the last return the columns of documents; every decision takes effect:
rejected, repeated, near-copied and untaken documents go, a document taken twice stands twice.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knowtrace.llm import bpe, exact_dedup, mixing, simhash, toxicity
from knowtrace.llm.common import checked, pinned, words
from knowtrace.llm.queries import RANKS, bpe_digests

REJECT_AT = 0.3


def _packed(docs: DataFrame, key: Column) -> DataFrame:
    """row (all columns of docs), id, key: no name of a document's columns is left to clash with a helper's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), key.alias("key"))


def _without(docs: DataFrame, key: Column, dropped: DataFrame, again: DataFrame | None = None) -> DataFrame:
    """The rows of docs whose (doc_id, key) is not in ``dropped`` (id, key), those in ``again`` once; columns as they are.

    Both are written and counted first: broadcast where few, shuffled where not.
    """
    rows = _packed(docs, key)

    def of(table: DataFrame, kind: str) -> tuple[DataFrame, Column]:
        table = checked(pinned(table.toDF("of_id", "of_key").distinct(), kind))
        return table, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("key") == F.col("of_key"))

    rows = rows.join(*of(dropped, "dropped"), "left_anti")
    if again is None or again.isEmpty():
        return rows.select("row.*")
    table = of(again, "repeated-rows")
    once = rows.join(*table, "left_semi").dropDuplicates(["id", "key"])
    return rows.join(*table, "left_anti").unionByName(once).select("row.*")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger scores under REJECT_AT; it learns from the labels of ``docs``.

    Null and empty texts are scored as texts without tokens; rows that repeat id and text are judged alike; texts of any length are
    scored whole; an empty table gives no rows.
    """
    scored = toxicity.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, F.xxhash64("text"), scored.where(F.col("score") >= REJECT_AT).select("doc_id", "tag"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null is empty), the document with the smallest doc_id; rows that repeat its id and text stand once.

    Rows without an id go where the text has an id, else one stays.  Texts of any length, empty tables: as the operator.
    """
    groups = pinned(exact_dedup.exact_groups(docs).select("doc_id", "text_sha256", "kept"), "groups")
    kept, gone = (groups.where(F.col("kept") == k).select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("key")) for k in (True, False))
    again = pinned(kept.intersect(gone), "again")
    same = F.col("id").eqNullSafe(F.col("again_id")) & (F.col("key") == F.col("again_key"))
    gone = gone.join(again.toDF("again_id", "again_key"), same, "left_anti")
    return _without(docs, F.sha2(exact_dedup.normalised(F.col("text")), 256), gone, again)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id, of equal ids that with the least text hash.

    A group without ids keeps one row too; of rows that repeat the winner's id and text one stays.  Null and blank texts
    are near copies of each other (fingerprint zero); an empty table gives no rows.
    """
    found = pinned(simhash.near_duplicates(docs, width=4, distance=4).select("doc_id", "tag", "root"), "near")
    groups = pinned(found.groupBy("root").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "near-groups")
    held = found.join(groups.drop("n"), "root")
    firsts = held.where(F.col("doc_id").eqNullSafe(F.col("first"))).groupBy("root").agg(F.min("tag").alias("first_tag"))
    held = pinned(held.join(firsts, "root").withColumn("wins", F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("tag") == F.col("first_tag"))), "near-held")
    again = held.where("wins").groupBy("doc_id", "tag").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "tag")
    return _without(docs, F.xxhash64("text"), held.where("NOT wins").select("doc_id", "tag"), again)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, row by row: rows that share id and size need not be taken alike.

    Null and blank texts have no words and are not taken; a null source is a source; an empty table gives no rows.
    """
    taken = mixing.mix(docs, carry=True).select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("turn"))
    return taken.select("row.*")


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, repeated ones too; a null text is empty (no ids)."""
    return bpe_digests(bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, decoded=True))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_dedup_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("byte-level BPE", bpe_stage),
]

#: The classifier, the hashes and the merges are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = pinned(docs, "stage-" + name.replace(" ", "-"))
    return docs
