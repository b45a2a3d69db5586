"""Quality rules: counted base rules, then a hashed n-gram log-likelihood ratio.

Words and pairs of words hash to ``BUCKETS`` buckets.  Trusted documents (label quality 1) make the
target multinomial, all documents the raw one, both smoothed by one count a bucket.  A document's
score is the mean over its n-grams of log(target / raw): length-normalised, so long and short texts
share one threshold.  Trusted documents fall into ``FOLDS`` folds, and each is scored by the target without its
own fold: no document vouches for itself, and small corpora behave like large ones.  Ratios are
rounded to millionths and summed as integers, so scores do not depend on the order of tasks.

The threshold is ``floor``, lowered where the corpus is so small that more than ``spare`` of the trusted documents
would fall below it.  Every document is judged by it; nothing is drawn at random.

Only DataFrame functions are used.  Both passes explode n-grams inside their tasks: the count
combines them to one row a bucket and task, the score to one row a document, so no shuffle carries
words.  The table of ratios has ``BUCKETS`` rows, which bounds its broadcast.

Defined cases: null text has no words; fewer than 50 words fail the base; a null id is not trusted;
rows that repeat id and text are judged alike; without trusted documents (or an empty table)
all that pass the base are kept, with score 0; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knowtrace.llm.common import checked, let, pinned, words

BUCKETS = 1 << 16
FOLDS = 4
MICRO = 1_000_000
#: A window's hash and its position share a long: positions take the low bits.
POSITION_BITS = 28


def repeated_words(w: Column, width: int = 3) -> Column:
    """Words of an array that lie in a window of ``width`` words found twice or more.

    Hashes and positions are sorted as plain longs, which proposes windows with a neighbour of like
    hash; only those (few) are compared by their words.
    """
    low = (1 << POSITION_BITS) - 1
    places = F.sequence(F.lit(0), F.size(w) - width)

    def key(p: Column) -> Column:
        h = F.xxhash64(*[F.get(w, p + k) for k in range(width)])
        return h.bitwiseAND(F.lit(~low)).bitwiseOR(p.cast("long"))

    def neighbours(s: Column, like) -> Column:
        """Elements that are like the one before or after."""
        return F.filter(s, lambda x, k: F.coalesce(like(x, F.get(s, k - 1)), F.lit(False)) | F.coalesce(like(x, F.get(s, k + 1)), F.lit(False)))

    def same_hash(a: Column, b: Column) -> Column:
        return F.shiftright(a, POSITION_BITS) == F.shiftright(b, POSITION_BITS)

    def spelt(p: Column) -> Column:
        at = p.bitwiseAND(F.lit(low)).cast("int")
        return F.struct(F.array_join(F.slice(w, at + 1, width), " ").alias("words"), at.alias("at"))

    def covered(starts: Column) -> Column:
        reach = F.transform(starts, lambda p, k: F.least(F.lit(width), F.get(starts, k + 1) - p))
        return F.aggregate(reach, F.lit(0), lambda a, x: a + x)

    def told(hits: Column) -> Column:
        true = let(F.sort_array(F.transform(hits, spelt)), lambda s: neighbours(s, lambda a, b: a["words"] == b["words"]))
        return let(F.sort_array(F.transform(true, lambda x: x["at"])), covered)

    proposed = let(F.sort_array(F.transform(places, key)), lambda s: neighbours(s, same_hash))
    counted = let(proposed, lambda hits: F.when(F.size(hits) == 0, F.lit(0)).otherwise(told(hits)))
    return F.when(F.size(w) > width, counted).otherwise(F.lit(0)).cast("long")


def base_rules(rows: DataFrame) -> DataFrame:
    """doc_id, tag and the counted rules of (doc_id, tag, text)."""
    text = F.coalesce("text", F.lit(""))
    # lines without a word cannot equal one with a word, so they are only left out of the count
    worded = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumn("w", words(F.col("text"))).withColumn("lines", worded)
    rows = rows.select(
        "doc_id",
        "tag",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
    )
    return rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def ngram_buckets(w: Column) -> Column:
    """Buckets of all words and all pairs of neighbours."""
    bucket = lambda *x: F.xxhash64(*x).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")
    pairs = F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: bucket(F.get(w, i), F.get(w, i + 1)))).otherwise(F.array().cast("array<int>"))
    return F.concat(F.transform(w, lambda x: bucket(x)), pairs)


def ratios(grams: DataFrame) -> DataFrame:
    """bucket, micro: log ratios in millionths; micro[f] is for documents of fold f (0: not trusted)."""
    by_fold = [F.sum((F.col("fold") == f).cast("long")).alias(f"t{f}") for f in range(1, FOLDS + 1)]
    counts = pinned(grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), *by_fold), "buckets")
    total = counts.agg(F.sum("raw").alias("raw_all"), *[F.sum(f"t{f}").alias(f"t{f}_all") for f in range(1, FOLDS + 1)])
    counts = counts.crossJoin(F.broadcast(total))  # one row
    folds = range(1, FOLDS + 1)
    here, overall = (sum((F.col(f"t{f}{x}") for f in folds[1:]), F.col(f"t1{x}")) for x in ("", "_all"))

    def micro(n: Column, n_all: Column) -> Column:
        target = (n + 1.0) / (n_all + float(BUCKETS))
        raw = (F.col("raw") + 1.0) / (F.col("raw_all") + float(BUCKETS))
        return F.when(n_all > 0, F.round(F.log(target / raw) * MICRO)).otherwise(F.lit(0.0)).cast("long")

    return counts.select("bucket", F.array(micro(here, overall), *[micro(here - F.col(f"t{f}"), overall - F.col(f"t{f}_all")) for f in folds]).alias("micro"))


def threshold(scored: DataFrame, floor: float, spare: float) -> DataFrame:
    """One row, ``at``: the floor, or the hundredth below which at most ``spare`` of the trusted fall."""
    bins = scored.where("fold > 0").groupBy(F.floor(F.col("score") * 100).cast("int").alias("bin")).count()
    upto = F.sum("count").over(Window.orderBy("bin"))
    whole = F.sum("count").over(Window.partitionBy())
    low = bins.select("bin", (upto <= whole * spare).alias("spared")).agg(F.min(F.when(~F.col("spared"), F.col("bin"))).alias("b"))
    return low.select(F.least(F.lit(float(floor)), F.coalesce(F.col("b") / 100.0, F.lit(float(floor)))).alias("at"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", floor: float = -0.1, spare: float = 0.002) -> DataFrame:
    """doc_id, the base rules, base_failed, score, threshold, kept: one row a document."""
    trusted = checked(pinned(labels.where("quality = 1").select(F.col("doc_id").alias("of")).distinct(), "trusted"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    fold = F.when(F.col("of").isNotNull(), 1 + F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(FOLDS))).otherwise(F.lit(0)).cast("int")
    rows = rows.join(trusted, F.col("doc_id") == F.col("of"), "left").select("doc_id", "text", F.xxhash64("text").alias("tag"), fold.alias("fold"))
    grams = rows.withColumn("w", words(F.col("text"))).select("doc_id", "tag", "fold", F.explode(ngram_buckets(F.col("w"))).alias("bucket"))

    table = F.broadcast(pinned(ratios(grams), "ratios"))  # BUCKETS rows at most
    sums = grams.join(table, "bucket").groupBy("doc_id", "tag", "fold").agg(F.sum(F.get("micro", F.col("fold"))).alias("micro"), F.count(F.lit(1)).alias("n"))
    scored = pinned(sums.withColumn("score", F.col("micro") / (F.col("n") * float(MICRO))), "quality-scores")
    cut = F.broadcast(threshold(scored, floor, spare))  # one row
    scored = scored.select(F.col("doc_id").alias("of"), F.col("tag").alias("of_tag"), "score")
    out = base_rules(rows).join(scored, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("tag") == F.col("of_tag")), "left").crossJoin(cut)
    out = out.withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.col("at")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", F.col("at").alias("threshold"), "kept")
