"""Mixing sources to target weights by Pareto order sampling.

Every document first gets the whole copies that are certain; the fractional
rest is an inclusion probability, and a fixed-size sample (in words) is the head
of the order of random odds divided by inclusion odds within each source.

Only DataFrame functions are used.  Nothing is sorted as a whole: the order is cut with a
histogram of ``BINS`` bins, the bin of each source that holds the cut with a finer one, and only
what is left there (a millionth of the order's range) is ranked.

Defined cases: null text has size 0; a null source is a source of its own, last in
order; an empty table gives no rows; a source without words has target 0; repeated rows
are documents of their own (equal rows may be told apart in either order); other columns
of the input are ignored, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knowtrace.llm.common import checked, pinned, words

BINS = 1024
LEVELS = 2


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row a source: source, source_size, target.

    Sources in code-point order (null last) take ``weights`` in turn and share ``share``
    times all words; a target stops at ``cap`` times its source, and what is above goes to
    the others by weight.  That ends at one level: ``target = min(cap * size, level * weight)``.
    The level is found with windows over the sources, of which there are few.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", turn)
    s = s.withColumn("limit", F.col("source_size") * F.lit(float(cap))).withColumn("ratio", F.col("limit") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    filled = F.coalesce(F.sum("limit").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", (F.sum("source_size").over(everything) * F.lit(float(share)) - filled) / left)
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything)
    return s.select("source", "source_size", F.least(F.col("limit"), F.coalesce(level * F.col("weight"), F.col("limit"))).alias("target"))


def uniform(seed: int, *cols: Column) -> Column:
    """A number strictly between 0 and 1 that depends on the columns and the seed alone."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11).cast("double") + 0.5) / float(1 << 53)


def _bin(level: int) -> Column:
    """Bin of ``rank`` among BINS ** level; a power of two, so finer bins lie within coarser ones exactly."""
    bins = BINS**level
    return F.when(F.col("rank").isNotNull(), F.least(F.floor(F.col("rank") * bins), F.lit(bins - 1)))


def cut_bins(drawn: DataFrame) -> DataFrame:
    """of (source), cut_bin, before (words of the bins below): the finest bin that holds each source's cut.

    Each level counts the bins inside the one the level above found, at most BINS a source.
    """
    cut = None
    for level in range(1, LEVELS + 1):
        rows = drawn.where(F.col("rank").isNotNull()).withColumn("bin", _bin(level))
        if cut is None:
            rows = rows.withColumn("before", F.lit(0).cast("long"))
        else:
            rows = rows.join(checked(cut), F.col("source").eqNullSafe(F.col("of")) & (_bin(level - 1) == F.col("cut_bin")))
        fill = rows.groupBy("source", "rest", "before", "bin").agg(F.sum("size").alias("words"))
        upto = F.col("before") + F.sum("words").over(Window.partitionBy("source").orderBy("bin"))
        fill = fill.withColumn("upto", upto).where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("words") < F.col("rest")))
        cut = pinned(fill.select(F.col("source").alias("of"), F.col("bin").alias("cut_bin"), (F.col("upto") - F.col("words")).alias("before")), "mix-cuts")
    return cut


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 7,
    odds_col: str | None = None,
    carry: bool = False,
) -> DataFrame:
    """doc_id, size, source, source_size, target, copies, taken (``copies * size``), one row a document.

    ``carry`` adds ``row``, all columns of the document as a struct, so that copies belong to rows and not to ids.

    ``copies`` is ``floor(target / source_size)`` certain ones, plus one for the documents
    that the Pareto order picks until the rest of the target is filled; of the document
    at the cut the nearer side is chosen.  ``odds_col`` names a positive factor on a
    document's inclusion odds (default 1: within a source all are equally likely).
    The result depends on ids, sizes and the seed only, so reruns agree.
    """
    factor = F.coalesce(F.col(odds_col).cast("double"), F.lit(1.0)) if odds_col else F.lit(1.0)
    whole_row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    sizes = pinned(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.size(words(F.col(text_col))).cast("long").alias("size"), factor.alias("factor"), *whole_row), "mix-sizes")
    targets = source_targets(sizes, weights, share, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    targets = targets.withColumn("whole", whole.cast("long")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    targets = pinned(targets.withColumn("p", F.when(F.col("source_size") > 0, F.col("rest") / F.col("source_size")).otherwise(F.lit(0.0))), "mix-sources")

    s = checked(targets.withColumnRenamed("source", "of"))
    u = uniform(seed, F.col("doc_id"), F.col("size"))
    odds = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")) * F.col("factor"))
    # the order of the odds, mapped to (0, 1) so that bins of equal width cut it finely
    drawn = sizes.join(s, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    drawn = drawn.withColumn("rank", F.when((F.col("p") > 0) & (F.col("size") > 0), odds / (1 + odds)))
    cut = checked(cut_bins(drawn))
    drawn = drawn.withColumn("bin", _bin(LEVELS)).join(cut, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")

    at_cut = F.coalesce(F.col("bin") == F.col("cut_bin"), F.lit(False))
    # without a cut every candidate fits
    clear = drawn.where(~at_cut).withColumn("picked", F.coalesce(F.col("bin") < F.col("cut_bin"), F.col("bin").isNotNull()))
    order = Window.partitionBy("source").orderBy("rank", "doc_id", "size")
    after = F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    near = drawn.where(at_cut).withColumn("after", after)
    near = near.withColumn("picked", F.col("after") - F.col("rest") <= F.col("rest") - (F.col("after") - F.col("size"))).drop("after")
    copies = F.col("whole") + F.col("picked").cast("long")
    both = clear.unionByName(near).withColumn("copies", copies)
    return both.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["row"] if carry else []))
