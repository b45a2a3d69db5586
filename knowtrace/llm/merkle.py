"""Merkle manifest of a dataset, proofs by a butterfly exchange.

Rows are leaves; the leaves of a source, in order of their ids, are cut into aligned blocks of
``fanout ** levels``.  Each block hashes its own subtree.  Then the blocks exchange subtree roots: in round r
a block meets those that differ from it in digit r of its number (base ``fanout``) alone.  All of a group
then hash the same parent, so after the last round every block knows the root and, from what it was
sent, the upper part of its leaves' proofs; nothing is passed down.  A subtree at the ragged end has too few blocks
to answer every partner, so its blocks answer for the missing ones as well.  The tree over the sources is built
by the same exchange, a source for a block.

A round is one shuffle of one row a block (``fanout`` rows meet at most), and there are as many rounds as digits.  Leaves
are numbered without a global sort in one task: range partitions, counts by partition, running sums of those.

Defined cases: nulls are leaves like others (a null id first, a null source first, ``-`` in the hash); rows with one
id are ordered by their leaf, equal rows have equal leaves and stand side by side; an empty text differs from a null one;
an empty table gives no rows; a single row is leaf, subroot and root, its proof is empty; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knowtrace.llm.common import checked, pinned

FANOUT = 3
#: Levels of the tree inside a block: 3 ** 6 = 729 leaves.
BLOCK_LEVELS = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(*fields: Column) -> Column:
    """Digest of the fields, each ``-`` for null, else its length in UTF-8 bytes, a colon and its value."""

    def framed(c: Column) -> Column:
        s = c.cast("string")
        return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))

    return digest(*[framed(c) for c in fields])


def fold(node: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, node, lambda h, step: digest(step["left"], h, step["right"]))


def siblings(proof: Column) -> Column:
    """All siblings of a proof as one text, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), "")


def numbered(rows: DataFrame, group: Sequence[str], order: Sequence[str], kind: str) -> DataFrame:
    """``rows`` with ``at`` (from 0, in order within the group) and ``of`` (rows of the group).

    The sorted rows are written with the number of their range partition, so what is counted and what is read agree.
    """
    by = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("place", F.monotonically_increasing_id())
    placed = pinned(placed.withColumn("part", F.shiftright("place", 33).cast("int")), kind)
    runs = placed.groupBy("part", *group).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    within = Window.partitionBy(*group).orderBy("part") if group else Window.orderBy("part")
    before = F.coalesce(F.sum("n").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.withColumn("before", before).withColumn("of", F.sum("n").over(Window.partitionBy(*group)))
    runs = checked(pinned(runs.select(F.col("part").alias("run_part"), *[F.col(c).alias(f"run_{c}") for c in group], "first", "before", "of"), f"{kind}-runs"))
    same = F.col("part") == F.col("run_part")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"run_{c}"))
    at = F.col("place") - F.col("first") + F.col("before")
    return placed.join(runs, same).select(*rows.columns, at.alias("at"), "of")


def _runs(nodes: Column, fanout: int) -> Column:
    """Parents of a row of nodes."""
    starts = F.sequence(F.lit(1), F.size(nodes), F.lit(fanout))
    return F.transform(starts, lambda i: F.sha2(F.array_join(F.slice(nodes, i, fanout), ""), 256))


def _levels(leaves: Column, up: Column, fanout: int) -> Column:
    """The rows of nodes of a subtree, from the leaves ``up`` levels."""
    rows = F.array(leaves)
    return F.aggregate(F.sequence(F.lit(0), up), rows, lambda a, k: F.when(k == 0, a).otherwise(F.concat(a, F.array(_runs(F.element_at(a, -1), fanout)))))


def _path(levels: Column, i: Column, up: Column, fanout: int) -> Column:
    """Proof of leaf i (from 0) inside its block."""

    def step(k: Column) -> Column:
        at = F.floor(i / F.pow(F.lit(fanout), k)).cast("int")
        first, row = at - at % fanout, F.get(levels, k)
        left = F.array_join(F.slice(row, first + 1, at % fanout), "")
        return F.struct(left.alias("left"), F.array_join(F.slice(row, at + 2, fanout - 1 - at % fanout), "").alias("right"))

    return F.when(up > 0, F.transform(F.sequence(F.lit(0), up - 1), step)).otherwise(F.array().cast(PROOF))


def _depth(n: Column, fanout: int) -> Column:
    """Levels above n nodes until one remains."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(64)), F.struct(n.cast("long").alias("n"), F.lit(0).alias("k")), lambda a, _: F.when(a["n"] > 1, F.struct(F.ceil(a["n"] / fanout).cast("long").alias("n"), (a["k"] + 1).alias("k"))).otherwise(a))["k"]


def butterfly(blocks: DataFrame, tree: Sequence[str], fanout: int = FANOUT, kind: str = "butterfly") -> DataFrame:
    """``blocks`` (tree columns, b: number, of: blocks of the tree, node: root) with ``node`` the tree's root and ``proof``.

    Round r groups the blocks of a tree by their number without digit r; the group's nodes, in order of that digit, hash to the
    node that all its members hold afterwards.
    """
    most = blocks.agg(F.max("of")).first()[0] or 0
    state = blocks.withColumn("proof", F.array().cast(PROOF))
    span = 1  # blocks under a node of this round
    while span < most:
        here, wide = F.floor(F.col("b") / span), span * fanout
        pos = F.col("b") % span
        # blocks that hold this block's node: span, but for the last subtree of the tree
        held = F.least(F.lit(span).cast("long"), F.col("of") - here * span)
        partners = F.sequence(pos, F.lit(span - 1).cast("long"), held)
        own = [c for c in state.columns if c not in tree]
        sent = state.select(*tree, F.struct(*own).alias("block"), F.floor(F.col("b") / wide).alias("parent"), (here % fanout).cast("int").alias("digit"), pos.alias("home"), F.explode(partners).alias("pos"))
        sent = sent.select(*tree, "parent", "pos", F.struct("digit", F.col("block.node").alias("node"), F.when(F.col("home") == F.col("pos"), F.col("block")).alias("block")).alias("m"))
        met = sent.groupBy(*tree, "parent", "pos").agg(F.sort_array(F.collect_list("m")).alias("met"))
        nodes = F.transform("met", lambda m: m["node"])
        met = met.withColumn("nodes", nodes).withColumn("up", F.sha2(F.array_join("nodes", ""), 256))
        met = met.select(*tree, "nodes", "up", F.explode(F.filter("met", lambda m: m["block"].isNotNull())).alias("m"))
        digit = F.col("m.digit")
        step = F.struct(F.array_join(F.slice("nodes", F.lit(1), digit), "").alias("left"), F.array_join(F.slice("nodes", digit + 2, F.lit(fanout)), "").alias("right"))
        # a tree that has come together already waits for the larger ones
        done = F.col("m.block.of") <= span
        state = met.select(*tree, *[F.col(f"m.block.{c}") for c in own if c not in ("node", "proof")], F.when(done, F.col("m.block.node")).otherwise(F.col("up")).alias("node"), F.when(done, F.col("m.block.proof")).otherwise(F.concat("m.block.proof", F.array(step))).alias("proof"))
        state = pinned(state, kind)
        span = wide
    return state


def manifest(leaves: DataFrame, carry: Sequence[str] = (), fanout: int = FANOUT, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """doc_id, source, position, leaf, subroot, root, proof (one step a level, ``left`` and ``right`` siblings joined), ``carry``.

    leaves: doc_id, source, leaf, and the columns named in ``carry``, which travel along.
    """
    leaves = pinned(leaves.select("doc_id", "source", "leaf", *carry), "merkle-leaves")
    rows = numbered(leaves, ["source"], ["doc_id", "leaf"], "merkle-numbered")
    size = fanout**block_levels
    member = F.struct("at", "doc_id", "leaf", *carry)
    blocks = rows.groupBy("source", F.floor(F.col("at") / size).alias("b")).agg(F.sort_array(F.collect_list(member)).alias("members"), F.max("of").alias("leaves"))
    # a block that is all of its source stops where one node remains, others climb all their levels
    blocks = blocks.withColumn("up", F.when(F.col("leaves") <= size, _depth(F.col("leaves"), fanout)).otherwise(F.lit(block_levels)))
    blocks = pinned(blocks.withColumn("of", F.ceil(F.col("leaves") / size)), "merkle-blocks")
    levels = _levels(F.transform("members", lambda m: m["leaf"]), F.col("up"), fanout)

    lower = blocks.select("source", "b", "of", F.get(F.element_at(levels, -1), F.lit(0)).alias("node"))
    trees = pinned(butterfly(lower, ["source"], fanout, "merkle-rounds"), "merkle-trees")
    tops = trees.where("b = 0").select("source", F.col("node").alias("subroot"))
    tops = numbered(tops, [], ["source"], "merkle-sources").select("source", "subroot", F.col("at").alias("b"), "of", F.col("subroot").alias("node"))
    tops = butterfly(tops, [], fanout, "merkle-top-rounds").select(F.col("source").alias("top_source"), "subroot", F.col("node").alias("root"), F.col("proof").alias("top_proof"))
    upper = trees.join(checked(pinned(tops, "merkle-tops")), F.col("source").eqNullSafe(F.col("top_source")))
    upper = pinned(upper.select(F.col("source").alias("up_source"), F.col("b").alias("up_b"), "subroot", "root", F.concat("proof", "top_proof").alias("above")), "merkle-above")

    held = blocks.join(checked(upper), F.col("source").eqNullSafe(F.col("up_source")) & (F.col("b") == F.col("up_b")))
    held = held.withColumn("levels", levels)
    proven = F.transform("members", lambda m, i: F.struct(*[m[c].alias(c) for c in ("at", "doc_id", "leaf", *carry)], _path(F.col("levels"), i, F.col("up"), fanout).alias("below")))
    out = held.select("source", "subroot", "root", "above", F.explode(proven).alias("m"))
    return out.select("m.doc_id", "source", F.col("m.at").alias("position"), "m.leaf", "subroot", "root", F.concat("m.below", "above").alias("proof"), *[F.col(f"m.{c}") for c in carry])


def document_leaves(docs: DataFrame, forge: Column | None = None, fields: Sequence[str] = FIELDS) -> DataFrame:
    """doc_id, source, leaf, forged: the leaf of each row, and of the row with ``forge`` for its text (null without it)."""
    text = fields[-1]
    forged = leaf(*[F.col(c) for c in fields[:-1]], forge) if forge is not None else F.lit(None).cast("string")
    same = forge.eqNullSafe(F.col(text)) if forge is not None else F.lit(True)
    return docs.select(F.col(fields[0]).alias("doc_id"), F.col(fields[1]).alias("source"), leaf(*[F.col(c) for c in fields]).alias("leaf"), F.when(~same, forged).alias("forged"))


def verify(proven: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of a manifest with a column ``forged``.

    The forged leaf, where there is one, is folded with the proof of the leaf that the manifest was made from.
    """
    out = proven.withColumn("folded_root", fold(F.coalesce("forged", "leaf"), F.col("proof")))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
