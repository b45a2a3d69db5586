"""SimHash near-dedup with pivot distance tables.

Fingerprints that occur more than once are collapsed first.  Two fingerprints within ``d``
bits agree on at least ``BLOCKS - d`` of ``BLOCKS`` bit blocks, so every pair of blocks
(six blocks, at most four bits) is a key under which all links of a cell are found.  Inside a cell
the distance table decides: each fingerprint's distances to the pivots are computed
once, rows are ordered by the first of them, a pair is discarded as soon as one coordinate
differs by more than ``d`` (the triangle inequality), and only survivors are verified bit by bit.

The pivots alone can't propose pairs at scale: distances of unrelated fingerprints to
any pivot gather around 32 with a deviation of 4, so each keeps about half of all pairs.

A cell emits a spanning forest of its links, not the pairs.  A key with more than ``cell_rows``
fingerprints is dealt over cells that hold two of its chunks each; every pair of chunks meets
in one cell, so no link is lost and no task holds more than two chunks of a key.

Defined cases: null and blank texts have fingerprint zero and link like any other; repeated
rows are members of the same component; a null id is never a component's id unless the
component has no other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowtrace.llm.common import checked, pinned
from knowtrace.llm.components import components

SEED = 42
BLOCKS = 6
PIVOTS = 32


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """SimHash of the lower-cased (A-Z) word shingles of a UTF-8 text; no words: 0."""
    w = (text or b"").lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    ends = list(accumulate(map(len, w), lambda at, n: at + 1 + n))
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[min(width, len(w)) - 1 :])], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """doc_id, tag (a hash of the text), fp (the 64 bits as a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in b.column(2)], dtype=np.uint64)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(fps.view(np.int64), pa.int64())], ["doc_id", "tag", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tag"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, tag long, fp long")


def block_keys(distance: int) -> list[tuple[int, int]]:
    """(shift, mask) pairs whose bits make the keys: all choices of blocks that must agree."""
    if not 0 <= distance < BLOCKS:
        raise ValueError(f"distance must be 0 to {BLOCKS - 1}")
    edges = [round(64 * i / BLOCKS) for i in range(BLOCKS + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(masks, BLOCKS - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivots(n: int = PIVOTS) -> np.ndarray:
    """The reference fingerprints: hashes of their numbers."""
    return np.array([xxhash.xxh64_intdigest(str(i).encode(), SEED) for i in range(n)], dtype=np.uint64)


def merge(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the sets of the linked rows; a label is the smallest row of its set."""
    while len(i):
        a, b = labels[i], labels[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while (labels[labels] != labels).any():
            labels[:] = labels[labels]


def links(fp: np.ndarray, cell: np.ndarray, side: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside each cell (rows come ordered by cell).

    side: 0 within its chunk, 1 or 2 for the two chunks of a cell of two.
    """
    table = np.bitwise_count(fp[:, None] ^ pivots()[None, :]).astype(np.int16)
    # by cell, then by the distance to the first pivot
    order = np.lexsort((table[:, 0], cell))
    fp, cell, side, table = fp[order], cell[order], side[order], table[order]
    labels = np.arange(len(fp))
    left = np.arange(len(fp))
    lag = 1
    while True:
        left = left[left + lag < len(fp)]
        right = left + lag
        near = (cell[left] == cell[right]) & (table[right, 0] - table[left, 0] <= distance)
        left = left[near]
        if not len(left):
            break
        a, b = left, left + lag
        open_ = (labels[a] != labels[b]) & ((side[a] != side[b]) | (side[a] == 0))
        a, b = a[open_], b[open_]
        for k in range(1, table.shape[1]):
            if not len(a):
                break
            close = np.abs(table[a, k] - table[b, k]) <= distance
            a, b = a[close], b[close]
        true = np.bitwise_count(fp[a] ^ fp[b]) <= distance
        merge(labels, a[true], b[true])
        lag += 1
    member = np.nonzero(labels != np.arange(len(fp)))[0]
    return fp[labels[member]], fp[member]


def near_links(distinct: DataFrame, distance: int, cell_rows: int = 4096) -> DataFrame:
    """a, b: links that connect all different fingerprints within ``distance`` bits."""
    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for k, m in enumerate(block_keys(distance))])
    keyed = distinct.select("fp", F.explode(keys).alias("key")).select("fp", F.xxhash64("key.k", "key.bits").alias("key"))
    large = pinned(keyed.groupBy("key").count().where(F.col("count") > cell_rows).select(F.col("key").alias("of"), F.ceil(2 * F.col("count") / cell_rows).cast("int").alias("chunks")), "large-cells")
    keyed = keyed.join(checked(large), F.col("key") == F.col("of"), "left").drop("of")
    # chunk c meets every chunk once: cell (low, high); side 0 in its own cell
    chunk = F.pmod(F.xxhash64(F.lit(1), "fp"), "chunks").cast("int")
    many = keyed.where("chunks is not null").withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    side = F.when(F.col("chunk") == F.col("other"), 0).when(F.col("chunk") < F.col("other"), 1).otherwise(2)
    many = many.select("fp", F.xxhash64("key", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("cell"), side.cast("int").alias("side"))
    cells = keyed.where("chunks is null").select("fp", F.col("key").alias("cell"), F.lit(0).alias("side")).unionByName(many)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell; the last cell of a batch waits for the next."""
        held = [np.empty(0, dtype=np.int64)] * 3
        for b in _with_end(batches):
            new = held if b is None else [np.concatenate([h, c.to_numpy(zero_copy_only=False).astype(np.int64)]) for h, c in zip(held, b.columns)]
            fp, cell, side = new
            done = len(cell) if b is None else int(np.searchsorted(cell, cell[-1])) if len(cell) else 0
            held = [x[done:] for x in new]
            if done > 1:
                lo, hi = links(fp[:done].view(np.uint64), cell[:done], side[:done], distance)
                yield pa.record_batch([pa.array(lo.view(np.int64)), pa.array(hi.view(np.int64))], ["a", "b"])

    return cells.repartition("cell").sortWithinPartitions("cell").select("fp", "cell", "side").mapInArrow(run, "a long, b long")


def _with_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distance: int = 4, cell_rows: int = 4096) -> DataFrame:
    """doc_id, tag, fp, component_id (smallest id reachable by links), root (a fingerprint, one a component), one row a document."""
    fps = pinned(fingerprints(docs, id_col, text_col, width), "fingerprints")
    classes = pinned(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-classes")
    roots = components(near_links(classes.select("fp"), distance, cell_rows))
    linked = classes.join(roots, F.col("fp") == F.col("node")).select("fp", "root", "first")
    firsts = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = pinned(linked.join(firsts, "root").select(F.col("fp").alias("node"), "root", "component_id"), "components")
    alone = F.col("node").isNull()
    classes = classes.join(checked(linked), F.col("fp") == F.col("node"), "left")
    classes = classes.select(F.col("fp").alias("of"), F.when(alone, F.col("first")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("root", "fp").alias("root"))
    return fps.join(classes, F.col("fp") == F.col("of")).select("doc_id", "tag", "fp", "component_id", "root")


def hex_digits(fp: str = "fp"):
    """The 64 bits as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
