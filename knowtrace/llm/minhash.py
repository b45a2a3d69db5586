"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

A document is the set of its different word shingles.  Its sketch has ``coordinates`` bins, filled in rounds: in round i
of the first half every shingle is thrown into a bin by the round's hash with a value in [i, i + 1); in round
i of the second half every shingle goes to bin i.  A bin keeps its least value, so later rounds
only fill empty bins, and after at most twice as many rounds as bins every bin is full; a document of many shingles needs one
or two rounds.  A coordinate agrees with odds of the similarity, and the share that agrees keeps to it as tightly as in sampling without
replacement, so pairs whose share is below the threshold by a Hoeffding bound (odds ``MISS``) are discarded unseen.

Documents of equal sets are one class.  ``ROWS`` coordinates make a band; classes that share a band are proposed (a pair at the
threshold shares none of 32 bands of 5 with odds of 7e-9).  Proposals that hang together form a cell where whole sets meet
once.  Groups too large for a cell are dealt by band instead, and those too large by pairs of chunks of a band, so that every
proposed pair meets in some cell and no task holds more than two chunks.  A cell compares the sets as bit rows over the
shingles that two of its members share, and emits a spanning forest of its true links, never the pairs.

Shingles are 64-bit hashes; only sets of one cell are compared, so two of 10^4 shingles each err with odds of 10^-11.

Defined cases: null and blank texts have an empty set, link with nothing and stay; texts under ``width`` words are one shingle;
repeated rows are members of one component; a null id is never a component's id unless all ids of the component are null, and
stays then; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowtrace.llm.common import checked, pinned
from knowtrace.llm.components import components
from knowtrace.llm.hashing import mix, numbered, pieces, word_hashes

BANDS = 32
ROWS = 5
COORDINATES = BANDS * ROWS
#: Odds that the sketches of a true link are so unlike that it is discarded.
MISS = 1e-9
#: Base of the polynomial of a shingle's word hashes.
BASE = 0x9E3779B97F4A7C15
EMPTY = np.uint64(2**64 - 1)
PIECE = 4 << 20


def shingle_sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """Sorted different shingle hashes of lower-cased (A-Z) UTF-8 texts; fewer words than ``width`` make one shingle."""
    flat, lens, different = numbered([(t or b"").lower().split() for t in texts])
    h = word_hashes(different)[flat]
    rolled = np.zeros(max(0, len(h) - width + 1), dtype=np.uint64)
    for k in range(width if len(rolled) else 0):
        rolled = rolled * np.uint64(BASE) + h[k : k + len(rolled)]
    rolled = mix(rolled)
    out, at = [], 0
    for n in lens.tolist():
        if n >= width:
            s = np.sort(rolled[at : at + n - width + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        else:
            out.append(np.array([xxhash.xxh64_intdigest(h[at : at + n].tobytes(), n)] if n else [], dtype=np.uint64))
        at += n
    return out


def sketches(sets: list[np.ndarray], coordinates: int = COORDINATES) -> np.ndarray:
    """Fast similarity sketches, one row a set (an empty set keeps empty bins); values carry their round in the top bits."""
    t = coordinates
    round_bits = np.uint64(64 - (2 * t).bit_length())
    out = np.full(len(sets) * t, EMPTY, dtype=np.uint64)
    lens = np.array([len(s) for s in sets], dtype=np.int64)
    x = np.concatenate(sets) if len(sets) else np.empty(0, dtype=np.uint64)
    doc = np.repeat(np.arange(len(sets)), lens)
    for i in range(2 * t):
        if not len(x):
            break
        h = mix(x ^ np.uint64((BASE * (2 * i + 1)) % 2**64))
        place = ((h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else np.full(len(h), i - t)
        value = (mix(h + np.uint64(BASE)) >> (np.uint64(64) - round_bits)) | (np.uint64(i) << round_bits)
        np.minimum.at(out, doc * t + place, value)
        open_ = (out.reshape(-1, t) == EMPTY).any(axis=1)[doc]
        if not open_.all():
            x, doc = x[open_], doc[open_]
    return out.reshape(-1, t)


def band_keys(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One hash a band and sketch."""
    keys = np.zeros((len(sketch), sketch.shape[1] // rows), dtype=np.uint64)
    for k in range(rows):
        keys = mix(keys * np.uint64(BASE) + sketch[:, k::rows][:, : keys.shape[1]])
    return mix(keys + np.arange(1, keys.shape[1] + 1, dtype=np.uint64))


def sketched(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """doc_id, tag (a hash of the text), n (shingles), c1, c2 (digest of the set, null if empty), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in pieces(whole, 2, PIECE)):
            sets = shingle_sets(b.column(2).to_pylist(), width)
            keys = band_keys(sketches(sets)).view(np.int64)
            whole = [xxhash.xxh3_128_digest(s) if len(s) else None for s in sets]
            c1, c2 = ([None if w is None else int.from_bytes(w[a : a + 8], "little", signed=True) for w in whole] for a in (0, 8))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.reshape(-1)))
            yield pa.record_batch([b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), bands], ["doc_id", "tag", "n", "c1", "c2", "bands"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tag"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, tag long, n long, c1 long, c2 long, bands array<long>")


def least_agreeing(percent: int, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """Agreeing coordinates below which a pair is discarded: a true link has fewer with odds of ``miss`` at most."""
    return math.ceil(coordinates * percent / 100 - math.sqrt(coordinates * math.log(1 / miss) / 2))


def cell_links(node: np.ndarray, side: np.ndarray, sets: list[np.ndarray], sketch: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the true links of one cell.

    side: 0 within its chunk, 1 or 2 for the two chunks of a cell of two.
    """
    n = np.array([len(s) for s in sets])
    order = np.argsort(n, kind="stable")
    node, side, sketch, n, sets = node[order], side[order], sketch[order], n[order], [sets[k] for k in order]
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = held >= 2
    columns = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = np.repeat(np.arange(len(n)), n)[keep], columns[column[keep]]
    bits = np.zeros((len(n), -(-int(shared.sum()) // 64)), dtype=np.uint64)
    np.bitwise_or.at(bits, (row, column >> 6), np.uint64(1) << (column & 63).astype(np.uint64))
    label = np.arange(len(n))
    reach = np.searchsorted(n, n * 100 // percent, side="right")  # larger sets cannot be similar enough
    least, out = least_agreeing(percent, sketch.shape[1]), []
    for i in range(len(n) - 1):
        j = np.arange(i + 1, reach[i])
        j = j[(label[j] != label[i]) & ((side[j] != side[i]) | (side[j] == 0))]
        if not len(j):
            continue
        j = j[(sketch[j] == sketch[i]).sum(axis=1) >= least]
        both = np.bitwise_count(bits[j] & bits[i]).sum(axis=1, dtype=np.int64)
        for k in j[100 * both >= percent * (n[j] + n[i] - both)]:
            if label[k] != label[i]:
                out.append((int(node[i]), int(node[k])))
                label[label == label[k]] = label[i]
    return out


def _cells(reps: DataFrame, cell_rows: int, cell_shingles: int) -> DataFrame:
    """node, cell, side: where the sets of proposed classes meet.  reps: node, n, bands."""
    keyed = reps.select("node", "n", F.explode("bands").alias("key"))
    multi = pinned(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles"), F.min("node").alias("least")).where("rows > 1"), "minhash-buckets")
    proposed = pinned(keyed.join(multi, "key"), "minhash-proposed")
    groups = components(proposed.where("least <> node").select(F.col("least").alias("a"), F.col("node").alias("b")))
    member = reps.select("node", "n").join(groups, "node")
    sizes = member.groupBy("root").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles"))
    large = pinned(sizes.where((F.col("rows") > cell_rows) | (F.col("shingles") > cell_shingles)).select("root"), "minhash-large")
    small = member.join(checked(large), "root", "left_anti").select("node", F.xxhash64("root").alias("cell"), F.lit(0).alias("side"))
    # larger groups: by band, and by pairs of chunks where a band's bucket is too large as well
    chunks = F.greatest(F.ceil(2 * F.col("rows") / cell_rows), F.ceil(2 * F.col("shingles") / cell_shingles)).cast("int")
    chunks = F.when((F.col("rows") <= cell_rows) & (F.col("shingles") <= cell_shingles), F.lit(1)).otherwise(chunks)
    dealt = proposed.join(member.select("node", "root").join(checked(large), "root", "left_semi"), "node").withColumn("chunks", chunks)
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64(F.lit(1), "node"), "chunks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    side = F.when(F.col("chunk") == F.col("other"), 0).when(F.col("chunk") < F.col("other"), 1).otherwise(2)
    dealt = dealt.select("node", F.xxhash64("key", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("cell"), side.cast("int").alias("side"))
    return small.unionByName(dealt)


def _with_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def verified_links(docs: DataFrame, reps: DataFrame, width: int, percent: int, cell_rows: int, cell_shingles: int) -> DataFrame:
    """a, b: true links that connect all similar classes.  docs: doc_id, tag, text; reps: node, doc_id, tag, n, bands."""
    cells = pinned(_cells(reps, cell_rows, cell_shingles), "minhash-cells")
    wanted = reps.join(cells.select("node").distinct(), "node", "left_semi").select("node", F.col("doc_id").alias("of"), F.col("tag").alias("of_tag"))
    texts = docs.join(checked(pinned(wanted, "minhash-wanted")), F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("tag") == F.col("of_tag")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in pieces(whole, 1, PIECE)):
            sets = shingle_sets(b.column(1).to_pylist(), width)
            low = (sketches(sets) & np.uint64(255)).astype(np.uint8)
            yield pa.record_batch([b.column(0), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([r.tobytes() for r in low], pa.binary())], ["node", "set", "sketch"])

    sets = texts.select("node", F.col("text").cast("binary").alias("text")).mapInArrow(run, "node long, set binary, sketch binary")
    # repeated rows bring a class twice into a cell: equal sets, one link more
    met = sets.join(checked(cells), "node").select("cell", "node", "side", "set", "sketch")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell; the last cell of a batch waits for the next."""
        held: list[tuple] = []
        for b in _with_end(batches):
            rows = held if b is None else [*held, *zip(*(c.to_pylist() for c in b.columns))]
            cell = np.array([r[0] for r in rows], dtype=np.int64)
            cuts = np.nonzero(np.diff(cell, append=cell[-1] + 1 if b is None else cell[-1]))[0] + 1 if len(cell) else []
            at, links = 0, []
            for end in cuts:
                if end - at > 1:
                    _, node, side, sets, low = zip(*rows[at:end])
                    links += cell_links(np.array(node), np.array(side), [np.frombuffer(s, np.uint64) for s in sets], np.frombuffer(b"".join(low), np.uint8).reshape(len(low), -1), percent)
                at = int(end)
            held = rows[at:]
            a, z = zip(*links) if links else ((), ())
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(z, pa.int64())], ["a", "b"])

    return met.repartition("cell").sortWithinPartitions("cell").mapInArrow(verify, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, cell_rows: int = 1024, cell_shingles: int = 1 << 20) -> DataFrame:
    """doc_id, tag, n_shingles, component_id (smallest id reachable by links), kept, one row a document.

    Sets are linked from ``percent`` hundredths of similarity on.  A task holds about ``2 * cell_shingles`` hashes.
    """
    seen = pinned(sketched(docs, id_col, text_col, width), "minhash-sketches")
    classes = seen.where("n > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("first"), F.max("n").alias("n"))
    classes = pinned(classes.withColumn("node", F.monotonically_increasing_id()), "minhash-classes")
    firsts = seen.alias("s").join(classes.select("c1", "c2", "first", "node"), ["c1", "c2"]).where(F.col("doc_id").eqNullSafe(F.col("first")))
    tags = pinned(firsts.groupBy("node").agg(F.min("tag").alias("of_tag")), "minhash-tags")
    reps = firsts.join(tags, "node").where("tag = of_tag").select("node", "doc_id", "tag", "n", "bands").dropDuplicates(["node"])
    reps = pinned(reps, "minhash-representatives")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tag"), F.col(text_col).alias("text"))
    roots = components(verified_links(rows, reps, width, percent, cell_rows, cell_shingles))
    linked = pinned(classes.join(roots, "node").select("node", "root", "first"), "minhash-linked")
    linked = linked.join(linked.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("node", "component_id")
    owners = classes.join(checked(pinned(linked, "minhash-components")), "node", "left")
    owners = owners.select(F.col("c1").alias("o1"), F.col("c2").alias("o2"), F.coalesce("component_id", "first").alias("component_id"))
    out = seen.join(owners, (F.col("c1") == F.col("o1")) & (F.col("c2") == F.col("o2")), "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "tag", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
