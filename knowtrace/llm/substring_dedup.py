"""Substring dedup: Rabin-Karp hashes of every window of ``width`` words.

One pass hashes all windows (a polynomial of the word hashes modulo 2^64, built for all
positions at once), keeps of each hash the earliest place of the piece at hand, and deals
these to buckets by hash as packed columns; every later place of the piece is a repeat
already.  So a passage that stands in a third of all documents reaches its bucket once a piece,
not once a document.  A bucket counts the places of each hash, spares the earliest and returns the others,
packed and dealt by document; there they merge into maximal word intervals, which a second pass removes.

Buckets grow in number with the text, so one holds about as much at any size.  Windows are compared
by two hashes from independent word hashes: 64 bits of one inside the bucket that the other picks.  As
buckets grow with the text, the pairs compared grow with it and not with its square: at 30 GB the odds
of one false repeat anywhere are about 1 in 3600 (about one at 100 TB).

Defined cases: null text has no words; a null doc_id sorts last, as 2^63 - 1; rows that repeat
both id and text are one document (each keeps what the other keeps); rows that share
an id but not the text are different documents, ordered by a hash of the text; texts shorter
than a window stay whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowtrace.llm.common import blob_buckets, checked, pinned
from knowtrace.llm.hashing import mix, numbered, pieces, spread, word_hashes

BASE = 0x9E3779B97F4A7C15 | 1
LAST = 2**63 - 1
#: Intervals (8 bytes each) up to which they are broadcast with their documents, of which few must be, too.
BROADCAST_INTERVALS = 2_000_000
#: Bytes of text that a task compares at once before it packs the rest for the buckets.
PIECE = 4 << 20
PACKED = "bucket int, repeats boolean, docs binary, tags binary, runs binary, gaps binary, hashes binary"


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words from each position on (the last ones wrap and are not for use)."""
    out, at, step, span = np.zeros(len(h), dtype=np.uint64), 0, h, 1
    while True:  # binary expansion of the width: step is the hash of `span` words
        if width & span:
            out = out + np.roll(step, -at) * np.uint64(pow(BASE, at, 2**64))
            at += span
        if span * 2 > width:
            return mix(out)
        step = step + np.roll(step, -span) * np.uint64(pow(BASE, span, 2**64))
        span *= 2


def _pack(bucket: np.ndarray, doc: np.ndarray, pos: np.ndarray, ids: np.ndarray, tags: np.ndarray, hashes: np.ndarray | None) -> Iterator[tuple]:
    """Rows of PACKED, one a bucket; doc numbers rows of ids and tags, order is (doc, pos) within a bucket."""
    order = np.lexsort((pos, doc, bucket))
    bucket, doc, pos = bucket[order], doc[order], pos[order]
    cuts = np.nonzero(np.diff(bucket, prepend=-1))[0]
    for a, b in zip(cuts, [*cuts[1:], len(bucket)]):
        d, p = doc[a:b], pos[a:b]
        head = np.nonzero(np.diff(d, prepend=-1))[0]
        gap = np.diff(p, prepend=0)
        gap[head] = p[head]
        run = np.diff([*head, b - a])
        yield (int(bucket[a]), hashes is None, *(x.tobytes() for x in (ids[d[head]], tags[d[head]], run.astype(np.uint32), gap.astype(np.uint32))), b"" if hashes is None else hashes[order[a:b]].tobytes())


def _unpack(row: dict) -> tuple[np.ndarray, ...]:
    """ids, tags, pos, hashes of one packed row."""
    run = np.frombuffer(row["runs"], np.uint32).astype(np.int64)
    total = np.cumsum(np.frombuffer(row["gaps"], np.uint32).astype(np.int64))
    starts = np.cumsum(run) - run
    before = np.where(starts > 0, total[starts - 1], 0)
    pos = total - np.repeat(before, run)
    return np.repeat(np.frombuffer(row["docs"], np.int64), run), np.repeat(np.frombuffer(row["tags"], np.int64), run), pos, np.frombuffer(row["hashes"], np.uint64)


def _spare_first(ids: np.ndarray, tags: np.ndarray, pos: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which places are not the earliest of their hash."""
    order = np.argsort(hashes, kind="stable")
    s = hashes[order]
    same = np.zeros(len(s) + 1, dtype=bool)
    same[1:-1] = s[1:] == s[:-1]
    order = order[same[1:] | same[:-1]]  # hashes with two places or more
    order = order[np.lexsort((pos[order], tags[order], ids[order], hashes[order]))]
    s = hashes[order]
    head = np.concatenate([[True], s[1:] != s[:-1]])[: len(s)]
    first = order[np.maximum.accumulate(np.where(head, np.arange(len(s)), 0))]
    late = (ids[order] != ids[first]) | (tags[order] != tags[first]) | (pos[order] != pos[first])
    return order[late]


def repeats(docs: DataFrame, width: int, buckets: int) -> DataFrame:
    """PACKED rows of window starts whose words also start earlier, dealt by document; no hashes."""
    names = [x.split()[0] for x in PACKED.split(", ")]
    kinds = [pa.int32(), pa.bool_(), *[pa.binary()] * 5]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in pieces(whole, 2, PIECE)):
            ids, tags = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            order = np.lexsort((tags, ids))  # by document, as places are compared
            raw = b.column(2).to_pylist()
            ids, tags = ids[order], tags[order]
            flat, lens, different = numbered([(raw[i] or b"").split() for i in order])
            places = np.maximum(lens - width + 1, 0)
            if not places.any():
                continue
            at = spread(np.cumsum(lens) - lens, places)
            h, other = (window_hashes(word_hashes(different, seed)[flat], width)[at] for seed in (42, 43))
            doc, pos = np.repeat(np.arange(len(lens)), places), spread(np.zeros(len(lens), dtype=np.int64), places)
            late = np.zeros(len(h), dtype=bool)
            # rows that repeat id and text share their places, so a batch compares by them as a bucket does
            late[_spare_first(ids[doc], tags[doc], pos, h)] = True
            early = ~late
            rows = list(_pack((other[early] % np.uint64(buckets)).astype(np.int64), doc[early], pos[early], ids, tags, h[early]))
            if late.any():
                rows += _pack(_by_document(ids, tags, buckets)[doc[late]], doc[late], pos[late], ids, tags, None)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def counted(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        parts = [_unpack(r) for r in rows]
        done = [p for p, r in zip(parts, rows) if r["repeats"]]
        parts = [p for p, r in zip(parts, rows) if not r["repeats"]]
        if parts:
            ids, tags, pos, h = (np.concatenate(x) for x in zip(*parts))
            late = _spare_first(ids, tags, pos, h)
            done.append((ids[late], tags[late], pos[late]))
        ids, tags, pos = (np.concatenate([p[i] for p in done]) for i in range(3))
        doc, ids, tags, pos = _documents(ids, tags, pos)
        out = list(_pack(_by_document(ids, tags, buckets)[doc], doc, pos, ids, tags, None))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds], names=names)

    # as many reduce tasks as buckets: a task's share stays the same when the text grows
    packed = docs.mapInArrow(hashed, PACKED).repartition(buckets, "bucket")
    return packed.groupBy("bucket").applyInArrow(counted, PACKED)


def _by_document(ids: np.ndarray, tags: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of documents; by id and text, so that rows without an id do not share one."""
    return (mix(ids.view(np.uint64) ^ mix(tags.view(np.uint64))) % np.uint64(buckets)).astype(np.int64)


def _documents(ids: np.ndarray, tags: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, ...]:
    """Places in order as document numbers and positions, and the documents' ids and tags."""
    order = np.lexsort((pos, tags, ids))
    ids, tags, pos = ids[order], tags[order], pos[order]
    new = np.ones(len(ids), dtype=bool)
    new[1:] = (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])
    return np.cumsum(new) - 1, ids[new], tags[new], pos


def intervals(found: DataFrame, width: int, buckets: int) -> DataFrame:
    """doc_id, tag, starts, ends: maximal word intervals covered by the windows, one row a document."""

    def merged(table: pa.Table) -> pa.Table:
        parts = [_unpack(r) for r in table.to_pylist()]
        doc, ids, tags, pos = _documents(*(np.concatenate([p[i] for p in parts]) for i in range(3)))
        # a new interval at a new document or beyond the reach of the window before
        new = np.ones(len(doc), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] - pos[:-1] > width)
        last = np.append(new[1:], True)[: len(new)]
        offsets = pa.array(np.searchsorted(doc[new], np.arange(len(ids) + 1)), pa.int32())
        starts, ends = (pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (pos[new], pos[last] + width))
        return pa.table([pa.array(ids), pa.array(tags), starts, ends], names=["doc_id", "tag", "starts", "ends"])

    return found.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(merged, "doc_id long, tag long, starts array<int>, ends array<int>")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20, bucket_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, n_words, n_removed, starts, ends (removed word intervals), kept (words left, joined by a space).

    bucket_bytes: text whose windows a bucket holds on average; a task needs about six times as much.
    """
    if width < 1:
        raise ValueError("width must be positive")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(LAST))
    keyed = rows.select(key.alias("doc_id"), F.xxhash64("text").alias("tag"), F.col("text").cast("binary").alias("text"))
    buckets = blob_buckets(rows, "text", bucket_bytes)
    cuts = pinned(intervals(repeats(keyed, width, buckets), width, buckets), "intervals")
    cuts = cuts.select(F.col("doc_id").alias("of"), F.col("tag").alias("of_tag"), "starts", "ends")
    held = cuts.agg(F.coalesce(F.sum(F.size("starts")), F.lit(0))).first()[0]
    cuts = checked(cuts) if held <= BROADCAST_INTERVALS else cuts
    joined = rows.join(cuts, (key == F.col("of")) & (F.xxhash64("text") == F.col("of_tag")), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in pieces(whole, 1, PIECE)):
            n, gone, kept = [], [], []
            for text, starts, ends in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                w = text.split()
                n.append(len(w))
                for s, e in zip(reversed(starts or ()), reversed(ends or ())):
                    del w[s:e]
                gone.append(n[-1] - len(w))
                kept.append(b" ".join(w))
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), b.column(2), b.column(3), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "starts", "ends", "kept"])

    out = joined.select("doc_id", F.col("text").cast("binary").alias("text"), "starts", "ends")
    out = out.mapInArrow(cut, "doc_id long, n_words long, n_removed long, starts array<int>, ends array<int>, kept binary")
    return out.withColumn("kept", F.col("kept").cast("string"))
