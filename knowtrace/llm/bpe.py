"""Byte-level BPE encoding and decoding with padded numpy matrices.

A batch's texts are split by the pattern; pieces not seen before by the worker are laid out,
by bands of length, as rows of padded matrices.  Each round every row merges its leftmost
pair of minimum rank; the matrix then loses one column (each row drops the cell its merge
freed), and rows without a pair to merge leave it.  Pair ranks come from an open-addressing
hash table probed for whole columns at once.  Pieces longer than ``LONG`` bytes, for which
rounds over a row would be quadratic, are merged with a heap instead: same merges, same order.

Defined cases: null text is empty; an empty text has no ids and decodes to no bytes; any text
length is encoded whole; repeated rows are encoded each; an empty table gives no rows; other
columns of the input are ignored.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowtrace.llm.hashing import pieces

NONE = np.int32(2**31 - 1)
LONG = 1024
#: Bytes of text taken at once, cells of one matrix, and pieces a worker keeps before it starts anew.
PIECE = 2 << 20
CELLS = 1 << 18
KEEP = 120_000
_MULT = np.uint64(0x9E3779B97F4A7C15)


def load_ranks(path: str) -> dict[bytes, int]:
    """Rank file (base64 token, blank, rank a line), read on the driver."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairTable:
    """(left id, right id) -> rank of the token they make, by linear probing."""

    def __init__(self, keys: np.ndarray, vals: np.ndarray):
        self.keys, self.vals, self.bits = keys, vals, len(keys).bit_length() - 1

    @classmethod
    def of(cls, ranks: dict[bytes, int]) -> PairTable:
        keys, vals = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    vals.append(rank)
        size = 1 << max(4, (4 * len(keys)).bit_length())
        self = cls(np.full(size, -1, dtype=np.int64), np.full(size, NONE, dtype=np.int32))
        k, v = np.array(keys, dtype=np.int64), np.array(vals, dtype=np.int32)
        at = self._slot(k)
        while len(k):
            free = np.nonzero(self.keys[at] == -1)[0]
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[at[put]], self.vals[at[put]] = k[put], v[put]
            rest = np.ones(len(k), dtype=bool)
            rest[put] = False
            k, v, at = k[rest], v[rest], (at[rest] + 1) & (size - 1)
        return self

    def _slot(self, k: np.ndarray) -> np.ndarray:
        return ((k.view(np.uint64) * _MULT) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; NONE for no pair and for padding (-1)."""
        key = (left.astype(np.int64) << 32 | right.astype(np.int64)).ravel()
        out = np.full(len(key), NONE, dtype=np.int32)
        open_ = np.nonzero((left.ravel() >= 0) & (right.ravel() >= 0))[0]
        at = self._slot(key[open_])
        while len(open_):
            found = self.keys[at]
            hit = found == key[open_]
            out[open_[hit]] = self.vals[at[hit]]
            go = ~hit & (found != -1)
            open_, at = open_[go], (at[go] + 1) & ((1 << self.bits) - 1)
        return out.reshape(left.shape)


class Encoder:
    """Ids of pieces, kept in flat arrays: piece number -> slice of ``flat``."""

    def __init__(self, ranks: dict[bytes, int], pairs: PairTable, pattern: str):
        self.ranks, self.pairs, self.find = ranks, pairs, regex.compile(pattern).findall
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.empty(0, dtype=np.int32)
        self.starts = np.empty(0, dtype=np.int64)
        self.lens = np.empty(0, dtype=np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets (one more than texts) and the ids of all texts."""
        if len(self.index) > KEEP:
            self.reset()
        index, known = self.index, len(self.index)
        numbers, counts = [], np.zeros(len(texts) + 1, dtype=np.int64)
        for i, t in enumerate(texts):
            own = [index.setdefault(p, len(index)) for p in self.find(t or "")]
            counts[i + 1] = len(own)
            numbers.append(np.array(own, dtype=np.int32))
        if len(index) > known:
            self._add([p.encode() for p, n in index.items() if n >= known] if known else [p.encode() for p in index])
        number = np.concatenate([np.empty(0, dtype=np.int32), *numbers])
        each = self.lens[number]
        total = np.concatenate([[0], np.cumsum(each)])
        ids = self.flat[np.repeat(self.starts[number] - total[:-1], each) + np.arange(total[-1])]
        return total[np.cumsum(counts)], ids

    def _add(self, pieces: list[bytes]) -> None:
        found: list = [None] * len(pieces)
        rows = []
        for i, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                found[i] = (whole,)
            elif len(p) > LONG:
                found[i] = self._heap(p)
            else:
                rows.append(i)
        rows.sort(key=lambda i: len(pieces[i]))
        at = 0
        while at < len(rows):
            # a band: pieces up to half again as long as its first, in a matrix of bounded size
            top = max(4, len(pieces[rows[at]]) * 3 // 2)
            end = at
            while end < len(rows) and len(pieces[rows[end]]) <= top and (end - at) * top < CELLS:
                end += 1
            self._matrix([pieces[i] for i in rows[at:end]], rows[at:end], found)
            at = end
        lens = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        new = np.concatenate([np.asarray(x, dtype=np.int32) for x in found])
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lens) - lens])
        self.lens = np.concatenate([self.lens, lens])
        self.flat = np.concatenate([self.flat, new])

    def _matrix(self, pieces: list[bytes], where: list[int], found: list) -> None:
        width = max(map(len, pieces))
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(len(pieces), width)
        size = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        ids = np.where(np.arange(width) < size[:, None], self.byte_ids[raw], np.int32(-1))
        rank = self.pairs(ids[:, :-1], ids[:, 1:])
        row = np.array(where)
        while len(row):
            best = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(row), dtype=np.int64)
            least = rank[np.arange(len(row)), best] if rank.shape[1] else np.full(len(row), NONE)
            over = least == NONE
            for r, x, n in zip(row[over], ids[over], size[over]):
                found[r] = x[:n]
            go = ~over
            row, ids, rank, size, best, least = row[go], ids[go], rank[go], size[go] - 1, best[go], least[go]
            if not len(row):
                return
            n, every = len(row), np.arange(len(row))
            ids[every, best] = least
            keep = np.ones(ids.shape, dtype=bool)
            keep[every, best + 1] = False
            ids = ids[keep].reshape(n, -1)
            keep = np.ones(rank.shape, dtype=bool)
            keep[every, best] = False
            rank = rank[keep].reshape(n, -1)
            if rank.shape[1]:
                to = np.nonzero(best > 0)[0]
                rank[to, best[to] - 1] = self.pairs(ids[to, best[to] - 1], ids[to, best[to]])
                to = np.nonzero(best < rank.shape[1])[0]
                rank[to, best[to]] = self.pairs(ids[to, best[to]], ids[to, best[to] + 1])

    def _heap(self, piece: bytes) -> list[int]:
        ids = self.byte_ids[np.frombuffer(piece, dtype=np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        first = self.pairs(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        one = np.empty(1, dtype=np.int64)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] < len(ids):
                    one[0] = ids[after[x]]
                    n = int(self.pairs(np.array([ids[x]]), one)[0])
                    if n != NONE:
                        heapq.heappush(heap, (n, x, ids[x], int(one[0])))
        return [x for x in ids if x >= 0]


def token_table(ranks: dict[bytes, int]) -> np.ndarray:
    """The bytes of each id."""
    table = np.full(max(ranks.values()) + 1, b"", dtype=object)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """doc_id, ids (array<int>), and with ``decoded`` the bytes that the ids stand for.

    The rank file is read on the driver and broadcast (under 1 MB; its pair table is of fixed size too).
    """
    ranks = load_ranks(path)
    pairs = PairTable.of(ranks)
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pairs.keys, pairs.vals))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value[0], PairTable(*shared.value[1:]), pattern)
        table = token_table(shared.value[0]) if decoded else None
        for b in (part for whole in batches for part in pieces(whole, 1, PIECE)):
            offsets, ids = encoder.encode(b.column(1).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))
            if not decoded:
                yield pa.record_batch([b.column(0), lists], ["doc_id", "ids"])
                continue
            raw = [b"".join(table[ids[x:y]].tolist()) for x, y in zip(offsets, offsets[1:])]
            yield pa.record_batch([b.column(0), lists, pa.array(raw, pa.binary())], ["doc_id", "ids", "bytes"])

    out = "doc_id long, ids array<int>" + ", bytes binary" * decoded
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, out)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """A table with ids, say one read back, and a column ``bytes``: what its ids stand for."""
    shared = encoded.sparkSession.sparkContext.broadcast(load_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_table(shared.value)
        for b in (part for whole in batches for part in pieces(whole, whole.schema.get_field_index("ids"), PIECE)):
            raw = [b"".join(table[ids.values.to_numpy()].tolist()) if ids.is_valid else None for ids in b.column("ids")]
            yield pa.record_batch([*b.columns, pa.array(raw, pa.binary())], [*b.schema.names, "bytes"])

    from pyspark.sql.types import BinaryType, StructField, StructType

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField("bytes", BinaryType())]))
