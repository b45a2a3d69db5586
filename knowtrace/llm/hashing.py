"""Numpy helpers on batches, words and 64-bit hashes, used inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash

_M1 = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x = x ^ (x >> np.uint64(33))
    x = x * _M2
    return x ^ (x >> np.uint64(33))


class Numbers(dict):
    """Numbers things as they are first looked up: ``map(numbers.__getitem__, things)``."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Word numbers of all texts in one array, the texts' lengths, the different words."""
    index = Numbers()
    flat = np.fromiter(map(index.__getitem__, chain.from_iterable(texts)), dtype=np.int64, count=sum(map(len, texts)))
    return flat, np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)), list(index)


def word_hashes(words: list[bytes], seed: int = 42) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, seed) for w in words), dtype=np.uint64, count=len(words))


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), starts[1], ..."""
    if not len(counts):
        return np.empty(0, dtype=np.int64)
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1])


def pieces(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of rows whose column holds about ``most`` bytes, one row at least."""
    share = max(1, -(-batch.column(column).nbytes // most))
    step = max(1, -(-batch.num_rows // share))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)
