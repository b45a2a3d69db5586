"""Language-model scoring with a log-frequency Bloom filter.

An n-gram seen ``c`` times is stored as its level ``1 + floor(log_1.5 c)``: the filter holds
(n-gram, 1) up to (n-gram, level), and a count is read back by probing level after level until one
is missing.  The probability of a word after another interpolates the two counts read
this way with the smoothed count of the word alone; the interpolation weight depends on the level
of the context and is fitted over all training tokens with each n-gram's own occurrence left out.

Building: tasks count the n-grams of a piece of their texts, deal them as packed columns to segments by
their hash, and one task a segment adds up the counts and fills that segment's bits.  Segments grow in
number with the text.  A filter of at most ``max_filter_bytes``, words and pairs together, is broadcast.  A
larger one stays in its written segments and the probes go to it: each piece of texts sends its different
keys to their segments and gets their levels back, so nothing of the filter passes through the driver.
Either way the texts are read once to be scored, by the same code, with the same scores.  Each token's three
levels (context, pair, word) are written; the weights are fitted on the counts of equal levels, which is
exact, and then the scores are summed from the written levels.

The exact unigram score beside it takes counts of the ``FREQUENT`` most frequent words (or somewhat fewer: the cut
falls between levels) from a broadcast table, and joins the others.  Words are told apart by their
64-bit hash; of ten million different words, two share one with odds of about 3 in a million.

Defined cases: null text is empty (its only token is the end); a null id counts as learned from;
repeated rows are scored and counted each; without training rows all counts are 0; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowtrace.llm.common import blob_buckets, checked, pinned
from knowtrace.llm.hashing import mix, numbered, pieces, spread, word_hashes

END = b""
STEP = 1.5
HASHES = 5
BITS_EACH = 10
FREQUENT = 1_000_000
#: Bytes of text that a task counts or scores at once.
PIECE = 2 << 20
CONTEXTS = 64
#: Levels are below this: a code is (context * LEVELS + pair) * LEVELS + word.
LEVELS = 128
PACKED = "segment int, keys binary, counts binary"


def held_out(id_col: Column, modulus: int = 7, remainder: int = 2) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % modulus == remainder, F.lit(False))


def levels(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log_STEP(count)), 0 for 0."""
    return np.where(counts > 0, 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(STEP) + 1e-9), 0).astype(np.int64)


def level_bounds(top: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest count of each level; 0 for level 0."""
    low = np.ceil(STEP ** np.arange(top) - 1e-9)
    high = np.maximum(np.ceil(STEP ** np.arange(1, top + 1) - 1e-9) - 1, low)
    return np.concatenate([[0.0], low]), np.concatenate([[0.0], high])


def level_counts(top: int = 128) -> np.ndarray:
    """The mean of the counts that share a level; 0 for level 0."""
    low, high = level_bounds(top)
    return (low + high) / 2


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + mix(word))


def _probe(keys: np.ndarray, level: np.ndarray | int, k: int, bits: np.ndarray) -> np.ndarray:
    """The k-th bit position of (key, level) in a segment of ``bits`` bits."""
    a = mix(keys + np.uint64(0xD6E8FEB86659FD93) * np.asarray(level, dtype=np.uint64))
    return (a + np.uint64(k) * (mix(a) | np.uint64(1))) % bits


def fill(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bits of one segment, as bytes: BITS_EACH a stored level, 64 at least."""
    level = levels(counts)
    size = max(64, -(-int(level.sum()) * BITS_EACH // 64) * 64)
    out = np.zeros(size // 8, dtype=np.uint8)
    for at in range(0, len(keys), 1 << 20):
        k, n = keys[at : at + (1 << 20)], level[at : at + (1 << 20)]
        j = 1
        while len(k):
            for i in range(HASHES):
                p = _probe(k, j, i, np.uint64(size))
                np.bitwise_or.at(out, (p >> np.uint64(3)).astype(np.int64), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))
            j += 1
            k, n = k[n >= j], n[n >= j]
    return out


class Filter:
    """Some segments of the log-frequency filter; a segment's number is ``key % segments``."""

    def __init__(self, segments: int, data: np.ndarray, start: np.ndarray, bits: np.ndarray):
        self.segments, self.data, self.start, self.bits = segments, data, start, bits

    @staticmethod
    def arrays(segments: int, sizes: dict[int, int], parts: Iterable[tuple[int, bytes]]) -> tuple:
        """The arguments of a filter of these segments: plain arrays, to broadcast."""
        size = np.zeros(segments, dtype=np.int64)
        for s, n in sizes.items():
            size[s] = n
        start = np.cumsum(size) - size
        data = np.empty(size.sum(), dtype=np.uint8)
        for s, p in parts:
            data[start[s] : start[s] + size[s]] = np.frombuffer(p, dtype=np.uint8)
        return segments, data, start, (8 * size).astype(np.uint64)

    def level(self, keys: np.ndarray) -> np.ndarray:
        """Levels read by probing; keys of segments not held are 0."""
        out = np.zeros(len(keys), dtype=np.int64)
        left = np.nonzero(self.bits[(keys % np.uint64(self.segments)).astype(np.int64)] > 0)[0]
        j = 1
        while len(left):
            for i in range(HASHES):
                s = (keys[left] % np.uint64(self.segments)).astype(np.int64)
                p = _probe(keys[left], j, i, self.bits[s])
                left = left[(self.data[self.start[s] + (p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1]
            out[left] = j
            j += 1
        return out


class Answers:
    """What a filter's segments answered for these keys (sorted)."""

    def __init__(self, keys: np.ndarray, found: np.ndarray):
        self.keys, self.found = keys, found

    def level(self, keys: np.ndarray) -> np.ndarray:
        return self.found[np.searchsorted(self.keys, keys)].astype(np.int64)


def _tokens(texts: list[bytes | None]) -> list[list[bytes]]:
    return [(t or b"").lower().split() + [END] for t in texts]


def _pairs(flat: np.ndarray, lens: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Key of each token with the one before it; a text's first follows an end."""
    before = np.roll(flat, 1)
    before[np.cumsum(lens) - lens] = flat[np.cumsum(lens) - 1]
    return pair_keys(hashes[before], hashes[flat])


def _segment(keys: np.ndarray, words: int, segments: int) -> np.ndarray:
    """Segments of keys, of which the first ``words`` are words and the others pairs."""
    s = (keys % np.uint64(segments)).astype(np.int64)
    s[words:] += segments
    return s


def counted(rows: DataFrame, segments: int) -> DataFrame:
    """segment, bits, keys, counts: one row a segment, the first ``segments`` for words (key: hash of the
    word), then as many for pairs; keys and counts are those of the words (empty for pairs).
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in pieces(whole, 0, PIECE)):
            flat, lens, different = numbered(_tokens(b.column(0).to_pylist()))
            if not len(flat):
                continue
            h = word_hashes(different)
            pairs, n_pairs = np.unique(_pairs(flat, lens, h), return_counts=True)
            keys, n = np.concatenate([h, pairs]), np.concatenate([np.bincount(flat), n_pairs]).astype(np.uint32)
            s = _segment(keys, len(h), segments)
            order = np.argsort(s, kind="stable")
            s, keys, n = s[order], keys[order], n[order]
            cuts = [*np.nonzero(np.diff(s, prepend=-1))[0], len(s)]
            at = list(zip(cuts, cuts[1:]))
            yield pa.record_batch([pa.array(s[cuts[:-1]], pa.int32()), pa.array([keys[x:y].tobytes() for x, y in at], pa.binary()), pa.array([n[x:y].tobytes() for x, y in at], pa.binary())], ["segment", "keys", "counts"])

    def build(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()])
        n = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("counts").to_pylist()]).astype(np.float64)
        keys, at = np.unique(keys, return_inverse=True)
        n = np.bincount(at, n)
        words = slice(None) if table.column("segment")[0].as_py() < segments else slice(0)
        lists = [pa.array([keys[words].view(np.int64)], pa.list_(pa.int64())), pa.array([n[words].astype(np.int64)], pa.list_(pa.int64()))]
        return pa.table([table.column("segment").slice(0, 1), pa.array([fill(keys, n).tobytes()], pa.binary()), *lists], names=["segment", "bits", "keys", "counts"])

    # as many reduce tasks as segments of a kind: a task's share stays the same when the text grows
    packed = rows.select(F.col("text").cast("binary")).mapInArrow(count, PACKED).repartition(segments, "segment")
    return packed.groupBy("segment").applyInArrow(build, "segment int, bits binary, keys array<long>, counts array<long>")


class Counts:
    """Exact counts of the frequent words, by hash; 0 for others."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.counts[at], 0)


def frequent_words(words: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of the words above the lowest level that leaves at most ``most``."""
    level = F.floor(F.log(F.col("c").cast("double")) / F.log(F.lit(1.1)))
    left, least = most, None
    for r in words.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c")).orderBy(F.desc("level")).collect():  # a few hundred levels
        left -= r.n
        if left < 0:
            break
        least = r.c
    if least is None:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    table = words.where(F.col("c") >= least).select("h", "c").toArrow()
    h, c = table.column("h").to_numpy().view(np.uint64), table.column("c").to_numpy()
    order = np.argsort(h)
    return h[order], c[order]


class Model:
    """p(word | before) from levels.

    Pairs and words count as the least of their level, contexts as the greatest: what follows a context then sums to
    one at most, as its true counts do (but for the filter's false positives, about one key in a hundred).
    """

    def __init__(self, total: int, vocabulary: int, weights: np.ndarray | None = None):
        self.total, self.vocabulary = total, vocabulary
        self.weights = np.full(CONTEXTS, 0.3) if weights is None else weights
        self.least, self.greatest = level_bounds()

    def parts(self, code: np.ndarray, leave: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each code: its weight's number, bigram share, smoothed unigram share."""
        before, pair, word = code // LEVELS**2, code // LEVELS % LEVELS, code % LEVELS
        context, pair = self.greatest[before], np.maximum(self.least[pair] - leave, 0)
        share = np.minimum(np.where(context > leave, pair / np.maximum(context - leave, 1), 0.0), 1.0)
        alone = (np.maximum(self.least[word] - leave, 0) + 1) / (self.total + self.vocabulary + 1)
        return np.minimum(before, CONTEXTS - 1), share, np.minimum(alone, 1.0)

    def log10(self, code: np.ndarray) -> np.ndarray:
        context, share, alone = self.parts(code)
        w = self.weights[context]
        return np.log10(w * share + (1 - w) * alone)

    def fit(self, code: np.ndarray, n: np.ndarray, rounds: int = 20) -> np.ndarray:
        """Interpolation weights by context level (EM) from how often each code occurs, each occurrence left out of its counts."""
        if not len(code):
            return self.weights
        context, share, alone = self.parts(code, leave=1)
        w = np.full(CONTEXTS, 0.3)
        size = np.bincount(context, n, minlength=CONTEXTS)
        for _ in range(rounds):
            a = w[context] * share
            up = np.bincount(context, n * a / (a + (1 - w[context]) * alone), minlength=CONTEXTS)
            w = (up + 1) / (size + 10)  # a few words that the pair does not tell
        return np.clip(w, 1e-4, 0.95)


def read_codes(store: Filter | Answers, flat: np.ndarray, lens: np.ndarray, h: np.ndarray, unigrams: np.ndarray) -> np.ndarray:
    """The codes of the tokens, in order within each text."""
    keys, at = np.unique(_pairs(flat, lens, h), return_inverse=True)
    pair = np.minimum(store.level(keys), LEVELS - 1)[at]
    before = np.roll(flat, 1)
    before[np.cumsum(lens) - lens] = flat[np.cumsum(lens) - 1]
    unigrams = np.minimum(unigrams, LEVELS - 1)
    code = (unigrams[before] * LEVELS + pair) * LEVELS + unigrams[flat]
    # equal levels side by side: they compress well
    return np.sort(np.repeat(np.arange(len(lens)), lens) * LEVELS**3 + code) % LEVELS**3


def pack(code: np.ndarray, n: np.ndarray) -> pa.Array:
    """Per text its codes as three runs of bytes: contexts, pairs, words."""
    out, at = np.empty(3 * len(code), dtype=np.uint8), spread(3 * (np.cumsum(n) - n), n)
    for k, level in enumerate((code // LEVELS**2, code // LEVELS % LEVELS, code % LEVELS)):
        out[at + k * np.repeat(n, n)] = level
    offsets = np.concatenate([[0], np.cumsum(3 * n)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(out)]).cast(pa.binary())


def unpack(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """What ``pack`` was given."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    n = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) // 3
    at, step = spread(3 * (np.cumsum(n) - n), n), np.repeat(n, n)
    before, pair, word = (data[at + k * step].astype(np.int64) for k in range(3))
    return (before * LEVELS + pair) * LEVELS + word, n


def code_counts(part: DataFrame) -> DataFrame:
    """code, n: how often the texts' tokens have each code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (piece for whole in batches for piece in pieces(whole, 0, PIECE)):
            code, n = np.unique(unpack(b.column(0).to_pylist())[0], return_counts=True)
            yield pa.record_batch([pa.array(code, pa.int64()), pa.array(n, pa.int64())], ["code", "n"])

    return part.select("codes").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def summed(part: DataFrame, model: Model) -> DataFrame:
    """The part with the sum of its codes' logarithms as ``score`` in place of the codes."""
    columns = [c for c in part.columns if c != "codes"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in part.select(columns).schema) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (piece for whole in batches for piece in pieces(whole, len(columns), PIECE)):
            code, n = unpack(b.column(len(columns)).to_pylist())
            different, at = np.unique(code, return_inverse=True)
            text = np.repeat(np.arange(len(n)), n)
            each = np.bincount(text, model.log10(different)[at], minlength=len(n))
            yield pa.record_batch([*b.columns[:-1], pa.array(each, pa.float64())], [*columns, "score"])

    return part.select(*columns, "codes").mapInArrow(run, kinds)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_filter_bytes: int = 128 << 20, is_held_out: Column | None = None, tune_docs: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The interpolation weights (CONTEXTS numbers) are fitted on all training texts, or on ``tune_docs``
    of them, the smallest by hash; 0 leaves them at 0.3.
    """
    spark = docs.sparkSession
    out_of = held_out(F.col(id_col)) if is_held_out is None else is_held_out
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), out_of.alias("held_out"))
    train = rows.where("not held_out")

    segments = blob_buckets(train, "text", 4 << 20)
    bits = pinned(counted(train, segments), "filter")
    counts = bits.select(F.explode(F.arrays_zip("keys", "counts")).alias("w")).select(F.col("w.keys").alias("h"), F.col("w.counts").alias("c"))
    total, vocabulary = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    frequent = frequent_words(counts)
    norm = float(np.log10(total + vocabulary + 1))

    held = bits.agg(F.coalesce(F.sum(F.octet_length("bits")), F.lit(0))).first()[0]
    found = pinned((_broadcast_levels if held <= max_filter_bytes else _shuffled_levels)(rows, bits, segments, frequent), "levels")

    tuned = found.where("not held_out")
    if tune_docs is not None:
        tuned = tuned.orderBy(F.xxhash64("doc_id", "tag"), "doc_id", "tag").limit(tune_docs)
    # at most LEVELS^3 rows, a few thousand in practice
    table = code_counts(tuned).orderBy("code").toArrow()
    weights = Model(total, vocabulary).fit(table.column("code").to_numpy(), table.column("n").to_numpy())
    tail = found.select("row", F.explode("tail").alias("t")).select("row", F.col("t.h").alias("h"), F.col("t.n").alias("n"))
    rare = tail.join(counts, "h").groupBy("row").agg(F.sum("n").alias("rare_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("rare_sum"))
    out = summed(found.drop("tail"), Model(total, vocabulary, weights)).join(rare, "row", "left")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_sum", F.lit(0.0)) - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        "score",
    )


LEVELED = "row long, doc_id long, held_out boolean, tag long, n_tokens long, known long, base double, codes binary, tail array<struct<h:long,n:long>>"


def _leveled(row: int, columns: list[pa.Array], flat: np.ndarray, lens: np.ndarray, h: np.ndarray, c: np.ndarray, words: Filter | Answers, pairs: Filter | Answers) -> list[pa.Array]:
    """The columns of LEVELED for a piece of texts; c: exact counts of its words, 0 where only the filter has one."""
    unigrams = levels(c)
    rare = np.nonzero(c == 0)[0]
    unigrams[rare] = words.level(h[rare])
    starts = np.cumsum(lens) - lens
    known = np.add.reduceat((c > 0).astype(np.int64)[flat], starts)
    base = np.add.reduceat(np.log10(c + 1.0)[flat], starts)
    codes = pack(read_codes(pairs, flat, lens, h, unigrams), lens)
    return [pa.array(np.arange(row, row + len(lens)), pa.int64()), *columns, pa.array(lens), pa.array(known), pa.array(base), codes, _tails(flat, lens, h, c == 0)]


def _with_tag(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "held_out", F.xxhash64("text").alias("tag"), F.col("text").cast("binary").alias("text"))


def _broadcast_levels(rows: DataFrame, bits: DataFrame, segments: int, frequent: tuple) -> DataFrame:
    """LEVELED, each task probing the whole filter."""
    names = [x.split()[0] for x in LEVELED.split(", ")]
    sizes = {r[0]: r[1] for r in bits.select("segment", F.octet_length("bits")).collect()}  # a filter within the limit
    parts = {r[0]: r[1] for r in bits.select("segment", "bits").toLocalIterator()}
    both = [
        Filter.arrays(segments, {s - at: sizes[s] for s in parts if at <= s < at + segments}, ((s - at, p) for s, p in parts.items() if at <= s < at + segments))
        for at in (0, segments)
    ]
    share = rows.sparkSession.sparkContext.broadcast((frequent, *both))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, words, pairs = Counts(*share.value[0]), Filter(*share.value[1]), Filter(*share.value[2])
        at = TaskContext.get().partitionId() << 40
        for b in (part for whole in batches for part in pieces(whole, 3, PIECE)):
            flat, lens, different = numbered(_tokens(b.column(3).to_pylist()))
            h = word_hashes(different)
            yield pa.record_batch(_leveled(at, b.columns[:3], flat, lens, h, table(h), words, pairs), names)
            at += len(lens)

    return _with_tag(rows).mapInArrow(run, LEVELED)


def _shuffled_levels(rows: DataFrame, bits: DataFrame, segments: int, frequent: tuple) -> DataFrame:
    """LEVELED, each piece of texts sending its different keys to the filter's segments.

    A piece names a key once, so a frequent pair reaches its segment once a piece, not once a token.
    """
    names = [x.split()[0] for x in LEVELED.split(", ")]
    share = rows.sparkSession.sparkContext.broadcast(frequent)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for b in (part for whole in batches for part in pieces(whole, 3, PIECE)):
            flat, lens, different = numbered(_tokens(b.column(3).to_pylist()))
            if not len(lens):
                continue
            texts = pa.StructArray.from_arrays(b.columns[:3], ["doc_id", "held_out", "tag"])
            texts = pa.ListArray.from_arrays(pa.array([0, len(lens)], pa.int32()), texts)
            blobs = [pa.array([x.tobytes()], pa.binary()) for x in (flat.astype(np.uint32), lens, word_hashes(different))]
            yield pa.record_batch([pa.array([at], pa.int64()), texts, *blobs], ["piece", "texts", "flat", "lens", "hashes"])
            at += len(lens)

    def asked(flat: bytes, lens: bytes, hashes: bytes) -> tuple[np.ndarray, ...]:
        """flat, lens, hashes, exact counts, keys (rare words, then pairs) by segment, their segments, whether a key is a pair's."""
        flat, lens, h = np.frombuffer(flat, np.uint32).astype(np.int64), np.frombuffer(lens, np.int64), np.frombuffer(hashes, np.uint64)
        c = Counts(*share.value)(h)
        rare = np.unique(h[c == 0])
        keys = np.concatenate([rare, np.unique(_pairs(flat, lens, h))])
        s = _segment(keys, len(rare), segments)
        order = np.argsort(s, kind="stable")
        return flat, lens, h, c, keys[order], s[order], order >= len(rare)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece, *blobs in zip(*(c.to_pylist() for c in b.columns)):
                *_, keys, s, _ = asked(*blobs)
                cuts = np.append(np.nonzero(np.diff(s, prepend=-1))[0], len(s))
                sent = pa.array([keys[x:y].tobytes() for x, y in zip(cuts, cuts[1:])], pa.binary())
                yield pa.record_batch([pa.array(s[cuts[:-1]], pa.int32()), pa.array(np.full(len(sent), piece), pa.int64()), sent], ["segment", "piece", "keys"])

    def answer(sent: pa.Table, segment: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint64) for x in sent.column("keys").to_pylist()]
        keys, at = np.unique(np.concatenate(parts), return_inverse=True) if parts else (np.empty(0, np.uint64), np.empty(0, np.int64))
        data = b"".join(segment.column("bits").to_pylist())
        read = Filter(*Filter.arrays(1, {0: len(data)}, [(0, data)])).level(keys)
        found = np.split(np.minimum(read, LEVELS - 1).astype(np.uint8)[at], np.cumsum([len(p) for p in parts])[:-1])
        return pa.table([sent.column("piece"), sent.column("segment"), pa.array([x.tobytes() for x in found[: len(parts)]], pa.binary())], names=["piece", "segment", "levels"])

    def level(piece: pa.Table, answers: pa.Table) -> pa.Table:
        row = piece.to_pylist()[0]
        flat, lens, h, c, keys, _, pair = asked(row["flat"], row["lens"], row["hashes"])
        found = np.frombuffer(b"".join(answers.sort_by("segment").column("levels").to_pylist()), np.uint8)
        by_key = [(k[order], n[order]) for k, n in ((keys[m], found[m]) for m in (~pair, pair)) for order in [np.argsort(k)]]
        texts = piece.column("texts").combine_chunks().flatten()
        columns = [texts.field(i) for i in range(3)]
        return pa.table(_leveled(row["piece"], columns, flat, lens, h, c, *(Answers(*x) for x in by_key)), names=names)

    kinds = "piece long, texts array<struct<doc_id:long,held_out:boolean,tag:long>>, flat binary, lens binary, hashes binary"
    table = pinned(_with_tag(rows).mapInArrow(number, kinds), "pieces")
    sent = table.select("piece", "flat", "lens", "hashes").mapInArrow(ask, "segment int, piece long, keys binary")
    stored = bits.select("segment", "bits").repartition(segments, "segment").groupBy("segment")
    answers = sent.repartition(segments, "segment").groupBy("segment").cogroup(stored).applyInArrow(answer, "piece long, segment int, levels binary")
    answers = answers.repartition(segments, "piece").groupBy("piece")
    return table.repartition(segments, "piece").groupBy("piece").cogroup(answers).applyInArrow(level, LEVELED)


def _tails(flat: np.ndarray, lens: np.ndarray, h: np.ndarray, rare: np.ndarray) -> pa.ListArray:
    """Per text its rare words' hashes and how often each occurs."""
    at = np.nonzero(rare[flat])[0]
    text = np.repeat(np.arange(len(lens)), lens)[at]
    key, n = np.unique(text * len(h) + flat[at], return_counts=True)
    offsets = np.searchsorted(key, np.arange(len(lens) + 1) * len(h))
    items = pa.StructArray.from_arrays([pa.array(h[key % len(h)].view(np.int64) if len(key) else np.empty(0, dtype=np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)
