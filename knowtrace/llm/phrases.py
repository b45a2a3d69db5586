"""Phrase mining on a weighted de Bruijn graph: nodes are runs of ``longest - 1`` words, edges runs of ``longest``.

A first pass counts hashed pairs of neighbours, combined in each task; a pair that stays under ``min_count`` cannot lie in
a phrase that reaches it, so the graph is cut there as at the end of a piece.  Hashes that meet only add to each
other, and the pairs that pass are broadcast as a bitmap of bounded size, so what is cut is never wrong and what is kept may be more
than needed.

The second pass builds, for a few MB of text at a time, the graph of what is left: edges with their weights, nodes with the edges that
leave and enter.  A node with one edge in, one out, and no run of words that starts or ends in it is unary; chains through unary
nodes leave the task as one path with one weight.  What the cut runs end with (fewer words than an edge) leaves as an end correction.
Spark opens the paths, and adds the edges of all graphs up by their words.

Shorter counts come from the edges alone: a node's count is the flow out of it plus its end corrections, and so on from each length
to the next shorter one, down to single words.  Every sum is combined in the task before it is shuffled, so a frequent phrase is
a row a task.  Counts are of whole words, not of hashes.

Defined cases: null text has no words; a null lang is ``und``; repeated rows count again; texts of any length are one row of a
task; ties are broken by the phrase; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knowtrace.llm.common import pinned
from knowtrace.llm.hashing import mix, numbered, pieces, word_hashes

PIECE = 4 << 20
#: Pairs a task holds before it passes them on.
HELD = 1 << 21
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bits of the bitmap for a frequent pair, and in all (32 MB).
BITS_EACH, MOST_BITS = 32, 1 << 28
#: What ends a piece, and the gaps between its words.
ENDS, GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_TABLE = bytes.maketrans(_UPPER + ENDS + GAPS, _UPPER.lower() + b"." * len(ENDS) + b" " * len(GAPS))


class Tokens:
    """The words of a batch in one array; ``.`` stands after each piece and each text."""

    def __init__(self, langs: list[str], texts: list[bytes | None]) -> None:
        split = [[*(t or b"").translate(_TABLE).replace(b".", b" . ").split(), b"."] for t in texts]
        self.flat, lens, self.different = numbered(split)
        self.words = list(chain.from_iterable(split))
        self.langs = sorted(set(langs))
        index = {x: k for k, x in enumerate(self.langs)}
        self.lang = np.repeat(np.array([index[x] for x in langs], dtype=np.int64), lens)
        stop = self.different.index(b".") if self.different else -1
        self.is_word = self.flat != stop

    def pair_hashes(self) -> np.ndarray:
        """Hash of the lang and the words at each position and the next; the last one has no next."""
        own = np.array([xxhash.xxh64_intdigest(x.encode(), 1) for x in self.langs], dtype=np.uint64)
        h = word_hashes(self.different)[self.flat]
        return mix((h[:-1] * BASE + h[1:]) ^ own[self.lang[:-1]])

    def pairs(self) -> np.ndarray:
        return self.is_word[:-1] & self.is_word[1:]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[Tokens]:
    for b in (part for whole in batches for part in pieces(whole, 1, PIECE)):
        if b.num_rows:
            yield Tokens(b.column(0).to_pylist(), b.column(1).to_pylist())


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    heads = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0] if len(keys) else np.empty(0, dtype=np.int64)
    return keys[heads], np.add.reduceat(counts, heads) if len(heads) else counts


def frequent_pairs(rows: DataFrame, min_count: int) -> DataFrame:
    """pair: hashes of the pairs that may occur ``min_count`` times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        out = lambda: pa.record_batch([pa.array(keys.view(np.int64)), pa.array(counts)], ["pair", "n"])
        for t in _batches(batches):
            new, n = np.unique(t.pair_hashes()[t.pairs()], return_counts=True)
            keys, counts = _added(np.concatenate([keys, new]), np.concatenate([counts, n]))
            if len(keys) > HELD:
                yield out()
                keys, counts = keys[:0], counts[:0]
        yield out()

    # combined already, so they are shuffled as they are and added up once
    counted = rows.mapInArrow(run, "pair long, n long").repartition("pair").groupBy("pair").agg(F.sum("n").alias("n"))
    return pinned(counted.where(F.col("n") >= min_count).select("pair"), "phrase-pairs")


def bitmap(pairs: DataFrame, most_bits: int = MOST_BITS) -> np.ndarray:
    """A bitmap (one byte eight slots, a power of two of them) of the pairs' low bits."""
    bits = 1 << 15
    wanted = min(most_bits, pairs.count() * BITS_EACH)
    while bits < wanted:
        bits *= 2
    slot = F.col("pair").bitwiseAND(F.lit(bits - 1)) + 1
    parts = pairs.groupBy(F.bitmap_bucket_number(slot).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    out = np.zeros(bits // 8, dtype=np.uint8)
    for part, own in parts.toLocalIterator():
        at = (part - 1) * 4096
        out[at : at + 4096] = np.frombuffer(bytes(own), np.uint8)[: len(out) - at]
    return out


def graph(t: Tokens, joined: np.ndarray, longest: int) -> Iterator[tuple[int, int, int, int]]:
    """(from, to, weight, end) token ranges: unary paths of the batch's graph, and end corrections.

    joined: whether a position and the next belong together.
    """
    n, v = len(t.flat), len(t.different)
    # reach: words from a position on within its run, up to the longest
    reach = t.is_word.astype(np.int64)
    on = np.append(joined, False)
    for _ in range(longest - 1):
        reach = np.where(t.is_word, 1 + np.where(on, np.append(reach[1:], 0), 0), 0)
    reach = np.minimum(reach, longest)
    starts = t.is_word & ~np.concatenate([[False], joined])
    ids, size = t.lang * v + t.flat, v  # exact numbers of the runs of 1, 2, ... words at each position
    numbers = [ids]
    for k in range(2, longest):
        at = np.nonzero(reach >= k)[0]
        key = numbers[-1][at] * size + (t.flat[at + 1] if k == 2 else numbers[-1][at + 1])
        own = np.zeros(n, dtype=np.int64)
        different, own[at] = np.unique(key, return_inverse=True)
        numbers.append(own)
        size = max(1, len(different))
    node, nodes = numbers[-1], size
    # the corrections: what a run ends with, whole if it is shorter than a node
    for k in range(1, longest):
        at = np.nonzero((reach == k) & (starts if k < longest - 1 else True))[0]
        _, first, weight = np.unique(numbers[k - 1][at], return_index=True, return_counts=True)
        yield from zip(at[first].tolist(), (at[first] + k).tolist(), weight.tolist(), [1] * len(first))
    at = np.nonzero(reach == longest)[0]
    if not len(at):
        return
    _, first, weight = np.unique(node[at] * nodes + node[at + 1], return_index=True, return_counts=True)
    order = np.argsort(first)
    first, weight = at[first[order]], weight[order]
    out_edges, in_edges = (np.bincount(node[x], minlength=nodes) for x in (first, first + 1))
    apart = np.bincount(node[(reach == longest - 1) | (starts & (reach >= longest - 1))], minlength=nodes)
    unary = (out_edges == 1) & (in_edges == 1) & (apart == 0)
    # an edge that leaves a unary node first occurs right after the one that enters it
    head = np.concatenate([[True], ~((first[1:] == first[:-1] + 1) & unary[node[first[1:]]])])
    last = np.append(head[1:], True)
    yield from zip(first[head].tolist(), (first[last] + longest).tolist(), weight[head].tolist(), [0] * int(head.sum()))


def paths(rows: DataFrame, bits: np.ndarray, longest: int) -> DataFrame:
    """lang, words, n, ends: paths of the graphs of all batches, and their end corrections."""
    held = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        last = np.uint64(len(own) * 8 - 1)
        for t in _batches(batches):
            slot = t.pair_hashes() & last
            hit = own[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1
            found = list(graph(t, t.pairs() & (hit == 1), longest))
            for k in range(0, len(found), 1 << 16):
                a, b, n, ends = zip(*found[k : k + (1 << 16)])
                text = [b" ".join(t.words[x:y]) for x, y in zip(a, b)]
                lang = [t.langs[x] for x in t.lang[list(a)].tolist()]
                yield pa.record_batch([pa.array(lang, pa.string()), pa.array(text, pa.binary()), pa.array(n, pa.int64()), pa.array(ends, pa.int32())], ["lang", "words", "n", "ends"])

    return rows.mapInArrow(run, "lang string, words binary, n long, ends int")


def edges(found: DataFrame, longest: int) -> DataFrame:
    """lang, phrase, m (words), f: edges of the whole graph by their words, and end corrections (fewer than ``longest`` words)."""
    w = F.split(F.col("words").cast("string"), " ")
    rows = found.select("lang", "n", "ends", w.alias("w"))
    places = F.sequence(F.lit(1), F.when(F.col("ends") == 1, F.size("w")).otherwise(F.size("w") - (longest - 1)))
    grams = F.transform(places, lambda i: F.array_join(F.slice("w", i, longest), " "))
    summed = rows.select("lang", "n", F.explode(grams).alias("phrase")).groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
    blanks = F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit("")))
    return pinned(summed.select("lang", "phrase", (blanks + 1).alias("m"), "f"), "phrase-edges")


def counts(whole: DataFrame, longest: int) -> list[DataFrame]:
    """lang, phrase, f for phrases of 1, 2, ... words: flow out of the next longer ones plus end corrections."""
    level = whole.where(F.col("m") == longest).select("lang", "phrase", "f")
    out = [level]
    for k in range(longest - 1, 0, -1):
        ends = whole.where(F.col("m") == k).select("lang", "phrase", "f")
        flow = level.unionByName(ends).select("lang", F.substring_index("phrase", " ", k).alias("phrase"), "f")
        level = pinned(flow.groupBy("lang", "phrase").agg(F.sum("f").alias("f")), "phrase-counts")
        out.append(level)
    return out[::-1]


def score(heavy: DataFrame) -> DataFrame:
    """lang, phrase, m, a, l, r, score of the phrases of two words or more: the lowest-scoring cut, ties to the first.

    heavy: lang, phrase, m, f of every phrase that counts, single words included.
    """
    pairs = heavy.where("m > 1").select("lang", "phrase", "m", F.col("f").alias("a"), F.explode(F.expr("sequence(1, m - 1)")).alias("k"))
    pairs = pairs.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring(phrase, length(first) + 2)"))
    left = heavy.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = heavy.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    cut = pairs.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    cut = cut.withColumn("score", F.expr("(CAST(a AS DECIMAL(20,0)) * 2000000BD) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))"))
    best = cut.groupBy("lang", "phrase", "m", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    return best.select("lang", "phrase", "m", "a", "c.l", "c.r", "c.score")


def dominated(heavy: DataFrame, longest: int, hundredths: int) -> DataFrame:
    """lang, phrase of those inside a longer one that has ``hundredths`` of their count or more."""
    longer = heavy.where("m > 2").withColumn("w", F.split("phrase", " "))
    spans = [(s, k) for k in range(2, longest) for s in range(longest - k + 1)]
    inner = F.array(*[F.when(F.col("m") >= F.greatest(F.lit(s + k), F.lit(k + 1)), F.array_join(F.slice("w", s + 1, k), " ")) for s, k in spans])
    most = longer.select("lang", F.explode(inner).alias("phrase"), "f").where("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    own = heavy.where("m > 1").select("lang", "phrase", "f")
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    return own.join(most, ["lang", "phrase"]).where(wide("most") * 100 >= wide("f") * hundredths).select("lang", "phrase")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 4, min_count: int = 30, hundredths: int = 80, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each lang's ``top`` phrases of 2 to ``longest`` words."""
    if longest < 3:
        raise ValueError("longest must be 3 or more")
    rows = docs.select(F.coalesce(lang_col, F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("text"))
    found = paths(rows, bitmap(frequent_pairs(rows, min_count)), longest)
    levels = counts(edges(found, longest), longest)
    total = levels[0].groupBy("lang").agg(F.sum("f").alias("n"))
    heavy = levels[0].withColumn("m", F.lit(1))
    for m, level in enumerate(levels[1:], 2):
        heavy = heavy.unionByName(level.withColumn("m", F.lit(m)))
    heavy = pinned(heavy.where(F.col("f") >= min_count), "phrase-heavy")
    kept = score(heavy).join(dominated(heavy, longest, hundredths), ["lang", "phrase"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    out = ranked.join(total, "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
