"""Toxicity: a linear-chain conditional random field tags toxic spans.

Tokens are labelled from document labels: in a toxic document, a token is toxic if its word or
one of its prefixes is far more frequent among toxic than among clean documents.  The field has two states,
hashed features of the token (word, prefixes, ending, shape) and learned transitions, and is trained by
gradient ascent on its likelihood.  Forward-backward marginals of every token give the offending
offsets, and their sum, maximum and density the document's score, by a logistic function fitted on
the same sample and weighted to the true share of toxic labels.

Only text is looked at: labels, language, source and id are never inputs of a score.  The fit
sees at most ``docs_each`` toxic and twice as many clean labelled documents (smallest by hash, of at
most ``MAX_CHARS`` characters, near copies once); scores cover every whole text.  A chain starts anew every ``CHAIN``
tokens, which keeps the recursion in numpy columns of equal length however long a text is.

Defined cases: null and blank texts have no tokens and get the score of a document without
toxic tokens; a null id is scored and not learned from; repeated rows are scored each; without
labels of both kinds every score is 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowtrace.llm.common import checked, pinned
from knowtrace.llm.hashing import Numbers, numbered, pieces, spread

BUCKETS = 1 << 18
CHAIN = 128
DOCS_EACH = 1500
MAX_CHARS = 20_000
KEEP = 200_000
BLOCK = 1 << 11  # chains decoded at once
WIDTH = 9  # features a token
PARTS = 6  # of which word and prefixes
BIAS = zlib.crc32(b"bias")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def codes(tokens: Iterable[str], n: int) -> np.ndarray:
    """WIDTH 32-bit hashes of each of ``n`` tokens: its word, the word's prefixes (PARTS together), ending, shape, bias.

    -1 stands for none: a prefix as long as the word, or any part of a token without letters and digits.
    """

    def each() -> Iterator[int]:
        for token in tokens:
            w = _EDGE.sub("", token).lower()
            yield zlib.crc32(b"w=" + w.encode()) if w else -1
            for k in range(3, 8):
                yield zlib.crc32(b"%d=" % k + w[:k].encode()) if len(w) > k else -1
            yield zlib.crc32(b"-" + w[-3:].encode())
            yield zlib.crc32(b"shape %d%d%d" % (token.isupper(), token.isalpha(), w.isalnum()))
            yield BIAS

    return np.fromiter(each(), dtype=np.int64, count=n * WIDTH).reshape(n, WIDTH)


def features(code: np.ndarray) -> np.ndarray:
    """Places of the weights; BUCKETS (a weight of 0) for none."""
    return np.where(code >= 0, code % BUCKETS, BUCKETS)


def chains(lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token positions of chains as (chain, CHAIN), -1 for none, of texts laid end to end; and the chains' lengths."""
    pieces = -(-lens // CHAIN)
    starts = spread(np.zeros(len(lens), dtype=np.int64), pieces) * CHAIN + np.repeat(np.cumsum(lens) - lens, pieces)
    size = np.minimum(np.repeat(np.cumsum(lens), pieces) - starts, CHAIN)
    at = starts[:, None] + np.arange(CHAIN)
    return np.where(np.arange(CHAIN) < size[:, None], at, -1), size


def forward_backward(emission: np.ndarray, size: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of state 1 for (chain, step) log potentials, and the expected transitions of each chain (2 x 2).

    The potential of state 0 is 1; both recursions are scaled at each step.
    """
    n, steps = emission.shape
    e, a = np.exp(np.clip(emission, -30, 30)), np.exp(np.clip(trans, -30, 30))
    f0, f1 = np.empty((steps, n)), np.empty((steps, n))
    p0, p1 = np.full(n, 0.5), np.full(n, 0.5)
    for t in range(steps):
        x0, x1 = (p0, p1 * e[:, t]) if t == 0 else (p0 * a[0, 0] + p1 * a[1, 0], (p0 * a[0, 1] + p1 * a[1, 1]) * e[:, t])
        z = x0 + x1
        p0, p1 = x0 / z, x1 / z
        f0[t], f1[t] = p0, p1
    gamma, pairs = np.zeros((n, steps)), np.zeros((n, 2, 2))
    b0, b1 = np.ones(n), np.ones(n)
    for t in range(steps - 1, -1, -1):
        live = t < size
        # a chain's last step starts the backward recursion
        b0, b1 = np.where(t == size - 1, 1.0, b0), np.where(t == size - 1, 1.0, b1)
        g0, g1 = f0[t] * b0, f1[t] * b1
        gamma[:, t] = np.where(live, g1 / (g0 + g1), 0.0)
        if t:
            c0, c1 = b0, b1 * e[:, t]
            w = [f0[t - 1] * a[0, 0] * c0, f0[t - 1] * a[0, 1] * c1, f1[t - 1] * a[1, 0] * c0, f1[t - 1] * a[1, 1] * c1]
            z = np.where(live, sum(w), np.inf)
            pairs += np.stack([x / z for x in w], axis=1).reshape(n, 2, 2)
            b0, b1 = a[0, 0] * c0 + a[0, 1] * c1, a[1, 0] * c0 + a[1, 1] * c1
            z = b0 + b1
            b0, b1 = b0 / z, b1 / z
    return gamma, pairs


def summary(marginals: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Document features of the tokens' marginals: sum, maximum, density."""
    out = np.zeros((len(lens), 4))
    full = lens > 0
    if full.any():
        at = (np.cumsum(lens) - lens)[full]
        total = np.add.reduceat(marginals, at)
        out[full, 0] = np.log1p(total)
        out[full, 1] = np.maximum.reduceat(marginals, at)
        out[full, 2] = np.log1p(100 * total / lens[full])
    out[:, 3] = 1.0
    return out


class Tagger:
    """The field's weights; emissions of tokens are kept by token."""

    def __init__(self, weights: np.ndarray, trans: np.ndarray, logistic: np.ndarray):
        self.weights, self.trans, self.logistic = weights, trans, logistic
        self.known: dict[str, float] = {}

    def emissions(self, tokens: list[str]) -> np.ndarray:
        if len(self.known) > KEEP:
            self.known.clear()
        new = [t for t in tokens if t not in self.known]
        if new:
            self.known.update(zip(new, self.weights[features(codes(new, len(new)))].sum(axis=1).tolist()))
        return np.array([self.known[t] for t in tokens])

    def marginals(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Of all tokens in a row, and the texts' lengths."""
        flat, lens, index = numbered(texts)
        if not len(flat):
            return np.zeros(0), lens
        return self.decoded(self.emissions(index)[flat], lens), lens

    def decoded(self, emission: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Marginals of tokens with these emissions, texts end to end."""
        out = np.empty(len(emission))
        at, size = chains(lens)
        for k in range(0, len(at), BLOCK):
            p = at[k : k + BLOCK]
            gamma, _ = forward_backward(np.where(p >= 0, emission[p], 0.0), size[k : k + BLOCK], self.trans)
            out[p[p >= 0]] = gamma[p >= 0]
        return out

    def scores(self, marginals: np.ndarray, lens: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(summary(marginals, lens) @ self.logistic, -30, 30)))


def marked_tokens(flat: np.ndarray, lens: np.ndarray, kind: np.ndarray, code: np.ndarray, least: float = 1.8) -> np.ndarray:
    """Which tokens have a word or prefix whose share of toxic documents is exp(least) times that of clean ones, or more."""
    n = len(code)
    pair = np.unique(np.repeat(np.arange(len(lens)), lens) * n + flat)  # each token of a document once
    doc, token = pair // n, pair % n
    enough, out = max(4, int(kind.sum()) // 100), np.zeros(n, dtype=bool)
    for k in range(PARTS):
        values, number = np.unique(code[:, k], return_inverse=True)
        seen = np.unique(doc * len(values) + number[token])
        toxic = kind[seen // len(values)]
        bad, good = (np.bincount(seen[x] % len(values), minlength=len(values)) for x in (toxic, ~toxic))
        odds = np.log((bad + 0.5) / (kind.sum() + 1)) - np.log((good + 0.5) / ((~kind).sum() + 1))
        out |= ((bad >= enough) & (odds >= least) & (values >= 0))[number]
    return out


def train(toxic: list[str], clean: list[str], share: float, rounds: int = 50, rate: float = 0.3, l2: float = 2e-6) -> tuple:
    """Weights, transitions and logistic coefficients; share: of toxic documents among the labelled."""
    index, parts = Numbers(), []
    for t in [*toxic, *clean]:  # only numbers of tokens are kept
        parts.append(np.fromiter(map(index.__getitem__, t.split()), dtype=np.int32))
    flat, lens = np.concatenate(parts), np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    del parts
    model = Tagger(np.zeros(BUCKETS + 1), np.zeros((2, 2)), np.zeros(4))
    kind = np.arange(len(lens)) < len(toxic)
    marginals = np.zeros(len(flat))
    if len(flat):
        code = codes(index, len(index))
        y = (marked_tokens(flat, lens, kind, code)[flat] & np.repeat(kind, lens)).astype(float)
        f = features(code).astype(np.int32)
        del code
        at, size = chains(lens)
        valid = at >= 0
        seen = np.zeros((2, 2))
        state = np.where(valid, y[at], -1).astype(int)
        for i in range(2):
            for j in range(2):
                seen[i, j] = ((state[:, :-1] == i) & (state[:, 1:] == j)).sum()
        model.weights[BIAS % BUCKETS] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        w_m, w_v, t_m, t_v = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1), np.zeros((2, 2)), np.zeros((2, 2))
        for step in range(1, rounds + 1):  # Adam on the mean log likelihood of a toxic token
            emission = model.weights[f].sum(axis=1)[flat]
            gamma, pairs = np.empty(at.shape), np.zeros((2, 2))
            for k in range(0, len(at), BLOCK):
                s = slice(k, k + BLOCK)
                gamma[s], p = forward_backward(np.where(valid[s], emission[at[s]], 0.0), size[s], model.trans)
                pairs += p.sum(axis=0)
            token = y[at[valid]] - gamma[valid]
            by_word = np.bincount(flat[at[valid]], token, minlength=len(index))
            scale = max(1.0, y.sum())
            grad = np.bincount(f.ravel(), np.repeat(by_word, WIDTH), minlength=BUCKETS + 1) / scale - l2 * scale * 1e-3 * model.weights
            grad[BUCKETS] = 0
            for g, x, m, v in ((grad, model.weights, w_m, w_v), ((seen - pairs) / scale, model.trans, t_m, t_v)):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        marginals = model.decoded(model.weights[f].sum(axis=1)[flat], lens)
    x = summary(marginals, lens)
    weight = np.where(kind, share / max(1, kind.sum()), (1 - share) / max(1, (~kind).sum())) * len(kind)
    b = np.zeros(4)
    for _ in range(50):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (weight * p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag([0.1, 0.1, 0.1, 1e-3])
        b = b + np.linalg.solve(h, x.T @ (weight * (kind - p)) - np.array([0.1, 0.1, 0.1, 1e-3]) * b)
    return model.weights, model.trans, b


def _apart(texts: list[str]) -> list[str]:
    """One of each set of near copies: texts with the same smallest hash of three neighbouring words."""
    out: dict[int, str] = {}
    for t in texts:
        w = t.split()
        out.setdefault(min((zlib.crc32(" ".join(x).encode()) for x in zip(w, w[1:], w[2:])), default=zlib.crc32(t.encode())), t)
    return list(out.values())


def sample(rows: DataFrame, labels: DataFrame, docs_each: int) -> tuple[list[str], list[str], float]:
    """Toxic and clean training texts, and the share of toxic labels among those of ``rows``."""
    kinds = pinned(labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("of")).agg(F.max("toxic").alias("toxic")).where("toxic IS NOT NULL"), "toxic-labels")
    # only labels of the rows that may be learned from count
    kinds = pinned(rows.select("doc_id").join(checked(kinds), F.col("doc_id") == F.col("of")).select("of", "toxic").distinct(), "toxic-learned")
    n, bad = kinds.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    out = []
    for kind, most in ((1, docs_each), (0, 2 * docs_each)):
        # the ids come first: texts are fetched for the sample alone
        ids = rows.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n")).where(F.col("n") <= MAX_CHARS)
        ids = ids.join(checked(kinds.where(F.col("toxic") == kind).select("of")), F.col("doc_id") == F.col("of"))
        ids = ids.select(F.col("doc_id").alias("of"), F.xxhash64(F.lit(11), "doc_id").alias("h")).distinct().orderBy("h", "of").limit(most).select("of")
        texts = rows.join(F.broadcast(pinned(ids, "sample-ids")), F.col("doc_id") == F.col("of")).select("doc_id", "text").orderBy("doc_id", "text").limit(2 * most)
        out.append(_apart([r[1] or "" for r in texts.collect()]))
    return out[0], out[1], (bad or 0) / max(1, n)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", learn: Column | None = None, docs_each: int = DOCS_EACH, span_at: float = 0.5) -> DataFrame:
    """doc_id, tag, score, spans (offending start and end characters): one row a document.

    learn: which rows' labels may be used (default: all).  tag is a hash of the text.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (F.lit(True) if learn is None else learn).alias("learn"))
    toxic, clean, share = sample(rows.where("learn").drop("learn"), labels, docs_each)
    model = train(toxic, clean, share) if toxic and clean else None
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(*shared.value) if shared.value is not None else None
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for b in (part for whole in batches for part in pieces(whole, 2, 2 << 20)):
            texts = [t or "" for t in b.column(2).to_pylist()]
            scores, spans = np.zeros(len(texts)), [[] for _ in texts]
            if tagger is not None and texts:
                marginals, lens = tagger.marginals([t.split() for t in texts])
                scores = tagger.scores(marginals, lens)
                ends = np.cumsum(lens)
                for i in np.unique(np.searchsorted(ends, np.nonzero(marginals >= span_at)[0], side="right")):
                    spans[i] = offending(texts[i], marginals[ends[i] - lens[i] : ends[i]] >= span_at)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(scores), pa.array(spans, kind)], ["doc_id", "tag", "score", "spans"])

    out = rows.select("doc_id", F.xxhash64("text").alias("tag"), "text")
    return out.mapInArrow(run, "doc_id long, tag long, score double, spans array<struct<start:int,end:int>>")


def offending(text: str, bad: np.ndarray) -> list[dict]:
    """Character offsets of runs of toxic tokens."""
    out: list[dict] = []
    joined = False
    for m, x in zip(re.finditer(r"\S+", text), bad):
        if x and joined:
            out[-1]["end"] = m.end()
        elif x:
            out.append({"start": m.start(), "end": m.end()})
        joined = bool(x)
    return out
