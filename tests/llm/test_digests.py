"""Operators with exact results against brute force: dedup, SimHash, BPE, windows, language model, mixing."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
import rows
import xxhash

from knowtrace.llm import bpe, queries, simhash

GAP, WORD = re.compile(r"[\x20\x09-\x0D]+"), re.compile(r"[^\x20\x09-\x0D]+")


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def ascii_lower(t: str) -> str:
    return re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), t)


def run(name, spark, sf_dir, *columns) -> list[tuple]:
    return sorted((tuple(r) for r in queries.QUERIES[name](spark, sf_dir).select(*columns).collect()), key=rows.key)


@pytest.fixture(params=["odd", "given"])
def sf(request, odd):
    return odd if request.param == "odd" else rows.SF


def test_exact(spark, sf):
    docs = [(i, GAP.sub(" ", t or "")) for i, t, _ in rows.documents(spark, sf)]
    groups = defaultdict(list)
    for i, t in docs:
        groups[t].append(i)
    expected, won = [], set()
    for i, t in docs:
        keep = min((x for x in groups[t] if x is not None), default=None)
        kept = i == keep and (t, i) not in won
        if kept:
            won.add((t, i))
        expected.append((i, keep, len(groups[t]), kept, sha(t)))
    assert run("op6_salted_dedup", spark, sf, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(expected, key=rows.key)


def brute_fingerprint(t) -> int:
    w = WORD.findall(ascii_lower(t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def test_simhash(spark, sf):
    docs = [(i, brute_fingerprint(t)) for i, t, _ in rows.documents(spark, sf)]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if (docs[a][1] ^ docs[b][1]).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for x, (i, _) in enumerate(docs):
        if i is not None:
            least[find(x)] = min(i, least.get(find(x), i))
    expected = sorted(((i, f"{fp:016x}", least.get(find(x))) for x, (i, fp) in enumerate(docs)), key=rows.key)
    assert run("op2_simhash_pivots", spark, sf, "doc_id", "fingerprint", "component_id") == expected


@pytest.mark.parametrize("cell_rows", [8, 4096])
def test_simhash_links_in_small_cells(spark, cell_rows):
    """A dense ball of fingerprints, many cells: the components are those of all pairs."""
    import random

    rng = random.Random(3)
    centre = rng.getrandbits(64)
    fps = {0}
    for _ in range(150):
        x = centre
        for b in rng.sample(range(64), rng.randrange(0, 7)):
            x ^= 1 << b
        fps |= {x, rng.getrandbits(64)}
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    from knowtrace.llm.components import components

    found = {r.node: r.root for r in components(simhash.near_links(df, 4, cell_rows)).collect()}
    seen, label = {}, {}
    for x in fps:
        label[x] = x
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= 4 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    groups = defaultdict(set)
    for x in fps:
        groups[label[x]].add(x)
        seen.setdefault(found.get(simhash._signed(x), simhash._signed(x)), set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, seen.values()))


def test_bpe(spark, sf):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path(queries.RANKS)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    expected = []
    for i, t, _ in rows.documents(spark, sf):
        ids = enc.encode_ordinary(t or "")
        expected.append((i, len(ids), sha(",".join(map(str, ids))), sha(t or "")))
    assert run("op8_byte_bpe", spark, sf, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(expected, key=rows.key)


def test_bpe_decodes_a_table_of_ids(spark, odd):
    import public_tokenizers

    path = public_tokenizers.path(queries.RANKS)
    docs = spark.read.parquet(f"{odd}/documents.parquet").where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    ids = bpe.encode(docs, path, public_tokenizers.PATTERN)
    got = {r.doc_id: bytes(r.bytes) for r in bpe.decode(ids, path).collect()}
    assert got == {r.doc_id: (r.text or "").encode() for r in docs.collect()}


@pytest.mark.parametrize("long_", [4, 1024])
def test_bpe_pieces(long_, monkeypatch):
    """Matrix rounds and the heap agree with the library on awkward pieces."""
    import random

    import public_tokenizers
    import tiktoken

    monkeypatch.setattr(bpe, "LONG", long_)
    ranks = bpe.load_ranks(public_tokenizers.path(queries.RANKS))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    texts = ["", "a", " ", "aaaaaaaaaaaaaaaaa", "ab" * 300, "=" * 999, " " * 77, "é" * 50, "日" * 33, "\n\n\n \n", "the cat", "\x1c\x85\xa0 \x1f"]
    texts += ["".join(rng.choice("abcdeßé日 '\n.12") for _ in range(rng.randrange(200))) for _ in range(200)]
    e = bpe.Encoder(ranks, bpe.PairTable.of(ranks), public_tokenizers.PATTERN)
    for part in (texts[:50], texts[50:]):
        offsets, ids = e.encode(part)
        for t, a, b in zip(part, offsets, offsets[1:]):
            assert ids[a:b].tolist() == enc.encode_ordinary(t), t


def test_windows(spark, sf):
    docs = [(2**63 - 1 if i is None else i, i, t or "") for i, t, _ in rows.documents(spark, sf)]
    signed = lambda x: x - 2**64 if x >> 63 else x
    first = {}
    for i, _, t in docs:
        w, tag = WORD.findall(t), signed(xxhash.xxh64_intdigest(t.encode(), 42))
        for p in range(len(w) - 19):
            k = tuple(w[p : p + 20])
            first[k] = min(first.get(k, (i, tag, p)), (i, tag, p))
    expected = []
    for i, own, t in docs:
        w, tag = WORD.findall(t), signed(xxhash.xxh64_intdigest(t.encode(), 42))
        gone = set()
        for p in range(len(w) - 19):
            if first[tuple(w[p : p + 20])] != (i, tag, p):
                gone.update(range(p, p + 20))
        expected.append((own, len(w), len(gone), sha(" ".join(x for n, x in enumerate(w) if n not in gone))))
    assert run("op9_window_dedup", spark, sf, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(expected, key=rows.key)


@pytest.mark.parametrize("frequent", [0, 40, 1_000_000])
def test_language_model(spark, sf, frequent, monkeypatch):
    """Counts are exact whether a word is in the broadcast table or joined."""
    from knowtrace.llm import lm_score

    table = lm_score.frequent_words
    monkeypatch.setattr(lm_score, "frequent_words", lambda words: table(words, frequent))
    docs = [(i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, [*WORD.findall(ascii_lower(t or "")), None]) for i, t, _ in rows.documents(spark, sf)]
    c = Counter(w for _, out, ws in docs if not out for w in ws)
    n, v = sum(c.values()), len(c)
    got = run("op5_bloom_lm", spark, sf, "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    base = sorted(((i, out, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, out, ws in docs), key=rows.key)
    assert sorted(((*r[:5], round(r[5], 6)) for r in got), key=rows.key) == base
    assert all(r[6] <= 0 for r in got)
    # pairs tell more than words alone, on rows that were learned from
    assert sum(r[6] for r in got if not r[1]) > sum(r[5] for r in got if not r[1])


def test_windows_meet_by_a_second_hash(spark, monkeypatch):
    """With one hash the same for every window, those of different documents still do not meet."""
    import numpy as np

    from knowtrace.llm import substring_dedup as sd

    real = sd.word_hashes
    monkeypatch.setattr(sd, "word_hashes", lambda words, seed=42: np.zeros(len(words), dtype=np.uint64) if seed == 42 else real(words, seed))
    monkeypatch.setattr(sd, "PIECE", 1)  # a document a piece
    docs = [(i, " ".join(f"d{i}w{k}" for k in range(20)), "a") for i in range(6)]
    found = sd.drop_repeats(rows.table(spark, [*docs, (9, docs[3][1], "a")]), bucket_bytes=8).collect()
    assert {r.doc_id: r.n_removed for r in found} == {**{i: 0 for i in range(6)}, 9: 20}


@pytest.mark.parametrize("tune_docs", [0, None])
@pytest.mark.parametrize("frequent", [5, 1_000_000])
def test_language_model_with_a_shuffled_filter(spark, odd, monkeypatch, tune_docs, frequent):
    """Every column is the same whether the filter is broadcast or its segments are asked; weights and rare words too."""
    from knowtrace.llm import lm_score

    table = lm_score.frequent_words
    monkeypatch.setattr(lm_score, "frequent_words", lambda words: table(words, frequent))
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    one, two = (sorted(((*r[:5], round(r[5], 8), round(r[6], 8)) for r in lm_score.score(docs, max_filter_bytes=n, tune_docs=tune_docs).collect()), key=rows.key) for n in (128 << 20, 0))
    assert one == two and len(one) == docs.count()


def test_language_model_with_a_shuffled_filter_by_piece(spark, odd, monkeypatch):
    """Many pieces and segments, an empty table, a table without training rows."""
    from knowtrace.llm import lm_score

    def run(docs, limit):
        return sorted(((*r[:5], round(r[5], 8), round(r[6], 8)) for r in lm_score.score(docs, max_filter_bytes=limit).collect()), key=rows.key)

    docs = spark.read.parquet(f"{odd}/documents.parquet")
    want = run(docs, 128 << 20)
    monkeypatch.setattr(lm_score, "PIECE", 3000)
    buckets = lm_score.blob_buckets
    monkeypatch.setattr(lm_score, "blob_buckets", lambda df, text, size: max(30, buckets(df, text, size)))
    assert [r[:6] for r in run(docs, 0)] == [r[:6] for r in want]
    assert run(docs, 0) == run(docs, 128 << 20)
    assert run(docs.limit(0), 0) == []
    out = docs.where("crc32(CAST(doc_id AS STRING)) % 7 = 2")
    assert run(out, 0) == run(out, 128 << 20) != []


def test_language_model_weights_see_every_training_token(spark, odd, monkeypatch):
    """Texts beyond 20,000 characters and beyond the first 400 count too."""
    from knowtrace.llm import lm_score

    docs = [(i, f"long{i} " * 3000 if i % 100 == 0 else f"short w{i}", "a") for i in range(600)]
    seen, fit = [], lm_score.Model.fit
    monkeypatch.setattr(lm_score.Model, "fit", lambda self, code, n: seen.append(int(n.sum())) or fit(self, code, n))
    total = {r.train_tokens for r in lm_score.score(rows.table(spark, docs)).select("train_tokens").collect()}
    assert {*seen} == total == {sum(len(t.split()) + 1 for i, t, _ in docs if zlib.crc32(str(i).encode()) % 7 != 2)}


def test_language_model_scores_by_hand(spark, odd, monkeypatch):
    """score from plain counts, and the shares of what may follow each context."""
    import numpy as np

    from knowtrace.llm import lm_score as lm

    monkeypatch.setattr(lm, "BITS_EACH", 60)  # next to no false positives
    docs = [(i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, [*WORD.findall(ascii_lower(t or "")), None]) for i, t, _ in rows.documents(spark, odd)]
    words = Counter(w for _, out, ws in docs if not out for w in ws)
    pairs = Counter(p for _, out, ws in docs if not out for p in zip([None, *ws], ws))
    n, v = sum(words.values()), len(words)
    low, high = lm.level_bounds()
    least, greatest = (lambda c, b=b: b[lm.levels(np.array([c]))[0]] for b in (low, high))

    def p(before, word):
        share = least(pairs[(before, word)]) / greatest(words[before]) if words[before] else 0.0
        return 0.3 * min(share, 1.0) + 0.7 * (least(words[word]) + 1) / (n + v + 1)

    want = sorted((repr(i), round(sum(math.log10(p(a, b)) for a, b in zip([None, *ws], ws)), 5)) for i, _, ws in docs)
    found = lm.score(spark.read.parquet(f"{odd}/documents.parquet"), tune_docs=0).select("doc_id", "score").collect()
    got = sorted((repr(r.doc_id), round(r.score, 5)) for r in found)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert sum(abs(a - b) < 1e-3 for (_, a), (_, b) in zip(got, want)) >= len(want) - 2
    for before in list(words)[:200]:
        assert sum(p(before, w) for w in words) <= 1 + 1e-9


def test_filter_levels():
    import numpy as np

    from knowtrace.llm import lm_score as lm

    keys = np.arange(1, 5001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    counts = np.arange(1, 5001) % 300 + 1
    f = lm.Filter(*lm.Filter.arrays(1, {0: len(bits := lm.fill(keys, counts.astype(float)))}, [(0, bits.tobytes())]))
    exact = lm.levels(counts)
    read = f.level(keys)
    assert (read >= exact).all() and (read == exact).mean() > 0.97
    assert (f.level(keys + np.uint64(1)) == 0).mean() > 0.97
    assert lm.level_counts()[lm.levels(np.array([0, 1, 2, 3, 4, 5]))].tolist()[:4] == [0, 1, 2, 3]


def test_mixing(spark, sf):
    docs = [(i, s, len(WORD.findall(t or ""))) for i, t, s in rows.documents(spark, sf)]
    sizes = defaultdict(int)
    for _, s, n in docs:
        sizes[s] += n
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, capped, target = 1.5 * sum(sizes.values()), set(), {}
    while True:
        left = total - sum(2 * sizes[s] for s in capped)
        w = sum(weight[s] for s in order if s not in capped)
        target = {s: 2 * sizes[s] if s in capped else left * weight[s] / w for s in order}
        above = {s for s in order if target[s] > 2 * sizes[s]} - capped
        if not above:
            break
        capped |= above
    got = run("op1_pareto_mix", spark, sf, "doc_id", "size", "source_size", "target", "taken")
    again = run("op1_pareto_mix", spark, sf, "doc_id", "size", "source_size", "target", "taken")
    assert got == again and len(got) == len(docs)
    assert sorted((r[0], r[1], r[2], round(r[3], 6)) for r in got if r[0] is not None) == sorted((i, n, sizes[s], round(target[s], 6)) for i, s, n in docs if i is not None)
    assert all(0 <= r[4] <= 2 * r[1] for r in got)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        taken[r[2]] += r[4]
        largest[r[2]] = max(largest[r[2]], r[1])
    wanted = defaultdict(float)
    for s in order:
        wanted[sizes[s]] += target[s]
    for n in taken:
        assert abs(taken[n] - wanted[n]) <= largest[n] / 2 + 1, n


def test_mixing_is_unequal_between_documents(spark):
    """Odds factors tilt the sample; its size stays."""
    from knowtrace.llm import mixing

    df = spark.range(4000).selectExpr("id AS doc_id", "'w w w w' AS text", "'s' AS source", "IF(id < 2000, 4.0, 1.0) AS f")
    got = {r[0]: r[1] for r in mixing.mix(df, share=0.5, cap=1.0, odds_col="f").selectExpr("doc_id < 2000 AS liked", "taken").groupBy("liked").sum("taken").collect()}
    assert abs(got[True] + got[False] - 8000) <= 4 and got[True] > 1.5 * got[False]


@pytest.mark.parametrize("name", ["op1_pareto_mix", "op2_simhash_pivots", "op5_bloom_lm", "op6_salted_dedup", "op8_byte_bpe", "op9_window_dedup"])
def test_empty_table(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0
