"""The queries of this package: one ``opN_<name>`` an operator, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knowtrace.llm import bpe, exact_dedup, lm_score, merkle, minhash, mixing, phrases, pii, quality, simhash, substring_dedup, toxicity, warc
from knowtrace.session import work_path

RANKS = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents by source weights; null texts have size 0, a null source comes last, repeated rows are documents of their own."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 4-word shingles and their components at 4 bits; null and blank texts have fingerprint zero, a null id names no component."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), width=4, distance=4)
    return found.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


def op3_ngram_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counted rules and the verdict on every document; null texts have no words and fail, rows that repeat id and text are judged alike."""
    return quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from three of four labelled ids; null and empty texts are scored too, a null id is not held out."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    scored = toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), learn=~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))


def op5_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities of every text; a null text is empty (its end alone is scored), a null id is learned from."""
    return lm_score.score(_table(spark, sf_dir, "documents"))


def op6_salted_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts (null is empty); a null id wins only where all are null, of rows that repeat the winner one is kept."""
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op7_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and added spans of every text; a null text has none, ties between overlapping additions go to the longest, then the first."""
    found = pii.find(_table(spark, sf_dir, "documents"))
    counts = [pii.count(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS]
    everything = pii.joined(F.sort_array(F.concat("base", "added")))
    return found.select("doc_id", *counts, F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), everything.alias("spans"), F.size("added").cast("long").alias("n_added"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every text as digests; a null text is empty and has no ids."""
    return bpe_digests(bpe.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, decoded=True))


def bpe_digests(decoded: DataFrame) -> DataFrame:
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op9_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words kept and removed of every text; a null text has none, a null id sorts last, rows that repeat id and text share their verdict."""
    found = substring_dedup.drop_repeats(_table(spark, sf_dir, "documents"), width=20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all pages read back from the archives; a null html is empty, payloads under 100 bytes are never revisits."""
    path = work_path(spark, "archives")
    warc.write_arc(_table(spark, sf_dir, "pages"), f"{path}/arc")
    warc.convert(spark, f"{path}/arc", f"{path}/warc")
    return warc.read_warc(spark, f"{path}/warc").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_merkle_butterfly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and digest of the proof of every document; texts of ids with an even crc32 lose their line ends and are folded again."""
    forge = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    leaves = merkle.document_leaves(_table(spark, sf_dir, "documents"), forge)
    return merkle.verify(merkle.manifest(leaves, carry=["forged"]))


def op12_fast_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of 5-word shingles linked from a similarity of 0.85 on: set size, component and whether the document stays."""
    found = minhash.near_duplicates(_table(spark, sf_dir, "documents"), width=5, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op13_debruijn_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of 2 to 4 words of each lang that occur 30 times or more."""
    return phrases.collocations(_table(spark, sf_dir, "documents"), longest=4, min_count=30, hundredths=80, top=2000)


QUERIES = {
    f.__name__: f
    for f in (
        op1_pareto_mix, op2_simhash_pivots, op3_ngram_llr, op4_crf_toxicity, op5_bloom_lm, op6_salted_dedup, op7_boosted_pii, op8_byte_bpe,
        op9_window_dedup, op10_arc_to_warc, op11_merkle_butterfly, op12_fast_minhash, op13_debruijn_phrases,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op6_salted_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
        g AS (SELECT doc_id, body, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size FROM t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM g""",
    # runs of 2, 4, 8, 16 and 20 words, each from two shorter ones; null where the text ends first
    "op9_window_dedup": r"""
        WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
        r1 AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM t),
        r2 AS (SELECT doc_id, word, place, word || ' ' || lead(word, 1) OVER d AS a FROM r1 WINDOW d AS (PARTITION BY doc_id ORDER BY place)),
        r4 AS (SELECT doc_id, word, place, a || ' ' || lead(a, 2) OVER d AS b FROM r2 WINDOW d AS (PARTITION BY doc_id ORDER BY place)),
        r8 AS (SELECT doc_id, word, place, b, b || ' ' || lead(b, 4) OVER d AS c FROM r4 WINDOW d AS (PARTITION BY doc_id ORDER BY place)),
        r16 AS (SELECT doc_id, word, place, b, c || ' ' || lead(c, 8) OVER d AS e FROM r8 WINDOW d AS (PARTITION BY doc_id ORDER BY place)),
        r20 AS (SELECT doc_id, word, place, e || ' ' || lead(b, 16) OVER d AS run FROM r16 WINDOW d AS (PARTITION BY doc_id ORDER BY place)),
        starts AS (SELECT doc_id, word, place, run IS NOT NULL AND row_number() OVER (PARTITION BY run ORDER BY doc_id, place) > 1 AS late FROM r20),
        marked AS (SELECT doc_id, word, place, bool_or(late) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM starts),
        cut AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY place) FILTER (NOT gone) AS kept FROM marked GROUP BY doc_id)
        SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM t LEFT JOIN cut USING (doc_id)""",
    "op10_arc_to_warc": r"""
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first_id FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM f""",
    # the tree level by level; 2 ** 32 polynomial bits by bytes for the crc
    "op11_merkle_butterfly": r"""
        WITH RECURSIVE framed AS (
            SELECT doc_id, source, text,
                   CASE WHEN doc_id IS NULL THEN '-' ELSE octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id END
                   || CASE WHEN source IS NULL THEN '-' ELSE octet_length(encode(source)) || ':' || source END
                   || CASE WHEN lang IS NULL THEN '-' ELSE octet_length(encode(lang)) || ':' || lang END
                   || CASE WHEN n_chars IS NULL THEN '-' ELSE octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars END AS head,
                   list_reduce(list_prepend(4294967295::UBIGINT, list_transform(split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
                       lambda crc, byte: list_reduce([xor(crc, byte), 1::UBIGINT, 1::UBIGINT, 1::UBIGINT, 1::UBIGINT, 1::UBIGINT, 1::UBIGINT, 1::UBIGINT, 1::UBIGINT],
                           lambda x, one: CASE WHEN x & one = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)) AS crc
            FROM documents),
        hashed AS (
            SELECT doc_id, source, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE octet_length(encode(text)) || ':' || text END) AS leaf,
                   CASE WHEN xor(crc, 4294967295::UBIGINT) % 2 = 0 AND text IS NOT NULL
                        THEN sha256(head || octet_length(encode(replace(text, chr(10), ''))) || ':' || replace(text, chr(10), '')) END AS forged
            FROM framed),
        leaves AS (
            SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM hashed),
        tree AS (
            SELECT source, 0 AS level, place, leaf AS node, count(*) OVER (PARTITION BY source) AS width FROM leaves
            UNION ALL
            SELECT source, level + 1, place // 3, sha256(string_agg(node, '' ORDER BY place)), any_value((width + 2) // 3) FROM tree WHERE width > 1 GROUP BY source, level, place // 3),
        subroots AS (
            SELECT source, node AS subroot, level AS height, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS place, count(*) OVER () AS width FROM tree WHERE width = 1),
        crown AS (
            SELECT 0 AS level, place, subroot AS node, width FROM subroots
            UNION ALL
            SELECT level + 1, place // 3, sha256(string_agg(node, '' ORDER BY place)), any_value((width + 2) // 3) FROM crown WHERE width > 1 GROUP BY level, place // 3),
        steps AS (
            SELECT l.source, l.doc_id, l.leaf, l.place, t.level, coalesce(string_agg(t.node, '' ORDER BY t.place) FILTER (t.place < p.at), '') AS before,
                   coalesce(string_agg(t.node, '' ORDER BY t.place) FILTER (t.place > p.at), '') AS after
            FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source, generate_series(0, s.height - 1) g(level), LATERAL (SELECT l.place // (3 ** g.level)::BIGINT AS at) p,
                 tree t WHERE t.source IS NOT DISTINCT FROM l.source AND t.level = g.level AND t.place // 3 = p.at // 3
            GROUP BY ALL),
        top_steps AS (
            SELECT s.source, s.height + t.level AS level, coalesce(string_agg(t.node, '' ORDER BY t.place) FILTER (t.place < p.at), '') AS before,
                   coalesce(string_agg(t.node, '' ORDER BY t.place) FILTER (t.place > p.at), '') AS after
            FROM subroots s, generate_series(0, (SELECT max(level) FROM crown) - 1) g(level), LATERAL (SELECT s.place // (3 ** g.level)::BIGINT AS at) p,
                 crown t WHERE t.level = g.level AND t.place // 3 = p.at // 3
            GROUP BY s.source, s.height, t.level, p.at),
        proofs AS (
            SELECT source, place, level, before, after FROM steps
            UNION ALL
            SELECT l.source, l.place, t.level, t.before, t.after FROM leaves l JOIN top_steps t ON l.source IS NOT DISTINCT FROM t.source),
        proof AS (
            SELECT source, place, list({'before': before, 'after': after} ORDER BY level) AS steps FROM proofs GROUP BY source, place),
        folded AS (
            SELECT l.doc_id, l.source, l.leaf, coalesce(p.steps, []) AS steps,
                   list_reduce(list_prepend({'before': coalesce(l.forged, l.leaf), 'after': ''}, coalesce(p.steps, [])),
                       lambda h, s: {'before': sha256(s.before || h.before || s.after), 'after': ''}).before AS folded_root
            FROM leaves l LEFT JOIN proof p ON l.source IS NOT DISTINCT FROM p.source AND l.place = p.place)
        SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda s: s.before || s.after), '')) AS proof_sha256, folded_root, folded_root = root AS verified
        FROM folded f JOIN subroots s ON f.source IS NOT DISTINCT FROM s.source, (SELECT node AS root FROM crown WHERE width = 1)""",
    "op12_fast_minhash": r"""
        WITH RECURSIVE t AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
        sets AS (
            SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                   ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS s FROM t),
        classes AS (SELECT list_sort(s) AS s, min(doc_id) AS first, len(any_value(s)) AS n FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)),
        held AS (SELECT first, n, unnest(s) AS shingle FROM classes),
        links AS (
            SELECT a.first AS a, b.first AS b FROM held a JOIN held b ON a.shingle = b.shingle AND a.first <> b.first AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
            GROUP BY a.first, b.first, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        reached AS (SELECT first AS node, first AS root FROM classes UNION SELECT b AS node, r.root FROM reached r JOIN links l ON r.node = l.a AND r.root < l.b),
        roots AS (SELECT node, min(root) AS root FROM reached GROUP BY node)
        SELECT doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(root, doc_id) AS component_id, doc_id IS NOT DISTINCT FROM coalesce(root, doc_id) AS kept
        FROM sets LEFT JOIN classes ON list_sort(sets.s) = classes.s LEFT JOIN roots ON roots.node = classes.first""",
    "op13_debruijn_phrases": r"""
        WITH split AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        numbered AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS words, row_number() OVER () AS piece FROM split),
        placed AS (SELECT lang, piece, unnest(words) AS w1, generate_subscripts(words, 1) AS place FROM numbered),
        runs AS (
            SELECT lang, w1, w1 || ' ' || lead(w1, 1) OVER p AS w2, w1 || ' ' || lead(w1, 1) OVER p || ' ' || lead(w1, 2) OVER p AS w3,
                   w1 || ' ' || lead(w1, 1) OVER p || ' ' || lead(w1, 2) OVER p || ' ' || lead(w1, 3) OVER p AS w4
            FROM placed WINDOW p AS (PARTITION BY piece ORDER BY place)),
        f AS (SELECT lang, m, phrase, count(*)::HUGEINT AS f FROM (UNPIVOT runs ON w1, w2, w3, w4 INTO NAME name VALUE phrase) CROSS JOIN LATERAL (SELECT substr(name, 2)::INT AS m) GROUP BY lang, m, phrase),
        total AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang),
        candidates AS (SELECT lang, m, phrase, split(phrase, ' ') AS w, f AS a FROM f WHERE m > 1 AND f >= 30),
        cuts AS (SELECT *, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates)),
        scored AS (
            SELECT c.*, l.f AS l, r.f AS r, (2000000 * c.a) // (l.f + r.f) AS score
            FROM cuts c JOIN f l ON l.lang = c.lang AND l.m = c.k AND l.phrase = c.first JOIN f r ON r.lang = c.lang AND r.m = c.m - c.k AND r.phrase = c.rest),
        best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        spans AS (SELECT lang, m, a, array_to_string(w[s:s + k - 1], ' ') AS phrase FROM candidates c, range(1, 4) x(s), range(2, 4) y(k) WHERE k < m AND s + k - 1 <= m),
        most AS (SELECT lang, phrase, max(a) AS most FROM spans GROUP BY lang, phrase),
        kept AS (SELECT b.* FROM best b LEFT JOIN most USING (lang, phrase) WHERE most IS NULL OR 100 * most < 80 * a)
        SELECT lang, row_number() OVER o AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
        FROM kept JOIN total USING (lang) WINDOW o AS (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) QUALIFY rank <= 2000""",
}
