"""Registered queries of the training-data operators, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import op1_quality, op2_langid, op3_toxicity, op4_jaccard, op5_lempel_ziv, op6_bpe, op7_substrings, op8_blocks, op9_snapshots, op10_raking, op11_winnowing, op12_negatives, op13_phrases
from folio.llm.common import table
from folio.plans.sqlkit import html_decode_sql, strip_tags_sql

#: Rank file of the production tokenizer.
RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, distances to the language references and the verdict."""
    return op1_quality.quality(table(spark, sf_dir, "documents"))


def op2_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text by the string-kernel classifier."""
    return op2_langid.identify(table(spark, sf_dir, "documents"))


def op3_deobfuscated_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text after noisy-channel restoration."""
    return op3_toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents, by vertical partitioning."""
    return op4_jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op5_lempel_ziv_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lempel-Ziv fingerprints of every text, its edited text and its next."""
    return op5_lempel_ziv.fingerprints(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text by the public ranks, decoded again."""
    return op6_bpe.encode(table(spark, sf_dir, "documents"), RANKS, with_ids=False)


def op7_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that repeat across documents."""
    return op7_substrings.repeats(table(spark, sf_dir, "documents"))


def op8_text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return op8_blocks.extract(table(spark, sf_dir, "pages"))


def op9_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations, rendered in parts of 64 turns."""
    return op9_snapshots.collapse_snapshots(table(spark, sf_dir, "conversations"))


def op10_raked_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fitted factor and sampled number of copies."""
    return (op10_raking.mix_documents(table(spark, sf_dir, "documents"))
            .select("doc_id", "source", "lang", *[F.col(f"mix_{c}").alias(c) for c in ("topic", "tokens", "factor", "copies")]))


def op11_winnowed_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the words and items that they share with the benchmark."""
    found = op11_winnowing.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op12_tree_bounded_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of each anchor and positive."""
    return op12_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2000 best phrases of two to five words."""
    return op13_phrases.collocations(table(spark, sf_dir, "documents"))


_OP9 = """
WITH rows_ AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
seq AS (
  SELECT conv_id, turn, role, text, max(turn) OVER (PARTITION BY conv_id) AS last_turn,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k
  FROM rows_),
whole AS (
  SELECT conv_id, count(*) AS n, list(md5(concat(turn, '|', role, '|', text)) ORDER BY k) AS h FROM seq GROUP BY conv_id),
prefix AS (
  SELECT DISTINCT list_aggregate(w.h[1:s.k], 'string_agg', ',') AS h
  FROM seq s JOIN whole w USING (conv_id)
  WHERE s.turn < s.last_turn AND s.k = (SELECT max(k) FROM seq z WHERE z.conv_id = s.conv_id AND z.turn = s.turn)),
kept AS (
  SELECT min(conv_id) AS conv_id, max(n) AS n_turns, count(*) AS n_copies
  FROM (SELECT conv_id, n, list_aggregate(h, 'string_agg', ',') AS h FROM whole) x
  WHERE h NOT IN (SELECT h FROM prefix) GROUP BY h)
SELECT conv_id, n_turns, n_copies, row_number() OVER (PARTITION BY conv_id ORDER BY block) - 1 AS part, part_turns, rendered
FROM (SELECT s.conv_id, any_value(k.n_turns) AS n_turns, any_value(k.n_copies) AS n_copies, s.turn // 64 AS block,
             count(*) AS part_turns,
             string_agg('<|im_start|>' || s.role || chr(10) || s.text || '<|im_end|>' || chr(10), '' ORDER BY s.k) AS rendered
      FROM seq s JOIN kept k USING (conv_id) GROUP BY s.conv_id, s.turn // 64) y
"""

_OP10 = r"""
WITH RECURSIVE tagged AS MATERIALIZED (
  SELECT doc_id, source, lang,
         CASE WHEN contains(text, '@') OR contains(text, 'password=') THEN 'contact'
              WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, '!! ') THEN 'shout'
              WHEN contains(lower(text), 'licen') THEN 'notice' ELSE 'prose' END AS topic,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens
  FROM documents),
cells AS MATERIALIZED (
  SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM tagged GROUP BY ALL HAVING sum(tokens) > 0),
powered AS (
  SELECT 0 AS dim, source AS value, pow(sum(tokens), 0.7) AS w FROM cells GROUP BY source
  UNION ALL SELECT 1, lang, pow(sum(tokens), 0.7) FROM cells GROUP BY lang
  UNION ALL SELECT 2, topic, pow(sum(tokens), 0.7) FROM cells GROUP BY topic),
targets AS MATERIALIZED (SELECT dim, value, w / sum(w) OVER (PARTITION BY dim) AS target FROM powered),
fit AS (
  SELECT 0 AS i, source, lang, topic, tokens, tokens AS weight FROM cells
  UNION ALL
  SELECT i + 1, source, lang, topic, f.tokens,
         weight * t.target / sum(weight) OVER (PARTITION BY CASE i % 3 WHEN 0 THEN source WHEN 1 THEN lang ELSE topic END)
  FROM fit f JOIN targets t ON t.dim = i % 3 AND t.value IS NOT DISTINCT FROM CASE i % 3 WHEN 0 THEN source WHEN 1 THEN lang ELSE topic END
  WHERE i < 120),
factors AS (
  SELECT source, lang, topic, round(weight * (SELECT sum(tokens) FROM cells) / tokens, 4) AS factor FROM fit WHERE i = 120)
SELECT doc_id, d.source, d.lang, d.topic, tokens, coalesce(factor, 0.0) AS factor,
       CAST(floor(coalesce(factor, 0)) + CASE WHEN CAST('0x' || substr(md5('mix' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0
            < coalesce(factor, 0) - floor(coalesce(factor, 0)) THEN 1 ELSE 0 END AS INT) AS copies
FROM tagged d LEFT JOIN factors f
  ON f.source IS NOT DISTINCT FROM d.source AND f.lang IS NOT DISTINCT FROM d.lang AND f.topic = d.topic
"""

_OP4 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[^\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 75 * (x.n + y.n - n_both)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) r USING (doc_id)
"""

_OP8 = f"""
WITH a AS (
  SELECT page_id, url, regexp_replace(regexp_extract(html, '(?s)<article>(.*?)(</article>|$)', 1), '</?(p|h1)>', chr(10), 'g') AS t FROM pages),
b AS (SELECT page_id, url, {html_decode_sql(strip_tags_sql("replace(t, '<br>', ' ')"))} AS t FROM a),
c AS (
  SELECT page_id, url, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))),
                                                   lambda x: x <> ''), chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM c
"""

_OP11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows_ AS (
  SELECT DISTINCT item, least(len(w), 10) AS k, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS g
  FROM b WHERE len(w) > 0),
lens AS (SELECT DISTINCT k FROM windows_),
grams AS (
  SELECT rid, k, unnest(range(1, len(w) - k + 2)) AS i, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g
  FROM d, lens WHERE len(w) >= k),
hits AS (SELECT rid, grams.k, i, item FROM grams JOIN windows_ USING (k, g)),
words_ AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + k)) AS p FROM hits) x GROUP BY rid),
items_ AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM hits) x GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words_ USING (rid) LEFT JOIN items_ USING (rid)
"""

_OP12 = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
  FROM v a, v r WHERE a.vec_id % 100 = 0 AND a.rid <> r.rid),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
"""

_OP13 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
f AS (
  SELECT lang, k, g, count(*) AS f
  FROM (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g
        FROM w, range(1, 6) r(k) WHERE len(w) >= k) x
  GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS MATERIALIZED (SELECT lang, k, g, f AS a, string_split(g, ' ') AS w FROM f WHERE k > 1 AND f >= 100),
kept AS (
  SELECT * FROM cand c
  WHERE NOT EXISTS (SELECT 1 FROM cand x WHERE x.lang = c.lang AND x.k > c.k AND 100 * x.a >= 100 * c.a AND contains(' ' || x.g || ' ', ' ' || c.g || ' '))),
cuts AS (
  SELECT c.lang, c.g, c.a, i, array_to_string(c.w[1:i], ' ') AS g1, array_to_string(c.w[i + 1:], ' ') AS g2
  FROM kept c, range(1, 5) r(i) WHERE i < c.k),
scored AS (
  SELECT c.lang, c.g AS phrase, c.a, x.f AS l, y.f AS r, n, 1000::HUGEINT * c.a * n // (x.f::HUGEINT * y.f) AS score,
         row_number() OVER (PARTITION BY c.lang, c.g ORDER BY 1000::HUGEINT * c.a * n // (x.f::HUGEINT * y.f), i) AS worst
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.g = c.g1 JOIN f y ON y.lang = c.lang AND y.g = c.g2 JOIN totals t ON t.lang = c.lang),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM scored WHERE worst = 1)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""

QUERIES = {
    "op1_divergence_rules": op1_divergence_rules,
    "op2_string_kernel": op2_string_kernel,
    "op3_deobfuscated_toxicity": op3_deobfuscated_toxicity,
    "op4_jaccard_components": op4_jaccard_components,
    "op5_lempel_ziv_prints": op5_lempel_ziv_prints,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_compact_windows": op7_compact_windows,
    "op8_text_blocks": op8_text_blocks,
    "op9_snapshot_collapse": op9_snapshot_collapse,
    "op10_raked_mix": op10_raked_mix,
    "op11_winnowed_leaks": op11_winnowed_leaks,
    "op12_tree_bounded_negatives": op12_tree_bounded_negatives,
    "op13_phrase_collocations": op13_phrase_collocations,
}
ORACLES = {
    "op4_jaccard_components": _OP4,
    "op8_text_blocks": _OP8,
    "op9_snapshot_collapse": _OP9,
    "op10_raked_mix": _OP10,
    "op11_winnowed_leaks": _OP11,
    "op12_tree_bounded_negatives": _OP12,
    "op13_phrase_collocations": _OP13,
}
