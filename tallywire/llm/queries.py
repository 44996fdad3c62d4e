"""The registered queries of this subpackage and the SQL they are compared to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywire.llm import decontaminate, line_dedup, merkle, ngram_join, prefix_trie, quality_gam, quality_rules, sentence_pieces, sharding, simhash, suffix_repeats, token_counts, warc
from tallywire.llm.common import shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = sentence_pieces.read_pieces(sentence_pieces.model_path(spark))
    encoded = sentence_pieces.encode(_table(spark, sf_dir, "documents"), pieces, keep=["doc_id"], decoded=True)
    same = F.col("decoded") == F.coalesce("body", F.lit(""))
    return encoded.select("doc.doc_id", F.size("ids").alias("n_pieces"), "ids", same.alias("round_trip"))


def op2_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_counts.spark_default_path(spark)
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), path)


def op3_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS s FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.s = b.s AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT g.doc_id, CAST(len(g.g) AS BIGINT) AS n_shingles, c.component_id
FROM g JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = g.doc_id
"""


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive(_table(spark, sf_dir, "pages"), shared_folder(spark, "warc"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS s FROM p),
o AS (SELECT *, max(page_id) OVER (PARTITION BY s) AS original FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(
    ((CAST('0x' || substr(s, CAST(5 * (i // 4) + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1 AS INT), 1)), 'string_agg', '')
    AS payload_digest,
  CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> original THEN original END AS refers_to
FROM o
"""


def op5_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.deal(_table(spark, sf_dir, "documents"), 8)


def op6_site_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.remove_boilerplate(_table(spark, sf_dir, "documents"), min_sites=10)
    kept = F.md5(F.coalesce("kept_text", F.lit("")))
    return rows.select("doc.doc_id", "n_lines", "n_removed", kept.alias("kept_md5"))


OP6_SQL = """
WITH l AS (
  SELECT doc_id, source, pos, line, length(translate(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) > 0 AS word
  FROM (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
bad AS (SELECT line FROM l WHERE word GROUP BY line HAVING count(DISTINCT source) >= 10),
m AS (SELECT *, word AND line IN (SELECT line FROM bad) AS gone FROM l)
SELECT doc_id, CAST(count(*) FILTER (word) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed,
  md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_md5
FROM m GROUP BY doc_id
"""


def op7_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.with_leaks(docs, _table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    leaks = found.select("doc.doc_id", F.explode("leaks").alias("leak"))
    return leaks.select("doc_id", F.col("leak.item").alias("item_id"), "leak.score", "leak.doc_from", "leak.doc_to")


def op8_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_gam.fit(docs, _table(spark, sf_dir, "labels"))
    scored = quality_gam.score(docs, model)
    return scored.select("doc_id", quality_gam.held_out().alias("held_out"), "score", "predicted")


def op9_weak_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"), keep=["doc_id"]).select(
        "doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op10_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_repeats.repeats(_table(spark, sf_dir, "documents"))


OP10_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
e AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM w WHERE len(w) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i+49], ' ')) AS h FROM e),
bad AS (SELECT h FROM h GROUP BY h HAVING min(doc_id) < max(doc_id)),
f AS (SELECT DISTINCT doc_id, i FROM h WHERE h IN (SELECT h FROM bad)),
g AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM f)
SELECT doc_id, CAST(min(i) - 1 AS BIGINT) AS word_from, CAST(max(i) + 49 AS BIGINT) AS word_to,
  CAST(max(i) - min(i) + 50 AS BIGINT) AS n_words
FROM g GROUP BY doc_id, island
"""


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proofs(merkle.build(merkle.document_leaves(_table(spark, sf_dir, "documents"))))


def _crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of an ASCII string in SQL, bit by bit."""
    step = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    byte = f"list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: {step})"
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: CAST(ascii(substr({text}, CAST(i AS INT), 1)) AS BIGINT))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda c, b: {byte}), 4294967295::BIGINT)"


OP11_SQL = f"""
WITH RECURSIVE f AS (
  SELECT doc_id, source, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head, text,
    CAST(doc_id AS VARCHAR) AS d FROM documents),
g AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN {_crc32_sql('d')} % 5 = 0 THEN sha256(head || coalesce(strlen(text) || ':'
      || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS changed FROM f),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM g),
t AS (
  SELECT source, 0 AS level, list(leaf ORDER BY i) AS nodes FROM l GROUP BY source
  UNION ALL SELECT source, level + 1, list_transform(range(0, (len(nodes) + 15) // 16), lambda k: sha256(array_to_string(nodes[16*k+1:16*k+16], '')))
  FROM t WHERE len(nodes) > 1),
s AS (SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i FROM t WHERE len(nodes) = 1),
u AS (
  SELECT 0 AS level, list(subroot ORDER BY i) AS nodes FROM s
  UNION ALL SELECT level + 1, list_transform(range(0, (len(nodes) + 15) // 16), lambda k: sha256(array_to_string(nodes[16*k+1:16*k+16], '')))
  FROM u WHERE len(nodes) > 1),
a AS (
  SELECT l.doc_id, l.source, l.i, t.level, t.nodes, l.i // CAST(pow(16, t.level) AS BIGINT) AS k FROM l JOIN t ON t.source IS NOT DISTINCT FROM l.source AND len(t.nodes) > 1),
b AS (SELECT s.source, u.level, u.nodes, s.i // CAST(pow(16, u.level) AS BIGINT) AS k FROM s JOIN u ON len(u.nodes) > 1),
ap AS (SELECT doc_id, source, i, list({{'l': array_to_string(nodes[k//16*16+1:k], ''), 'r': array_to_string(nodes[k+2:k//16*16+16], '')}} ORDER BY level) AS p
  FROM a GROUP BY doc_id, source, i),
bp AS (SELECT source, list({{'l': array_to_string(nodes[k//16*16+1:k], ''), 'r': array_to_string(nodes[k+2:k//16*16+16], '')}} ORDER BY level) AS p
  FROM b GROUP BY source),
z AS (
  SELECT l.doc_id, l.leaf, s.subroot, (SELECT nodes[1] FROM u WHERE len(nodes) = 1) AS root, coalesce(l.changed, l.leaf) AS now,
    list_concat(coalesce(ap.p, []), coalesce(bp.p, [])) AS p
  FROM l JOIN s ON s.source IS NOT DISTINCT FROM l.source LEFT JOIN ap ON ap.source IS NOT DISTINCT FROM l.source AND ap.i = l.i
  LEFT JOIN bp ON bp.source IS NOT DISTINCT FROM l.source),
y AS (SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(p, lambda x: x.l || x.r), '')) AS proof_sha256,
  list_reduce(list_concat([{{'l': now, 'r': ''}}], p), lambda c, x: {{'l': sha256(x.l || c.l || x.r), 'r': ''}}).l AS folded_root FROM z)
SELECT *, folded_root = root AS verified FROM y
"""


def op12_simhash_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations")).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )


OP13_SQL = f"""
WITH q AS (
  SELECT conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))[1:32] AS id, strlen(coalesce(text, '')) AS b
  FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) - 1 AS p FROM q),
k AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM t),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_crc32_sql('s')} % 9 AS h FROM k),
r AS (
  SELECT c.conv_id, 0 AS part, t.p, t.id, t.b FROM c JOIN t ON t.conv_id = c.base AND t.p < c.h
  UNION ALL SELECT c.conv_id, 1, t.p, t.id, t.b FROM c JOIN t ON t.conv_id = c.conv_id AND t.p >= c.h),
l AS (
  SELECT c.conv_id, count(r.id) AS n, coalesce(string_agg(r.id, '' ORDER BY part, p), '') AS ids, list(r.b ORDER BY part, p) AS bs
  FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id),
x AS (SELECT conv_id, n, ids, bs, unnest(range(0, n + 1)) AS depth FROM l),
v AS (
  SELECT depth, ids[1:CAST(32 * depth AS INT)] AS key, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN depth > 0 THEN bs[depth] ELSE 0 END) AS b,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM x GROUP BY 1, 2),
ch AS (SELECT key[1:CAST(32 * (depth - 1) AS INT)] AS key, depth - 1 AS depth, count(*) AS n_children FROM v WHERE depth > 0 GROUP BY 1, 2),
w AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN ch USING (key, depth)),
a AS (SELECT depth AS of, key, n_children, (n_convs - 1) * b AS saved, unnest(range(0, depth + 1)) AS depth FROM w),
s AS (
  SELECT depth, key[1:CAST(32 * depth AS INT)] AS key, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved FROM a GROUP BY 1, 2)
SELECT w.conv_id, CAST(w.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, CAST(w.n_convs AS BIGINT) AS n_convs, CAST(w.n_children AS BIGINT) AS n_children,
  CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, w.ends_sha256
FROM w JOIN s USING (key, depth) LEFT JOIN v u ON u.depth = w.depth - 1 AND u.key = w.key[1:CAST(32 * (w.depth - 1) AS INT)]
"""


QUERIES = {f.__name__: f for f in (op1_piece_lattice, op2_prefix_counts, op3_shingle_join, op4_warc_revisits, op5_hash_tree, op6_site_spread, op7_benchmark_leaks, op8_additive_quality, op9_weak_rules, op10_suffix_repeats, op11_merkle_manifest, op12_simhash_blocks, op13_prefix_trie)}
ORACLES = {"op3_shingle_join": OP3_SQL, "op4_warc_revisits": OP4_SQL, "op6_site_spread": OP6_SQL, "op10_suffix_repeats": OP10_SQL, "op11_merkle_manifest": OP11_SQL, "op13_prefix_trie": OP13_SQL}
