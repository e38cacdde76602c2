"""Queries of the training-data operators: op<N>_<name>, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ball_topk, block_max, chosen_path, decontam, gru_lm, html_density, line_dedup, pfair_mix, tiered_shards, token_counts, toxicity_fm, trie_resampling, weak_quality
from .common import public_tokenizer, table


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_density.extract(table(spark, sf_dir, "pages"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = """
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
lines AS (SELECT doc_id, r, unnest(string_split(text, chr(10))) AS line,
                 generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM docs),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
firsts AS (SELECT key, min(doc_id) AS first_id FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.first_id AS goes FROM keyed k LEFT JOIN firsts f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE goes) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT goes), '')) AS kept_sha256
FROM marked GROUP BY doc_id, r
"""


def op9_ball_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_topk.top_k(table(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH v AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS HUGEINT)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id AS vec_id,
             CAST(coalesce(list_sum(list_transform(range(1, least(len(q.x), len(c.x)) + 1), lambda i: q.x[i] * c.x[i])), 0) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.r <> c.r),
n AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM n WHERE rank <= 20
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": op1_html_text,
    "op6_line_dedup": op6_line_dedup,
    "op9_ball_topk": op9_ball_topk,
}
ORACLE_SQL: dict[str, str] = {"op6_line_dedup": OP6_SQL, "op9_ball_topk": OP9_SQL}


def op3_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_fm.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.max("n_windows").alias("n_windows"), F.max("n_slots").alias("n_slots"))


QUERIES |= {"op3_toxicity_fm": op3_toxicity_fm, "op8_decontam": op8_decontam}


def op5_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru_lm.score_documents(table(spark, sf_dir, "documents"))


QUERIES |= {"op5_gru_lm": op5_gru_lm}


def op10_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality.score_quality(table(spark, sf_dir, "documents"))


QUERIES |= {"op10_weak_quality": op10_weak_quality}


def op2_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = pfair_mix.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return mixed.select("doc_id", "mix_source", "mix_period", "mix_block", "mix_slot", "mix_order")


def op7_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiered_shards.shard(table(spark, sf_dir, "documents")).select("doc_id", "shard", "position", F.xxhash64("text").alias("text_hash"))


QUERIES |= {"op2_pfair_mix": op2_pfair_mix, "op7_tiered_shards": op7_tiered_shards}


def op4_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chosen_path.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "rep_id", "n_links")


OP4_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_sort(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                               ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS s FROM w),
k AS (SELECT min(doc_id) AS rep_id, s, list(doc_id) AS ids FROM s GROUP BY s),
u AS (SELECT rep_id, unnest(s) AS x, len(s) AS n FROM k),
p AS (SELECT a.rep_id AS a, b.rep_id AS b FROM u a JOIN u b ON a.x = b.x AND a.rep_id <> b.rep_id GROUP BY a.rep_id, b.rep_id, a.n, b.n HAVING 9 * count(*) >= 4 * (a.n + b.n)),
c AS (SELECT rep_id AS node, rep_id AS root FROM k UNION SELECT p.b, c.root FROM c JOIN p ON p.a = c.node),
m AS (SELECT node, min(root) AS class_id FROM c GROUP BY node),
l AS (SELECT a AS node, count(*) AS n FROM p GROUP BY a)
SELECT unnest(k.ids) AS doc_id, m.class_id, k.rep_id, coalesce(l.n, 0) AS n_links FROM k JOIN m ON m.node = k.rep_id LEFT JOIN l ON l.node = k.rep_id
"""


QUERIES |= {"op4_chosen_path": op4_chosen_path}
ORACLE_SQL |= {"op4_chosen_path": OP4_SQL}


def op11_trie_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH crc_table AS (SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) r(i)),
both_texts AS (SELECT 'd' AS side, doc_id, row_number() OVER () AS r, text FROM documents UNION ALL SELECT 'b', item_id, row_number() OVER (), text FROM benchmark),
words AS (SELECT side, doc_id, r, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM both_texts),
bytes AS (SELECT w, list_transform(range(octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), CAST(2 * i + 1 AS BIGINT), 2))::BIGINT) AS b FROM (SELECT DISTINCT w FROM words)),
buckets AS (SELECT w, xor(list_reduce([4294967295] || b, lambda c, x: xor(c // 256, t[CAST(xor(c % 256, x) + 1 AS BIGINT)])), 4294967295) % 10000 AS bucket FROM bytes, crc_table),
totals AS (SELECT bucket, count(*) FILTER (WHERE side = 'd') AS s, count(*) FILTER (WHERE side = 'b') AS t FROM words JOIN buckets USING (w) GROUP BY bucket),
gains AS (SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE))) AS BIGINT) AS gain FROM totals),
weights AS (SELECT r, count(*) AS n, CAST(sum(gain) AS BIGINT) AS g FROM words JOIN buckets USING (w) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY r),
scored AS (SELECT b.doc_id, b.r, coalesce(n, 0) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE (g - ((g % n) + n) % n) // n END AS weight,
                  ('0x' || substr(sha256('2024:' || coalesce(CAST(b.doc_id AS VARCHAR), '')), 1, 8))::BIGINT AS h FROM both_texts b LEFT JOIN weights w ON b.r = w.r WHERE b.side = 'd'),
noisy AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM scored),
placed AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n FROM noisy WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM noisy LEFT JOIN placed USING (r)
"""


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizer("byte_bpe_50k.json"))


QUERIES |= {"op11_trie_resampling": op11_trie_resampling, "op12_token_counts": op12_token_counts}
ORACLE_SQL |= {"op11_trie_resampling": OP11_SQL}


def op13_block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_max.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, list_transform(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents),
b AS (SELECT item_id, row_number() OVER () AS q, list_transform(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM benchmark),
stats AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS words FROM d WHERE len(w) > 0),
asked AS (SELECT q, item_id, term, count(*) AS times FROM (SELECT q, item_id, unnest(w) AS term FROM b) GROUP BY ALL),
postings AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM postings, stats GROUP BY term, docs),
parts AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words))) AS part FROM postings JOIN weights USING (term), stats),
scores AS (SELECT q, item_id, r, doc_id, CAST(sum(times * part) AS BIGINT) AS score FROM asked JOIN parts USING (term) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0
QUALIFY rank <= 10
"""

QUERIES |= {"op13_block_max": op13_block_max}
ORACLE_SQL |= {"op13_block_max": OP13_SQL}
