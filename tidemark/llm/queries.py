"""The registered queries of this folder and their check SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    additive_quality,
    alignment,
    bpe_trie,
    compression,
    conversation_repair,
    curve_packing,
    hyperdim,
    license_scan,
    ngram_join,
    pii,
    secret_scan,
    token_count,
    vptree,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return vptree.nearest(rows, rows.where(F.col("vec_id") % 100 == 0))


OP1_SQL = """
WITH rows AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
far AS (
  SELECT q.vec_id AS query_id, r.vec_id, sqrt(list_reduce(list_transform(list_zip(q.v, r.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])),
    lambda a, b: a + b)) AS score
  FROM rows q JOIN rows r ON q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank, vec_id, score FROM far)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its class, the number of other documents similar to it, and its copies."""
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents")).drop("digest")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licenses(_table(spark, sf_dir, "documents"))


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_trie.round_trip_digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = compression.quality(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.drop("text")


def op7_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(_table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hyperdim.language_id(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op10_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve_packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.align(_table(spark, sf_dir, "documents"), *paths)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repaired_digest(conversation_repair.damaged(_table(spark, sf_dir, "conversations")))


# Damage as the operator's test damage; then one step per row over role states 0 start, 1 system, 2 user, 3 assistant.
OP12_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
summed AS (
  SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(k, ''), lambda c: CAST(ord(c) AS BIGINT))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), CAST(range(8) AS BIGINT[])),
      lambda x, n: CASE WHEN x % 2 = 1 THEN xor(x // 2, CAST(3988292384 AS BIGINT)) ELSE x // 2 END)), CAST(4294967295 AS BIGINT)) % 20 AS d FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
    CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM summed JOIN (VALUES (1), (2)) c(copy) ON copy <= CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END),
placed AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS BIGINT) AS i, left(role, 1) AS first,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM damaged),
marked AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(first) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
counted AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before || first NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY conv_id),
inserted(q, p, price, letters) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 3, 'I'), (1, 2, 3, 'I'), (2, 3, 3, 'I'),
  (3, 2, 3, 'I'), (0, 3, 6, 'II'), (1, 3, 6, 'II'), (3, 3, 6, 'II')),
edit(p, after, need, letter, price) AS (VALUES (0, 1, 's', 'K', 0), (0, 2, 'u', 'K', 0), (1, 2, 'u', 'K', 0), (3, 2, 'u', 'K', 0), (2, 3, 'a', 'K', 0),
  (0, 2, NULL, 'R', 3), (1, 2, NULL, 'R', 3), (3, 2, NULL, 'R', 3), (2, 3, NULL, 'R', 3),
  (0, 0, NULL, 'D', 4), (1, 1, NULL, 'D', 4), (2, 2, NULL, 'D', 4), (3, 3, NULL, 'D', 4)),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, {'cost': CAST(0 AS BIGINT), 'audit': ''} AS best FROM counted
  UNION ALL
  SELECT w.conv_id, w.i + 1, e.after, min({'cost': CAST(w.best.cost + n.price + e.price + CASE WHEN r.fault = 'truncated' AND e.letter <> 'D' THEN 3 ELSE 0 END AS BIGINT),
    'audit': w.best.audit || n.letters || e.letter})
  FROM walk w JOIN marked r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1 JOIN inserted n ON n.q = w.q
    JOIN edit e ON e.p = n.p AND (e.letter = 'D' OR r.fault IN ('', 'truncated')) AND (e.need IS NULL OR e.need = r.first)
  GROUP BY w.conv_id, w.i, e.after),
found AS (
  SELECT w.conv_id, min({'cost': CAST(w.best.cost + n.price AS BIGINT), 'audit': w.best.audit || n.letters}) AS best
  FROM walk w JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i JOIN inserted n ON n.q = w.q AND n.p IN (0, 3) GROUP BY w.conv_id),
letters AS (
  SELECT conv_id, pos, substr(best.audit, pos, 1) AS letter FROM (SELECT *, unnest(range(1, CAST(length(best.audit) AS BIGINT) + 1)) AS pos FROM found)),
matched AS (
  SELECT *, count(*) FILTER (letter <> 'I') OVER so_far AS i, count(*) FILTER (letter <> 'D') OVER so_far AS out
  FROM letters WINDOW so_far AS (PARTITION BY conv_id ORDER BY pos)),
written AS (
  SELECT m.*, r.role, r.first, r.text, max(CASE WHEN out = 1 AND letter = 'K' AND r.first = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY m.conv_id) AS lead
  FROM matched m LEFT JOIN marked r ON r.conv_id IS NOT DISTINCT FROM m.conv_id AND r.i = m.i),
joined AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (out - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
    CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY pos) AS body FROM written WHERE letter <> 'D' GROUP BY conv_id)
SELECT a.conv_id, CAST(coalesce(c.gaps, 0) AS BIGINT) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
  coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, coalesce(f.best.cost, 0) AS cost, coalesce(f.best.audit, '') AS audit,
  sha256(coalesce(j.body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN found f ON f.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN joined j ON j.conv_id IS NOT DISTINCT FROM a.conv_id
"""


def op13_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive_quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_nearest,
        op2_ngram_join,
        op3_token_counts,
        op4_license_scan,
        op5_bpe_round_trip,
        op6_compression_quality,
        op7_disclosure,
        op8_secret_scan,
        op9_language_id,
        op10_curve_packing,
        op11_token_alignment,
        op12_conversation_repair,
        op13_additive_quality,
    )
}
ORACLES = {"op1_nearest": OP1_SQL, "op12_conversation_repair": OP12_SQL}
