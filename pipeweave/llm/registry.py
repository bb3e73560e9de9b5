"""The corpus operators as queries over the driver's tables, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipeweave.llm import langid, mixing, neardup, pieces, quality, rules, sharding, stages, topk, toxicity, warc
from pipeweave.llm.common import key_crc

PIECES = stages.PIECES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned from the rows that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    held = key_crc("doc_id") % 5 == 0
    model = langid.fit(docs.where(~held))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "lang_distance")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every 50th vector against all others."""
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors.where(F.col("vec_id") % 50 == 0), vectors, 5)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded, with two distinct sampled segmentations, each decoded too."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs, PIECES, samples=2).select("doc_id", "n_tokens", "ids", "ids_crc32", "decoded", "samples")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text, learned from labels that are not held out."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held = key_crc("doc_id") % 3 == 1
    model = toxicity.fit(docs, labels.where(~held))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held.alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.7).cast("int").alias("predicted"), F.size("segments").alias("n_segments"))


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups at Jaccard similarity 0.75 on 5-word shingles."""
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen shards of equal counts; equal texts together where they fit."""
    out = sharding.balanced_shards(_table(spark, sf_dir, "documents"), shards=16)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by co-training; every fifth document's label is held out."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held = key_crc("doc_id") % 5 == 0
    model = quality.fit(docs, labels.where(~held))
    scored = quality.score(docs, model)
    return scored.select("doc_id", held.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).alias("kept"))


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics of every text, and which documents the rules keep."""
    out = rules.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly", "rule", "band")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raked weight, sampling probability and draw of every document."""
    return mixing.mix(_table(spark, sf_dir, "documents"), returned=["doc_id", "source", "lang"])


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through ARC and WARC archives and back."""
    back = warc.read_archives(warc.write_archives(_table(spark, sf_dir, "pages")))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline: see ``stages``."""
    return stages.run(spark, sf_dir)


_TOPK_SQL = """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM p QUALIFY rank <= 5
"""

_NEARDUP_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(len(words) - 4), lambda i: array_to_string(words[i + 1:i + 5], ' ')) END) AS g FROM w
), e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a
), c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept FROM s JOIN c USING (doc_id)
"""

_WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CAST(CASE WHEN n >= 1000 AND page_id < top THEN top END AS BIGINT) AS refers_to
FROM m
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_topk, op3_sentencepiece, op4_toxicity, op5_neardup, op6_sharding, op7_quality, op8_rules, op9_mixing, op10_warc, pipeline)}


def oracle_sql() -> dict[str, str]:
    found = {"op2_topk": _TOPK_SQL, "op5_neardup": _NEARDUP_SQL, "op10_warc": _WARC_SQL}
    return found | ({"pipeline": stages.ORACLE_SQL} if stages.ORACLE_SQL else {})
