"""The training-data operators as registered queries, and their SQL where SQL can say
them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, exact_dedup, fingerprints, html_extract, lm, merkle, mixing, quality, sharding,
               simhash, token_counts, toxicity, whitening)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_fold(folds: int, fold: int):
    """Whether crc32 of the id as text leaves remainder ``fold``."""
    return lambda c: F.crc32(c.cast("string")) % folds == fold


def _train_labelled(c):
    return ~crc_fold(3, 1)(c)


def _train_lm(c):
    return ~crc_fold(7, 2)(c)


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.ToxicityModel:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.learn(documents(spark, sf_dir), labels, _train_labelled)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(documents(spark, sf_dir)).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.neighbour_fingerprints(documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.with_score(documents(spark, sf_dir).select("doc_id", "text"),
                                 toxicity_model(spark, sf_dir), counts=True)
    held_out = F.coalesce(crc_fold(3, 1)(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score",
                         (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
                         "n_abuse", "n_misspelled", "n_quoted")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", "taken")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).select(
        "doc_id", "fingerprint", "component_id")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir)).drop("row_number")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir), _train_lm)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(documents(spark, sf_dir))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return html_extract.main_text(pages).select("page_id", "url", "text", "n_chars")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return (white.withColumn("deviation", F.col("deviation").cast("long"))
            .select("vec_id", "n", "deviation", "explained", "identity_error",
                    F.posexplode("whitened").alias("at", "whitened"))
            .select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened",
                    F.get("explained", "at").alias("explained"), "identity_error"))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.with_score(docs, quality.learn(docs, labels, _train_labelled),
                                score_col="score")
    held_out = F.coalesce(crc_fold(3, 1)(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score",
                         (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.prove(documents(spark, sf_dir))


def queries() -> dict:
    import corpus_pipeline
    found = [op1_exact_dedup, op2_document_fingerprints, op3_toxicity, op4_token_counts,
             op5_source_mixing, op6_simhash, op7_sharding, op8_lm_scoring, op9_byte_bpe,
             op10_html_extraction, op11_embedding_whitening, op12_quality_classifier,
             op13_merkle_manifest]
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


EXACT_DEDUP_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

MIXING_SQL = r"""
WITH doc AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('42|' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS place FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w
  FROM doc GROUP BY source),
total AS (SELECT 1.5 * sum(source_size)::DOUBLE AS t FROM src),
fill AS (  -- the level at which each source would fill up, in that order
  SELECT s.*, (2.0 * source_size)::DOUBLE / w AS full_at,
         (t - coalesce(sum((2.0 * source_size)::DOUBLE) OVER (
             ORDER BY (2.0 * source_size)::DOUBLE / w, source NULLS LAST
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY (2.0 * source_size)::DOUBLE / w, source NULLS LAST
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM src s, total),
goal AS (
  SELECT source, source_size, round(CAST(CASE WHEN level >= full_at THEN 2.0 * source_size
           ELSE w * (SELECT max(level) FROM fill WHERE level < full_at) END AS DOUBLE), 6) AS target
  FROM fill),
placed AS (
  SELECT d.*, g.source_size, g.target,
         least(CAST(round(g.target) AS BIGINT), 2 * g.source_size) AS quota,
         CAST(sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id, size
              ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start
  FROM doc d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(least(greatest(quota - start, 0), size)
            + least(greatest(quota - start - source_size, 0), size) AS BIGINT) AS taken
FROM placed
"""


def _field(value: str) -> str:
    return (f"CASE WHEN {value} IS NULL THEN '-' ELSE CAST(octet_length(encode(CAST({value} AS "
            f"VARCHAR))) AS VARCHAR) || ':' || CAST({value} AS VARCHAR) END")


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


# Trees are grown level by level; a document's path collects the neighbours in its runs.
MERKLE_SQL = rf"""
WITH RECURSIVE
crc_table AS (  -- of the reversed polynomial of CRC-32
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
                          lambda c, x: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS t
  FROM range(256) r(i)),
doc AS (
  SELECT doc_id, source, {_leaf('text')} AS leaf,
         {_leaf("replace(text, chr(10), '')")} AS shortened,
         xor(list_reduce(list_prepend(4294967295, list_transform(
               string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 2 = 0 AS tampered
  FROM documents, crc_table),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree
  FROM doc),
grown AS (
  SELECT tree, 0 AS lvl, pos, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM placed
  UNION ALL
  SELECT tree, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)),
         count(*) OVER (PARTITION BY tree)
  FROM grown WHERE n > 1 GROUP BY tree, lvl, pos // 3),
top AS (
  SELECT 0 AS lvl, tree AS pos, h, count(*) OVER () AS n FROM grown WHERE n = 1
  UNION ALL
  SELECT lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), count(*) OVER ()
  FROM top WHERE n > 1 GROUP BY lvl, pos // 3),
beside AS (  -- what stands left and right of a node in its run
  SELECT tree, lvl, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '')
         AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM (SELECT * FROM grown UNION ALL SELECT -1, * FROM top) a
  JOIN (SELECT * FROM grown UNION ALL SELECT -1, * FROM top) b USING (tree, lvl)
  WHERE a.n > 1 AND a.pos // 3 = b.pos // 3 GROUP BY tree, lvl, a.pos),
path AS (
  SELECT p.tree, p.pos, list(l || '|' || r ORDER BY b.tree = -1, b.lvl) AS steps,
         string_agg(l || r, '' ORDER BY b.tree = -1, b.lvl) AS proof
  FROM placed p JOIN beside b
    ON (b.tree = p.tree AND b.pos = p.pos // CAST(pow(3, b.lvl) AS BIGINT))
    OR (b.tree = -1 AND b.pos = p.tree // CAST(pow(3, b.lvl) AS BIGINT))
  GROUP BY p.tree, p.pos),
folded AS (
  SELECT p.*, s.h AS subroot, r.h AS root, sha256(coalesce(q.proof, '')) AS proof_sha256,
         list_reduce(list_prepend(CASE WHEN coalesce(tampered, false) THEN shortened ELSE leaf END,
                                  coalesce(q.steps, [])),
                     lambda a, s: sha256(split_part(s, '|', 1) || a || split_part(s, '|', 2)))
           AS folded_root
  FROM placed p LEFT JOIN path q ON p.tree = q.tree AND p.pos = q.pos
  JOIN grown s ON s.tree = p.tree AND s.n = 1 JOIN top r ON r.n = 1)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM folded
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": EXACT_DEDUP_SQL, "op5_source_mixing": MIXING_SQL,
            "op13_merkle_manifest": MERKLE_SQL}
