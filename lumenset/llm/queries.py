"""Registered queries of this subpackage's operators, each over its whole table."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenset.llm import chat, html, idfiles, minhash, mixing, negatives, packing, passages, permutation, pii, quality, repair, simhash
from lumenset.llm.blocks import usable
from lumenset.llm.common import materialize
from lumenset.llm.vocabulary import BYTE_BPE, vocabulary_path


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judged(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
    return out.select("doc_id", *[F.col(f"quality.{c}").alias(c) for c in names])


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), vocabulary_path(BYTE_BPE))


def op3_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfiles.read(*idfiles.write(_read(spark, sf_dir, "documents"), vocabulary_path(BYTE_BPE)))


def op4_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(_read(spark, sf_dir, "conversations"))


OP4_SQL = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|im_', '<|im-') AS words FROM conversations
), views AS (
  SELECT DISTINCT conv_id, speaker AS view FROM turns WHERE speaker <> 'system'
), made AS (
  SELECT t.*, v.view,
    CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = view THEN 'assistant' ELSE 'user' END AS as_role,
    speaker <> 'system' AND speaker = view AS train,
    CASE WHEN speaker = 'system' OR speaker = view THEN '' ELSE ' name=' || CASE WHEN regexp_replace(speaker, '[^A-Za-z0-9_-]', '_', 'g') = speaker THEN speaker
      ELSE regexp_replace(speaker, '[^A-Za-z0-9_-]', '_', 'g') || '_' || left(md5(speaker), 8) END END AS name
  FROM turns t JOIN views v ON t.conv_id IS NOT DISTINCT FROM v.conv_id
), parts AS (
  SELECT *, '<|im_start|>' || as_role || name || chr(10) AS head FROM made
), whole AS (
  SELECT *, head || words || '<|im_end|>' || chr(10) AS rendered FROM parts
), placed AS (
  SELECT *, CAST(coalesce(sum(length(rendered)) OVER (
    PARTITION BY conv_id, view ORDER BY turn NULLS FIRST, speaker, words ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "start"
  FROM whole
)
SELECT conv_id, view, turn, speaker, as_role, train, "start", "start" + length(rendered) AS "end", "start" + length(head) AS mask_start,
  CASE WHEN train THEN "start" + length(rendered) - 1 ELSE "start" + length(head) END AS mask_end, rendered
FROM placed
"""


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_read(spark, sf_dir, "documents"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.neighbour_report(_read(spark, sf_dir, "documents"))


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(_read(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mixed_rows(_read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    taken = (F.col("mix.copies") * F.col("mix.size")).alias("taken")
    return out.select("doc_id", "mix.size", "mix.source_size", "mix.target", taken, "source")


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url", html.extracted().alias("text"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.report(repair.damaged(_read(spark, sf_dir, "conversations")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings").filter(usable("embedding"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("double"))
    return negatives.mine(rows.select("vec_id", label.alias("label"), whole.alias("vector")), F.col("id") % 50 == 0)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.w, b.w) AS BIGINT) AS score
  FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS k FROM s WHERE same
), n AS (
  SELECT p.anchor_id, p.other AS positive_id, s.other AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY s.score DESC, s.other) AS r
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score WHERE p.k <= 5
)
SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS "rank", negative_id, positive_score, negative_score FROM n WHERE r <= 3
"""


def op13_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = materialize(permutation.build_index(_read(spark, sf_dir, "embeddings")), "index")
    return permutation.search(index, F.col("id") % 100 == 0)


QUERIES = {
    f.__name__: f
    for f in (op1_quality_rules, op2_packing, op3_id_files, op4_chat_rotation, op5_pii, op6_minhash, op7_passages, op8_simhash, op9_mixing, op10_main_text, op11_structure_repair, op12_hard_negatives, op13_permutation_index)
} | {"pipeline": corpus_pipeline.run}
ORACLES = {"op4_chat_rotation": OP4_SQL, "op12_hard_negatives": OP12_SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
