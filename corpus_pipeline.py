"""A corpus for training from the table of documents, in five stages: each written as Parquet and read again.

In every stage null texts count as empty, equal rows are rows of their own unless a stage says otherwise, texts are taken
whole, columns that the stage doesn't know stay as they are whatever their names, and no documents give none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenset.llm import mixing, packing, pii, quality, simhash
from lumenset.llm.common import materialize
from lumenset.llm.vocabulary import BYTE_BPE, vocabulary_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that neither the base rules nor the learned decision list rejects; those without words go. Labels may be missing, null or repeated."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts with a five-word similarity of 0.8: that with the least doc_id (null: last; ties: by its columns' hash)."""
    return simhash.drop_near_duplicates(docs, width=5, radius=20, similarity=0.8)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by its kind; n_chars follows the new text."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else clean


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's repetition rate says; a null source is a source, and reruns agree."""
    return mixing.mixture(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' token ids in sequences of 2048; an empty text has its end id alone."""
    return packing.pack(docs, vocabulary_path(BYTE_BPE))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix", mix),
    ("pack", pack),
]

#: Learned rules, hashes and token ids have no SQL form; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
