"""From raw documents to packed training sequences: five stages, each written as Parquet and read again.

A stage is (spark, docs, sf_dir) -> DataFrame. All but the last return the columns of documents.
Null texts and empty tables pass through; extra columns of the input are kept up to the last stage.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkframe.llm import mixing, near_dups, packing, pii, quality
from inkframe.llm.names import fresh
from inkframe.llm.queries import tokenizer_path
from inkframe.session import cut, ensure_checkpoint_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that importance resampling does not draw (operator 10)."""
    return quality.Classifier(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).keep(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of near duplicates (operator 1), that with the smallest doc_id.

    Rows of one doc_id with different texts belong to the classes of their texts, and so do rows without
    doc_id, which stand for a class only if none of its rows has one.
    """
    row, key = fresh(docs, "text_digest"), fresh(docs, "own_id")
    kept_id, kept_digest = fresh(docs, "kept_id"), fresh(docs, "kept_digest")
    kept = near_dups.representatives(docs).toDF(kept_id, kept_digest)
    named = docs.withColumns({row: near_dups.text_digest(F.col("text")), key: F.col("doc_id").cast("long")})
    one = named.join(kept, F.col(key).eqNullSafe(F.col(kept_id)) & (F.col(row) == F.col(kept_digest)), "left_semi")
    return one.dropDuplicates([key, row]).drop(key, row)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the kind of span in brackets (operator 2)."""
    return pii.redact(docs, pii.SpanClassifier(cut(pii.spans(docs))))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes the documents that the schedule of sources takes, as often as it does (operator 8)."""
    return mixing.mix_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in sequences of 2048 tokens (operator 7)."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
#: Training, sampling by hashes and tokenizing are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, written between stages into the shared folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
