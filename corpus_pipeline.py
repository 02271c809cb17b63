"""Corpus pipeline: quality classifier, near copies, repeated passages, private data, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the columns of documents; the
last returns the packing. ``run`` applies them in order and cuts the lineage between stages by checkpoints.

Defined cases are those of the operators: rows with a null doc_id pass the near-copy and repeated-passage stages unchanged,
null and empty texts are kept and packed with length 1, and an empty table gives an empty packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioflow.llm import line_dedup, packing, pii, quality_classifier, simhash
from folioflow.llm.textkit import checkpoint, read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.keep_good(docs, read_table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.clean(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_copies),
    ("substring_dedup", repeated_passages),
    ("pii", private_data),
    ("best_fit_packing", packed),
]

#: Models, fingerprints and packing are beyond SQL; tests/llm checks run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = checkpoint(docs)
    return docs
