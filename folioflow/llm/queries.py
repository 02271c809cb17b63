"""Queries of the training-data operators, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import line_dedup, packing, pii, quality_classifier, quality_rules, sentence_pieces, simhash, suffix_dedup, tiff, token_blocks
from .textkit import read_table


def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks.to_blocks(read_table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.spans(read_table(spark, sf_dir, "documents"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(read_table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.removed(read_table(spark, sf_dir, "documents"))


def op4_substring_dedup_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.removed_passages(read_table(spark, sf_dir, "documents"))


def op5_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read_table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode(read_table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op9_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of a picture of every embedding."""
    pages = tiff.pages(tiff.rendered(read_table(spark, sf_dir, "embeddings")), "id", "content")
    size, total = F.octet_length("pixels").alias("n_bytes"), F.round("pixel_sum", 4).alias("pixel_sum")
    return pages.select(F.col("id").alias("vec_id"), "page", "width", "height", "bits", "compression", "predictor", "tiled", size, total, "error")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_blocks, op2_suffix_dedup, op3_simhash_near_dedup, op4_substring_dedup, op4_substring_dedup_passages, op5_private_data, op6_quality_rules, op7_sentence_pieces, op8_best_fit_packing, op9_tiff_pages, op10_quality_classifier)}

ORACLE_SQL: dict[str, str] = {"op2_suffix_dedup": suffix_dedup.ORACLE_SQL, "op4_substring_dedup": line_dedup.ORACLE_SQL, "op4_substring_dedup_passages": line_dedup.PASSAGES_SQL, "op8_best_fit_packing": packing.ORACLE_SQL, "op9_tiff_pages": tiff.ORACLE_SQL}
