"""Queries of the training-data problems over the tables of a data directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriscope.llm import bpe, chunking, contamination, crossplit, encoding, groupsplit, neardup, readability, textforms
from veriscope.session import table

#: TESTDATA.md fixes three words and a similarity of 0.6 for problems 4 and 6.
NEAR = {"shingle": 3, "similarity": 0.6}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return textforms.lookalike_pairs(table(spark, d, "mini_samples"))


def p1_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "mini_samples").select("sample_id", textforms.consistent_form(F.col("text")).alias("text"))


def p1_tokens(spark: SparkSession, d: str) -> DataFrame:
    return textforms.confusable_tokens(table(spark, d, "mini_samples")).select("sample_id", "token", "kind", F.array_join("scripts", ",").alias("scripts"), "spelling")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.restore_texts(table(spark, d, "mini_samples")).select("sample_id").distinct()


def p2_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.restore_texts(table(spark, d, "mini_samples")).select("sample_id", "restored", F.array_join("chain", " < ").alias("chain"), "lossy")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    groups = groupsplit.record_groups(table(spark, d, "m1_records"), table(spark, d, "companies"))
    return groups.where("members > 1").select("id", "group_company")


def p3_splits(spark: SparkSession, d: str) -> DataFrame:
    return groupsplit.assign_splits(table(spark, d, "m1_records"), table(spark, d, "companies"), table(spark, d, "m1_distribution"))


def p3_companies(spark: SparkSession, d: str) -> DataFrame:
    return groupsplit.companies_per_split(table(spark, d, "m1_records"), table(spark, d, "companies"), p3_splits(spark, d))


def p3_deviation(spark: SparkSession, d: str) -> DataFrame:
    return groupsplit.split_deviation(table(spark, d, "m1_records"), p3_splits(spark, d), table(spark, d, "m1_distribution"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return crossplit.cross_split_pairs(table(spark, d, "mini_samples"), **NEAR)


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return crossplit.overlap_report(table(spark, d, "mini_samples"), p4_found(spark, d))


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return chunking.split_texts(table(spark, d, "kb_chunks"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_pieces(spark, d).where("pieces > 1 and piece = 0").select("chunk_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicate_pairs(table(spark, d, "mini_samples"), **NEAR)


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicate_groups(table(spark, d, "mini_samples"), **NEAR)


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_texts(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return contamination.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_levels(spark: SparkSession, d: str) -> DataFrame:
    return readability.reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_texts, p1_tokens, p2_found, p2_restored, p3_found, p3_splits, p3_companies, p3_deviation, p4_found, p4_report, p5_found, p5_pieces, p6_found, p6_groups, p7_ids, p8_found, p8_leaks, p9_levels)}
