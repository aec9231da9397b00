"""Queries over case texts: problems 1, 2 and 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm.neardup import near_duplicate_groups, near_duplicate_pairs
from caseloom.llm.spans import shared_shares, shared_spans
from caseloom.llm.splitting import split_oversized
from caseloom.plans.tables import current_rows, table

SPAN_CHARS = 200
SIMILARITY, SHINGLE = 0.6, 3


def current(spark: SparkSession, sf_dir: str, *texts: str) -> DataFrame:
    return current_rows(table(spark, sf_dir, "case_features"), "case_id", "loaded_at", list(texts))


def _long_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, text_field, text) of the current texts."""
    fields = [F.struct(F.lit(c).alias("text_field"), F.col(c).alias("text")) for c in ("raw_text", "clean_text")]
    return current(spark, sf_dir, "raw_text", "clean_text").select("case_id", F.explode(F.array(*fields)).alias("f")).select("case_id", "f.*")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(_long_texts(spark, sf_dir), ["case_id", "text_field"], "text")


def p1_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same texts cut with the least sum of penalties and imbalance."""
    return split_oversized(_long_texts(spark, sf_dir), ["case_id", "text_field"], "text", objective="balanced")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs, those between copies too, since the problem's cases are pairs of cases; ``p2_links`` and ``p2_groups`` grow with copies only in proportion."""
    return near_duplicate_pairs(current(spark, sf_dir, "clean_text"), "case_id", "clean_text", SIMILARITY, SHINGLE, copies="pairs")


def p2_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs between first members of classes, and of each copy with its first."""
    return near_duplicate_pairs(current(spark, sf_dir, "clean_text"), "case_id", "clean_text", SIMILARITY, SHINGLE)


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(current(spark, sf_dir, "clean_text"), "case_id", "clean_text", SIMILARITY, SHINGLE)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans(current(spark, sf_dir, "raw_text"), "case_id", "raw_text", SPAN_CHARS)


def p4_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_shares(current(spark, sf_dir, "raw_text"), "case_id", "raw_text", SPAN_CHARS)
