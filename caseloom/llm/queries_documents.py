"""Queries over the documents: problems 6, 7 and 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caseloom.llm.mixing import mix_sources
from caseloom.llm.quality import text_quality
from caseloom.llm.tokens import count_tokens, encode_corpus
from caseloom.plans.tables import table


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"), ["doc_id"], "text")


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), ["doc_id"], "text")


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sized = count_tokens(table(spark, sf_dir, "documents"), ["doc_id", "source"], "text")
    return mix_sources(sized, "doc_id", "source", "n_tokens", table(spark, sf_dir, "source_weights"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0].where("short").select("source")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0]


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_statistics(spark, sf_dir).where("unprosaic").select("doc_id")


def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_quality(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
