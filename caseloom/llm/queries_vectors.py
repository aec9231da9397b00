"""Queries over case vectors and the ranking frame: problems 3 and 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm.neighbors import most_similar
from caseloom.llm.topn import skipping, top_items
from caseloom.plans.tables import table

NEIGHBORS, COSINE = 10, 0.9


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = most_similar(table(spark, sf_dir, "case_vectors"), "case_id", "embedding", NEIGHBORS, COSINE)
    return near.select(F.least("case_id", "neighbor").alias("case_id_a"), F.greatest("case_id", "neighbor").alias("case_id_b")).distinct()


def p3_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every case whose id is divisible by 20, among all cases, whatever their cosine."""
    queries = lambda k: k.try_cast("bigint") % 20 == 0
    return most_similar(table(spark, sf_dir, "case_vectors"), "case_id", "embedding", NEIGHBORS, probes=256, leaf=512, only=queries)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_top(spark, sf_dir).select("query_id", "candidate_id")


def p5_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_items(table(spark, sf_dir, "ltr_features"), "query_id", "candidate_id", "dense_score", "scored_at", NEIGHBORS)


def p5_row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, and row groups read and passed over, of ``p5_found``."""
    return skipping(table(spark, sf_dir, "ltr_features"), "query_id", "candidate_id", "dense_score", "scored_at", NEIGHBORS)
