"""The learning-to-rank frame: case attributes, pair scores and chunk similarities joined onto (query, candidate) pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions.text import PLACEHOLDERS, case_year, clean_text, placeholder_count, stripped
from caseloom.operators.lexical import analyzed_length
from caseloom.operators.ranking import rank_by_candidate

COUNTS = {"citation_num": "CITATION_SUPPRESSED", "reference_num": "REFERENCE_SUPPRESSED", "fragment_num": "FRAGMENT_SUPPRESSED"}
assert set(COUNTS.values()) == set(PLACEHOLDERS)


def text_or_raw(clean: Column, raw: Column) -> Column:
    """The clean text; where it is null or blank, the raw text cleaned."""
    return F.coalesce(F.when(stripped(clean) != "", clean), clean_text(raw))


def case_features(cases: DataFrame, key: str = "case_id", raw: str = "raw_text", clean: str | None = "clean_text") -> DataFrame:
    """(case_id, clean_text, year, year_source, length, citation_num, reference_num, fragment_num) of each case, once each."""
    text = text_or_raw(F.col(clean), F.col(raw)) if clean else clean_text(F.col(raw))
    base = cases.select(F.col(key).alias("case_id"), text.alias("clean_text"), case_year(F.col(raw)).alias("_y"), *[placeholder_count(F.col(raw), t).alias(c) for c, t in COUNTS.items()])
    return base.select("case_id", "clean_text", F.col("_y.year").alias("year"), F.col("_y.source").alias("year_source"), analyzed_length(F.col("clean_text")).alias("length"), *COUNTS)


def year_difference(query_year: Column, doc_year: Column) -> Column:
    """0 where either year is unknown (-1)."""
    return F.when((query_year == -1) | (doc_year == -1), 0).otherwise(query_year - doc_year)


def per_word(count: Column, length: Column) -> Column:
    return (count.cast("float") / F.greatest(length, F.lit(1)).cast("float")).cast("float")


def feature_frame(pairs: DataFrame, features: DataFrame, scores: tuple[str, ...] = ("bm25_score", "qld_score", "bm25_ngram_score", "dense_score")) -> DataFrame:
    """The base columns of the frame for pairs that carry the score columns (null scores are 0) and chunk similarities.

    Attributes of absent cases are 0, their years -1. Both joins bring the same narrow table; it is joined by key, so a
    small one is broadcast and a large one shuffled.
    """
    side = features.select("case_id", "year", "length", *COUNTS)
    q = side.select(F.col("case_id").alias("query_id"), F.col("year").alias("query_year"), F.col("length").alias("query_length"), *[F.col(c).alias(f"query_{c}") for c in COUNTS])
    d = side.select(F.col("case_id").alias("candidate_id"), F.col("year").alias("doc_year"), F.col("length").alias("doc_length"), *[F.col(c).alias(f"doc_{c}") for c in COUNTS])
    out = pairs.join(q, "query_id", "left").join(d, "candidate_id", "left")
    zero = ["query_length", "doc_length", *(f"{s}_{c}" for s in ("query", "doc") for c in COUNTS)]
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero} | {c: F.coalesce(c, F.lit(-1)) for c in ("query_year", "doc_year")})
    out = out.withColumns({c: F.coalesce(F.when(~F.isnan(F.col(c)), F.col(c)), F.lit(0.0)).cast("float") for c in scores})
    length = {"query": F.col("query_length"), "doc": F.col("doc_length")}
    ratios = {f"{s}_{c.replace('_num', '_ratio')}": per_word(F.col(f"{s}_{c}"), length[s]) for s in length for c in COUNTS}
    out = out.withColumns(
        {
            "len_ratio": per_word(length["query"], length["doc"]),
            "len_diff": F.abs(length["query"] - length["doc"]),
            "year_diff": year_difference(F.col("query_year"), F.col("doc_year")),
            **ratios,
        }
    )
    for score, rank in (("bm25_score", "bm25_rank"), ("dense_score", "dense_rank")):
        out = rank_by_candidate(out, score, rank)
    return out


def with_labels(pairs: DataFrame, labels: DataFrame, name: str = "label") -> DataFrame:
    """pairs with 1 for relevant ones and 0 for others."""
    relevant = labels.select("query_id", "candidate_id").distinct().withColumn(name, F.lit(1))
    base = pairs.drop(name)
    return base.join(relevant, ["query_id", "candidate_id"], "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("tinyint"))
