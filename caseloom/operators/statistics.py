"""Corpus and label statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLDS = (0, 1024, 2048, 4096, 6144, 8192, 12288)


def label_statistics(labels: DataFrame, position: str = "pos") -> DataFrame:
    """One row: queries, pairs, mean, and the first query with the most and with the fewest labels."""
    by_query = labels.groupBy("query_id").agg(F.count("candidate_id").alias("n"), F.min(position).alias("_p"))
    most = F.max_by("query_id", F.struct(F.col("n"), -F.col("_p")))
    least = F.min_by("query_id", F.struct(F.col("n"), F.col("_p")))
    return by_query.agg(
        F.count(F.lit(1)).alias("queries"), F.sum("n").alias("pairs"), F.avg("n").alias("mean_labels"), F.max("n").alias("most"), most.alias("most_query"),
        F.min("n").alias("fewest"), least.alias("fewest_query"),
    )


def counter(values: DataFrame, value: str) -> DataFrame:
    """(value, count)"""
    return values.groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("count"))


def label_distribution(labels: DataFrame) -> DataFrame:
    """(value, count): how many queries have so many labels."""
    return counter(labels.groupBy("query_id").agg(F.count("candidate_id").alias("n")), "n")


def token_thresholds(lengths: DataFrame, n: str, thresholds: tuple[int, ...] = THRESHOLDS) -> DataFrame:
    """(threshold, over, share, mean): how many rows lie over each threshold. One pass, however many thresholds."""
    row = lengths.agg(F.count(F.lit(1)).alias("_all"), F.avg(n).alias("mean"), *[F.count_if(F.col(n) > t).alias(f"_{t}") for t in thresholds])
    items = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"_{t}").alias("over")) for t in thresholds])
    each = row.select("_all", "mean", F.explode(items).alias("x")).select("x.*", "_all", "mean")
    return each.select("threshold", "over", F.when(F.col("_all") > 0, F.col("over") / F.col("_all")).otherwise(0.0).alias("share"), "mean")


def histogram(lengths: DataFrame, n: str, width: int = 513, limit: int = 10_000) -> DataFrame:
    """(bin, low, count) of values up to the limit; empty bins too."""
    spark = lengths.sparkSession
    counts = lengths.where(F.col(n).between(0, limit)).groupBy(F.expr(f"cast({n} div {width} as int)").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    bins = spark.range(limit // width + 1).select(F.col("id").cast("int").alias("bin"))
    return bins.join(counts, "bin", "left").select("bin", (F.col("bin") * width).alias("low"), F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def length_summary(lengths: DataFrame, n: str) -> DataFrame:
    """One row: mean, min, max, and the range within five standard deviations (of the population) of the mean, from 0."""
    mean, dev = F.avg(n), F.stddev_pop(n)
    return lengths.agg(mean.alias("mean"), F.min(n).alias("min"), F.max(n).alias("max"), F.greatest(F.lit(0.0), mean - 5 * dev).alias("range_low"), (mean + 5 * dev).alias("range_high"))


def group_sizes(df: DataFrame, key: str = "query_id", position: str = "pos") -> DataFrame:
    """(key, size, first): rows of each group and where it first appears."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("size"), F.min(position).alias("first"))


def outcome_counts(df: DataFrame, outcome: Column) -> DataFrame:
    """(reason, count)"""
    return df.groupBy(outcome.alias("reason")).agg(F.count(F.lit(1)).alias("count"))


def flatten_paragraphs(cases: DataFrame, paragraphs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Task-2 preparation. Returns samples and counts by reason.

    cases: query_id, text; paragraphs: query_id, par_id, text; labels: query_id, par_id. Samples: query_id, candidate_id,
    label. A labelled query counts as missing_case, blank_case, no_paragraphs, no_positive_left or used; only used ones give
    samples. Positives that name no paragraph are dropped.
    """
    from caseloom.functions.ids import composed_id, paragraph_id

    cases = cases.select(paragraph_id(F.col("query_id")).alias("q"), F.col("text").alias("t")).where("q is not null")
    pars = paragraphs.select(paragraph_id(F.col("query_id")).alias("q"), paragraph_id(F.col("par_id")).alias("p")).where("q is not null and p is not null").distinct()
    wanted = labels.select(paragraph_id(F.col("query_id")).alias("q"), paragraph_id(F.col("par_id")).alias("p")).where("q is not null").distinct()
    positives = wanted.join(pars, ["q", "p"], "left_semi").withColumn("_y", F.lit(1))
    per = wanted.select("q").distinct().join(cases, "q", "left")
    per = per.join(pars.groupBy("q").agg(F.count(F.lit(1)).alias("np")), "q", "left").join(positives.groupBy("q").agg(F.count(F.lit(1)).alias("ny")), "q", "left")
    reason = F.when(F.col("t").isNull(), "missing_case").when(F.trim("t") == "", "blank_case").when(F.col("np").isNull(), "no_paragraphs").when(F.col("ny").isNull(), "no_positive_left").otherwise("used")
    judged = per.withColumn("reason", reason)
    samples = pars.join(judged.where("reason = 'used'").select("q"), "q", "left_semi").join(positives, ["q", "p"], "left")
    out = samples.select(F.col("q").alias("query_id"), composed_id(F.col("q"), F.col("p")).alias("candidate_id"), F.coalesce("_y", F.lit(0)).alias("label"))
    return out, outcome_counts(judged, F.col("reason"))
