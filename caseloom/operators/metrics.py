"""Evaluation of runs against relevant pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.operators.ranking import positions_of

PAIR = ["query_id", "candidate_id"]


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.when(b != 0, a / b), F.lit(0.0))


def prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"precision": p, "recall": r, "f1": ratio(2 * p * r, p + r)}


def micro_prf(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1 pooled over all queries.

    Labels are a set, predictions a list: a wrong pair counts each time it is there, a right one once.
    """
    relevant = labels.select(*PAIR).distinct().withColumn("_r", F.lit(1))
    listed = predictions.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("_n"))
    both = listed.join(relevant, PAIR, "full_outer")
    tp = F.count_if(F.col("_n").isNotNull() & F.col("_r").isNotNull())
    fp = F.coalesce(F.sum(F.when(F.col("_r").isNull(), F.col("_n"))), F.lit(0))
    fn = F.count_if(F.col("_n").isNull())
    return both.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn")).withColumns(prf(F.col("tp"), F.col("fp"), F.col("fn")))


def evaluate(predictions: DataFrame, labels: DataFrame, queries: DataFrame | None = None, skip_unanswered: bool = False) -> DataFrame:
    """``micro_prf`` over the labels of the given queries (of all labelled ones by default); queries without predictions
    count as empty, or are skipped, which raises recall."""
    labels = labels if queries is None else labels.join(queries.select("query_id").distinct(), "query_id", "left_semi")
    predictions = predictions.join((labels if queries is None else queries).select("query_id").distinct(), "query_id", "left_semi")
    if skip_unanswered:
        labels = labels.join(predictions.select("query_id").distinct(), "query_id", "left_semi")
    return micro_prf(predictions, labels)


def top_k_metrics(ranked: DataFrame, labels: DataFrame, k: int, rank: str = "rank") -> DataFrame:
    """``micro_prf`` of ranks up to k; labels may come from before any filter, so what it removed stays a miss."""
    return micro_prf(ranked.where(F.col(rank) <= k), labels)


def rank_metrics(ranked: DataFrame, label: str = "label", rank: str = "rank", queries: DataFrame | None = None) -> DataFrame:
    """(query_id, p_at_5, r_at_5, ndcg_at_10, relevant) by query; P@5 always divides by 5, and queries without rows score 0."""
    by_query = ranked.groupBy("query_id").agg(*_rank_sums(F.col(label), F.col(rank), F.lit(2**31 - 1)), F.sum(F.col(label).cast("long")).alias("relevant"))
    out = by_query.select("query_id", *_rank_scores(F.lit(10)), "relevant")
    if queries is None:
        return out
    return queries.select("query_id").distinct().join(out, "query_id", "left").na.fill(0)


def _rank_sums(label: Column, rank: Column, k: Column) -> list[Column]:
    relevant = label.cast("double")
    at5 = F.sum(F.when(rank <= F.least(k, F.lit(5)), relevant).otherwise(0.0)).alias("_rel5")
    gain = F.sum(F.when(rank <= F.least(k, F.lit(10)), relevant / F.log2(rank + 1.0)).otherwise(0.0)).alias("_dcg")
    return [at5, gain]


def ideal_dcg(relevant: Column) -> Column:
    n = F.least(relevant.cast("int"), F.lit(10))
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))).otherwise(0.0)


def _rank_scores(_: Column) -> list[Column]:
    return [
        (F.col("_rel5") / 5.0).alias("p_at_5"),
        ratio(F.col("_rel5"), F.col("relevant")).alias("r_at_5"),
        ratio(F.col("_dcg"), ideal_dcg(F.col("relevant"))).alias("ndcg_at_10"),
    ]


def coverage(predictions: DataFrame, queries: DataFrame) -> DataFrame:
    """One row: expected and predicted queries, expected ones without a prediction, predicted ones that none expects."""
    expected = queries.select("query_id").distinct().withColumn("_e", F.lit(1))
    predicted = predictions.select("query_id").distinct().withColumn("_p", F.lit(1))
    both = expected.join(predicted, "query_id", "full_outer")
    return both.agg(F.count("_e").alias("expected"), F.count("_p").alias("predicted"), F.count_if(F.col("_p").isNull()).alias("missing"), F.count_if(F.col("_e").isNull()).alias("unexpected"))


def random_baseline(labels: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(query_id, candidate_id): for every labelled query k documents in seeded order from all labelled ones but itself.

    The documents stand in one seeded order, and each query starts at its own seeded place in it and goes round, so a
    query's k documents are found by position: no query meets all documents.
    """
    docs = labels.select("candidate_id").where(F.col("candidate_id").isNotNull()).distinct()
    hashed = docs.withColumn("_h", F.md5(F.concat_ws("|", F.lit(seed), "candidate_id")))
    placed = positions_of(hashed, [F.col("_h"), F.col("candidate_id")], "_at").drop("_h")
    n = F.broadcast(placed.agg(F.count(F.lit(1)).alias("_n")))  # one row
    start = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "query_id")), 1, 13), 16, 10).cast("long")
    queries = labels.select("query_id").where(F.col("query_id").isNotNull()).distinct().join(n).where("_n > 0")
    turns = queries.withColumn("_i", F.explode(F.sequence(F.lit(0), F.least(F.lit(k), F.col("_n") - 1))))
    found = turns.withColumn("_at", F.pmod(start + F.col("_i"), F.col("_n"))).join(placed, "_at").where("query_id != candidate_id")
    ranked = found.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy("_i")))
    return ranked.where(F.col("_r") <= k).select(*PAIR)


def logits_metrics(logits: DataFrame, ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """One row over logits (sample, scores with the positive first): acc@k for each k and the mean cross-entropy.

    The positive is among the first k if fewer than k others score higher; ties go to the positive.
    """
    first = F.get("scores", F.lit(0)).cast("double")
    better = F.size(F.filter("scores", lambda s: s > F.get("scores", F.lit(0))))
    top = F.array_max("scores").cast("double")
    loss = top + F.log(F.aggregate("scores", F.lit(0.0), lambda a, s: a + F.exp(s.cast("double") - top))) - first
    cols = [F.avg((better < k).cast("double")).alias(f"acc_at_{k}") for k in ks]
    return logits.where(F.size("scores") > 0).agg(*cols, F.avg(loss).alias("loss"))


def paragraph_metrics(ranked: DataFrame, labels: DataFrame, queries: DataFrame, rank: str = "rank") -> DataFrame:
    """Task-2 micro metrics at top 1 and top 2 (k, tp, fp, fn, precision, recall, f1); each query of ``queries`` counts."""
    parts = [evaluate(ranked.where(F.col(rank) <= k), labels, queries).select(F.lit(k).alias("k"), "*") for k in (1, 2)]
    return parts[0].unionByName(parts[1])
