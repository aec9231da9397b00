"""Mixing sources to target weights (problem 7).

Each source gets a budget: its share of the mix. Whole rounds of its documents are used first. What then remains of the
budget is a subset-sum problem over documents, solved by exact length: documents are counted by length, each length gets
its proportional part, and bounded-knapsack dynamic programming fits the rest as closely as it can be fitted. Documents
of a length are interchangeable, so the chosen number of each length is taken in a seeded order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.plans.tables import written

#: Budget, in tokens, up to which the dynamic program runs; more is filled in proportion first.
FIT = 1 << 16
_BUCKETS = 4096


def normal_source(name: str) -> Column:
    """Trimmed of white space and lower-cased."""
    return F.lower(F.regexp_replace(F.col(name), r"(?U)^\s+|\s+$", ""))


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, limit: int = FIT) -> np.ndarray:
    """How many documents of each length to take: the sum is at most the budget and as near to it as found.

    All but an eighth of ``limit`` is filled in proportion, floor(count * part / total) of each length; longest first, more
    are taken while more than ``limit`` is left over; the rest is solved exactly among documents not yet taken.
    """
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    # exact integers: products may pass 2^63
    part = max(0, budget - limit // 8)
    taken = np.array([int(c) * part // total for c in counts], np.int64)
    left = budget - int((lengths * taken).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if left <= limit:
            break
        more = min(int(counts[i] - taken[i]), (left - limit + int(lengths[i]) - 1) // int(lengths[i]), left // int(lengths[i]))
        taken[i] += more
        left -= more * int(lengths[i])
    # bounded knapsack: counts in binary parts, and the part by which each sum was first reached
    left = min(left, limit)
    reached = np.zeros(left + 1, bool)
    reached[0] = True
    first = np.full(left + 1, -1, np.int64)
    parts: list[tuple[int, int]] = []
    for i in np.flatnonzero((lengths <= left) & (counts > taken) & (lengths > 0)):
        if reached[left]:
            break
        spare, size = min(int(counts[i] - taken[i]), left // int(lengths[i])), 1
        while spare > 0:
            n = min(size, spare)
            step = n * int(lengths[i])
            fresh = np.flatnonzero(reached[: left + 1 - step] & ~reached[step:]) + step
            first[fresh] = len(parts)
            reached[fresh] = True
            parts.append((i, n))
            spare -= n
            size *= 2
    at = int(np.flatnonzero(reached)[-1])
    while at:
        i, n = parts[first[at]]
        taken[i] += n
        at -= n * int(lengths[i])
    return taken


def mix_sources(df: DataFrame, key: str, source: str, size: str, weights: DataFrame, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """A mix as large as all of df, by source. Returns its report and its documents.

    Report, one row for each row of weights: source, target_share, max_repeats, docs, source_size, target_size (of the
    mix), rounds, mixed_size, share_reached (of what the mix holds), short (target_share of the mix is more than
    max_repeats times the source), left (of the budget, which is the target or what the source can fill). Documents: key, source, repeats, for documents used at least once.

    Sources compare trimmed and lower-cased; documents of null or unlisted sources count for the size only, as do those
    of size 0 or null. A source without documents reaches 0. Null shares and repeats count as 0. Keys should be unique:
    repeated rows are documents of their own, except that ties of the seeded order fall by row.
    """
    docs = written(df.select(F.col(key).alias("k"), normal_source(source).alias("source"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("n")), "sizes")
    wanted = weights.select(
        normal_source("source").alias("source"),
        F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)).alias("target_share"),
        F.coalesce(F.col("max_repeats").cast("long"), F.lit(0)).alias("max_repeats"),
    )
    total = docs.agg(F.sum("n")).first()[0] or 0
    listed = docs.where("n > 0").groupBy("source", "n").agg(F.count(F.lit(1)).alias("c"))
    lengths = written(listed.join(wanted.select("source").distinct(), "source"), "lengths")
    sums = lengths.groupBy("source").agg(F.sum("c").alias("docs"), F.sum(F.col("n") * F.col("c")).alias("source_size"))
    plan = (
        wanted.join(sums, "source", "left")
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("docs", "source_size")})
        .withColumn("target_size", F.col("target_share") * F.lit(total))
        .withColumn("short", F.col("target_size") > F.col("max_repeats") * F.col("source_size"))
        .withColumn("budget", F.least(F.floor(F.col("target_size") + 1e-6), F.col("max_repeats") * F.col("source_size")))
        .withColumn("rounds", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)).cast("long"))
    )
    plan = written(plan.withColumn("rest", F.col("budget") - F.col("rounds") * F.col("source_size")), "plan")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        # distinct lengths of a source: at most the root of twice its size, whatever its number of documents
        rows = rows.sort_values("n")
        take = fit_budget(rows["n"].to_numpy(), rows["c"].to_numpy(), int(rows["rest"].iloc[0]))
        return pd.DataFrame({"source": rows["source"], "n": rows["n"], "take": take})

    quota = lengths.join(plan.select("source", "rest"), "source").groupBy("source").applyInPandas(fit, "source string, n long, take long")
    quota = written(quota, "quota")
    fitted = quota.groupBy("source").agg(F.sum(F.col("n") * F.col("take")).alias("fitted"))
    mixed = plan.join(fitted, "source", "left").withColumn("mixed_size", F.col("rounds") * F.col("source_size") + F.coalesce("fitted", F.lit(0)))
    whole = mixed.agg(F.sum("mixed_size")).first()[0] or 0
    report = mixed.select(
        "source", "target_share", "max_repeats", "docs", "source_size", "target_size", "rounds", "mixed_size",
        (F.col("mixed_size") / F.lit(whole) if whole else F.lit(0.0)).alias("share_reached"), "short",
        (F.col("budget") - F.col("mixed_size")).alias("left"),
    )
    return report, _seeded(docs, plan, quota, seed).withColumnRenamed("k", key)


def _seeded(docs: DataFrame, plan: DataFrame, quota: DataFrame, seed: int) -> DataFrame:
    """(k, source, repeats): the quota of each length in seeded order. Buckets of the order are taken whole, and only the
    one that the quota ends in is sorted, so a length that many documents have is no single task."""
    hashed = docs.where("n > 0").withColumn("h", F.xxhash64(F.lit(seed), "k")).withColumn("b", F.pmod(F.shiftright("h", 40), F.lit(_BUCKETS)))
    filled = hashed.groupBy("source", "n", "b").agg(F.count(F.lit(1)).alias("c")).join(quota, ["source", "n"])
    before = F.sum("c").over(Window.partitionBy("source", "n").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
    filled = filled.withColumn("part", F.greatest(F.lit(0), F.least("c", F.col("take") - before))).select("source", "n", "b", "c", "part")
    rows = hashed.join(filled, ["source", "n", "b"]).join(plan.select("source", "rounds"), "source")
    clear = rows.where("part = 0 or part = c").withColumn("extra", (F.col("part") > 0).cast("long"))
    split = rows.where("part > 0 and part < c")
    split = split.withColumn("extra", (F.row_number().over(Window.partitionBy("source", "n", "b").orderBy("h", "k")) <= F.col("part")).cast("long"))
    return clear.unionByName(split).select("k", "source", (F.col("rounds") + F.col("extra")).alias("repeats")).where("repeats > 0")
