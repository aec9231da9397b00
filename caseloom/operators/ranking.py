"""Ranks, limits and filters of runs (query_id, candidate_id, score).

Two tie rules exist. Dense rankings keep the earlier position of equal scores (a stable sort); feature and prediction
ranks order equal scores by candidate id. Each function names its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.plans.tables import written


def rank_by_position(df: DataFrame, score: str, position: str, query: str = "query_id", k: int | None = None) -> DataFrame:
    """Adds rank from 1, score descending and earlier position first; only ranks up to k if given."""
    order = Window.partitionBy(query).orderBy(F.desc(score), position)
    ranked = df.withColumn("rank", F.row_number().over(order))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def rank_by_candidate(df: DataFrame, score: str, name: str = "rank", query: str = "query_id", candidate: str = "candidate_id", k: int | None = None) -> DataFrame:
    """Adds a rank from 1 by single-precision score descending, then candidate ascending; null scores come last."""
    order = Window.partitionBy(query).orderBy(F.col(score).cast("float").desc_nulls_last(), candidate)
    ranked = df.withColumn(name, F.row_number().over(order))
    return ranked if k is None else ranked.where(F.col(name) <= k)


def top_in_run_order(df: DataFrame, k: int, line: str = "line_no", query: str = "query_id") -> DataFrame:
    """The first k lines of each query as they stand in the file, whatever their rank column says."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(query).orderBy(line))).where(F.col("_n") <= k).drop("_n")


def cumulative(df: DataFrame, label: str, rank: str, name: str = "cumulative_relevant", query: str = "query_id") -> DataFrame:
    """Running sum of labels in rank order."""
    frame = Window.partitionBy(query).orderBy(rank).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.sum(label).over(frame).cast("long"))


def without_self(df: DataFrame, query: str = "query_id", candidate: str = "candidate_id") -> DataFrame:
    return df.where(F.col(query) != F.col(candidate))


def of_queries(df: DataFrame, queries: DataFrame, query: str = "query_id") -> DataFrame:
    return df.join(queries.select(query).distinct(), query, "left_semi")


def ordered_distinct(df: DataFrame, key: str, position: str) -> DataFrame:
    """First occurrence of each key, with its position; empty and null keys are dropped."""
    return df.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.min(position).alias(position))


def ordered_union(first: DataFrame, second: DataFrame, key: str, position: str) -> DataFrame:
    """Keys of first in their order, then those only second has."""
    both = first.select(key, F.struct(F.lit(0).alias("part"), F.col(position).cast("long").alias("at")).alias("_p")).unionByName(
        second.select(key, F.struct(F.lit(1).alias("part"), F.col(position).cast("long").alias("at")).alias("_p"))
    )
    return both.groupBy(key).agg(F.min("_p").alias("_p")).select(key, F.col("_p.part").alias("part"), F.col("_p.at").alias(position))


def sorted_union(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """(pos, key): the distinct keys of both, numbered in order of the keys; null keys are dropped."""
    both = first.select(key).union(second.select(key)).where(F.col(key).isNotNull()).distinct()
    return positions_of(both, [F.col(key)]).select("pos", key)


def candidate_override(scope: DataFrame, chosen: DataFrame, existing: DataFrame) -> DataFrame:
    """(pos, candidate_id): the candidates that the chosen queries (query_id) have in scope and that exist (candidate_id), in order."""
    wanted = scope.join(chosen.select("query_id").distinct(), "query_id", "left_semi").select("candidate_id").distinct()
    return sorted_union(wanted.join(existing.select("candidate_id").distinct(), "candidate_id", "left_semi"), wanted.limit(0), "candidate_id")


def split_selection(files: DataFrame, listed: DataFrame | None, key: str = "query_id") -> DataFrame:
    """Ids of ``files`` that a split lists; all of them where the split has no list (None) or an empty one."""
    if listed is None or listed.isEmpty():
        return files.select(key).distinct()
    return files.select(key).distinct().join(listed.select(key).distinct(), key, "left_semi")


def slice_by_ids(table: DataFrame, ids: DataFrame, key: str, position: str = "pos") -> tuple[DataFrame, DataFrame]:
    """Rows of the wanted ids with their position in ids (repeated ids give repeated rows), and the ids that are missing."""
    wanted = ids.select(key, position)
    found = wanted.join(table.drop(position) if position in table.columns else table, key)
    return found, wanted.join(table.select(key).distinct(), key, "left_anti")


def positions_of(df: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """Adds 0-based positions in a total order without gathering the rows in one task.

    Rows are range-partitioned by the order, numbered inside their partitions, and shifted by the sizes of those before.
    The numbered rows are written once, since ranges planned twice need not have the same bounds.
    """
    parted = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = written(parted.withColumn("_po_id", F.monotonically_increasing_id()).withColumn("_po_part", F.shiftright("_po_id", 33)), "numbered")
    sizes = numbered.groupBy("_po_part").agg(F.count(F.lit(1)).alias("_po_n"))  # one row for each partition
    earlier = Window.orderBy("_po_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_po_part", F.coalesce(F.sum("_po_n").over(earlier), F.lit(0)).alias("_po_before"))
    placed = numbered.join(F.broadcast(before), "_po_part")
    return placed.withColumn(name, F.col("_po_before") + F.col("_po_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_po_id", "_po_part", "_po_n", "_po_before")
