"""Dense scores: pairs by join, and a stated query set against all rows by blocks of matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from caseloom.functions.vectors import EPS, similarity
from caseloom.plans.tables import ship, written

#: Queries in one block: a block of 64 wide vectors is half a megabyte.
BLOCK = 2_000
#: Candidates of one part, about, where there are several blocks.
PART = 50_000


def pair_similarity(pairs: DataFrame, queries: DataFrame, candidates: DataFrame, metric: str = "dot", name: str = "score", default: float | None = None) -> DataFrame:
    """pairs (query_id, candidate_id, ...) with the similarity of their vectors.

    queries: query_id, embedding; candidates: candidate_id, embedding. Pairs that lack a vector are dropped, or get the
    default if one is given.
    """
    how = "inner" if default is None else "left"
    score = similarity(metric)(F.col("_q"), F.col("_c"))
    out = pairs.join(queries.select("query_id", F.col("embedding").alias("_q")), "query_id", how).join(candidates.select("candidate_id", F.col("embedding").alias("_c")), "candidate_id", how)
    return out.withColumn(name, score if default is None else F.coalesce(score, F.lit(default))).drop("_q", "_c")


def _matrix(rows: list[list[float]], width: int) -> tuple[np.ndarray, np.ndarray]:
    good = np.array([r is not None and len(r) == width for r in rows], bool)
    return np.array([r for r, ok in zip(rows, good) if ok], np.float64).reshape(-1, width), np.flatnonzero(good)


def top_similar(queries: DataFrame, candidates: DataFrame, k: int, metric: str = "dot", exclude_self: bool = True, decimals: int = 9) -> DataFrame:
    """(query_id, candidate_id, score, rank): the k best candidates of each query; ties go to the smaller candidate.

    queries: query_id, embedding; candidates: candidate_id, embedding; null vectors and those of another width than most
    queries' take no part. Up to BLOCK queries are shared with all tasks and meet each partition of the candidates in one
    matrix product. More are dealt to blocks, the candidates to parts, and each block meets each part in a task of its own; nothing
    but one block ever reaches the driver. Either way k rows a query and partition are left to be ranked.
    """
    similarity(metric)
    spark = queries.sparkSession
    ship(spark)
    usable = written(queries.where(F.col("embedding").isNotNull()).select(F.col("query_id").cast("string").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding")), "query-vectors")
    candidates = candidates.where(F.col("embedding").isNotNull()).select(F.col("candidate_id").cast("string").alias("candidate_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    widths = usable.groupBy(F.size("embedding").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).limit(1).collect()
    if not widths:
        return spark.createDataFrame([], "query_id string, candidate_id string, score double, rank int")
    usable, kinds = usable.where(F.size("embedding") == widths[0].w), "query_id string, candidate_id string, score double"
    if (n := usable.count()) <= BLOCK:
        shared = spark.sparkContext.broadcast(_block(usable.collect(), metric))  # BLOCK vectors at most
        out = candidates.mapInArrow(_score_block(lambda: shared.value, k, metric, exclude_self, decimals), kinds)
    else:
        blocks, parts = -(-n // BLOCK), max(1, -(-candidates.count() // PART))
        dealt = lambda df, key, own, all_of: df.select(
            *df.columns, F.pmod(F.xxhash64(key), F.lit(own)).cast("int").alias("_own"), F.explode(F.sequence(F.lit(0), F.lit(all_of - 1))).alias("_other")
        )
        q = dealt(usable, "query_id", blocks, parts).withColumnsRenamed({"_own": "_b", "_other": "_p"})
        c = dealt(candidates, "candidate_id", parts, blocks).withColumnsRenamed({"_own": "_p", "_other": "_b"})
        out = q.groupBy("_b", "_p").cogroup(c.groupBy("_b", "_p")).applyInArrow(_meet(k, metric, exclude_self, decimals), kinds)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "candidate_id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _block(rows: list, metric: str) -> tuple[list[str], np.ndarray]:
    q = np.array([r.embedding for r in rows], np.float64).reshape(len(rows), -1)
    if metric == "cos":
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), EPS)
    return [r.query_id for r in rows], q


def _meet(k: int, metric: str, exclude_self: bool, decimals: int):
    def meet(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        """The best k of one part of the candidates for each query of one block."""
        none = pa.schema([("query_id", pa.string()), ("candidate_id", pa.string()), ("score", pa.float64())])
        if not queries.num_rows or not candidates.num_rows:
            return none.empty_table()
        block = _block([Row(query_id=a, embedding=b) for a, b in zip(queries.column("query_id").to_pylist(), queries.column("embedding").to_pylist())], metric)
        batches = candidates.select(["candidate_id", "embedding"]).to_batches(max_chunksize=4096)
        return pa.Table.from_batches(list(_score_block(lambda: block, k, metric, exclude_self, decimals)(iter(batches))), none)

    return meet


def _score_block(get, k: int, metric: str, exclude_self: bool, decimals: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = get()
        own = {c: i for i, c in enumerate(ids)}
        best: list[list[tuple[float, str]]] = [[] for _ in ids]
        for batch in batches:
            names = batch.column(0).to_pylist()
            c, kept = _matrix(batch.column(1).to_pylist(), q.shape[1])
            if not len(c):
                continue
            if metric == "cos":
                c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), EPS)
            s = np.round(q @ c.T, decimals) + 0.0
            if exclude_self:
                for j, row in enumerate(kept):
                    if (i := own.get(names[row])) is not None:
                        s[i, j] = -np.inf
            least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(ids), -np.inf)
            for i in range(len(ids)):
                for j in np.flatnonzero((s[i] >= least[i]) & (s[i] > -np.inf)):
                    best[i].append((-s[i, j], names[kept[j]]))
                best[i] = sorted(best[i])[:k]
        rows = [(ids[i], c, -s) for i, found in enumerate(best) for s, c in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.string(), pa.float64()))], ["query_id", "candidate_id", "score"])

    return score


def chunk_similarities(pairs: DataFrame, query_chunks: DataFrame, doc_chunks: DataFrame) -> DataFrame:
    """pairs with chunk_sim_max, chunk_sim_mean and chunk_sim_top2_mean over all pairs of their chunks; 0 without chunks.

    query_chunks: query_id, embedding; doc_chunks: candidate_id, embedding. Each side's chunks travel as one array, so a
    pair is one row throughout.
    """
    q = query_chunks.groupBy("query_id").agg(F.collect_list("embedding").alias("_q"))
    d = doc_chunks.groupBy("candidate_id").agg(F.collect_list("embedding").alias("_d"))
    dot = similarity("dot")
    sims = F.flatten(F.transform("_q", lambda a: F.transform("_d", lambda b: dot(a, b))))
    out = pairs.join(q, "query_id", "left").join(d, "candidate_id", "left").withColumn("_s", F.sort_array(F.coalesce(sims, F.array().cast("array<double>")), asc=False))
    total = F.aggregate("_s", F.lit(0.0), lambda s, x: s + x)
    top2 = F.slice("_s", 1, 2)
    full = F.size("_s") > 0
    return out.withColumns(
        {
            "chunk_sim_max": F.when(full, F.get("_s", F.lit(0))).otherwise(0.0),
            "chunk_sim_mean": F.when(full, total / F.size("_s")).otherwise(0.0),
            "chunk_sim_top2_mean": F.when(full, F.aggregate(top2, F.lit(0.0), lambda s, x: s + x) / F.size(top2)).otherwise(0.0),
        }
    ).drop("_q", "_d", "_s")
