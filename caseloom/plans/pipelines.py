"""Whole runs: retrieval, learning to rank, and the cutoff search, as chains of the operators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.operators import cutoff, dense, lexical, metrics, models, ranking, scope
from caseloom.sources import sinks


@dataclass(frozen=True)
class Retrieval:
    run: DataFrame  # query_id, candidate_id, score, rank
    missing_queries: DataFrame


def lexical_retrieval(docs: DataFrame, queries: DataFrame, scope_: DataFrame | None = None, k: int = 1000, k1: float = 3.0, b: float = 1.0, strict: bool = True) -> Retrieval:
    """docs: case_id, text; queries: query_id, text. BM25, then the scope, then self removal and new ranks."""
    index = lexical.build_index(docs, "case_id", "text")
    found = lexical.lexical_search(index, lexical.query_terms(queries, "query_id", "text"), lexical.bm25(index, k1, b), k)
    lost = queries.select("query_id").distinct().join(found.select("query_id").distinct(), "query_id", "left_anti")
    return Retrieval(_scoped(found, scope_, scope.Missing.RAISE if strict else scope.Missing.EMPTY), lost)


def dense_retrieval(vectors: DataFrame, queries: DataFrame, scope_: DataFrame | None = None, k: int = 5, metric: str = "dot") -> Retrieval:
    """vectors: case_id, embedding; queries: query_id. Query vectors come from the same table; queries without one are reported."""
    mine = queries.select("query_id").distinct().join(vectors.select(F.col("case_id").alias("query_id"), "embedding"), "query_id")
    theirs = vectors.select(F.col("case_id").alias("candidate_id"), "embedding")
    lost = queries.select("query_id").distinct().join(mine.select("query_id"), "query_id", "left_anti")
    if scope_ is None:
        return Retrieval(dense.top_similar(mine, theirs, k, metric), lost)
    scored = dense.pair_similarity(ranking.without_self(scope_), mine, theirs, metric)
    return Retrieval(ranking.rank_by_position(scored, "score", "pos", k=k).select("query_id", "candidate_id", "score", "rank"), lost)


def text_retrieval(docs: DataFrame, queries: DataFrame, make_encoder: Callable[[], models.Encoder], scope_: DataFrame | None = None, k: int = 5, metric: str = "dot") -> Retrieval:
    """Encodes docs (case_id, text), then ranks them for the queries."""
    return dense_retrieval(models.encode_texts(docs, "case_id", "text", make_encoder), queries, scope_, k, metric)


def _scoped(run: DataFrame, scope_: DataFrame | None, missing: scope.Missing) -> DataFrame:
    kept = run if scope_ is None else scope.filter_by_scope(run, scope_, missing)
    return ranking.rank_by_candidate(ranking.without_self(kept.drop("rank")), "score")


def write_submission(result: Retrieval, path: str, tag: str, k: int = 5) -> DataFrame:
    """Writes the first k of each query and returns the check of what was written."""
    sinks.write_submission(result.run.where(F.col("rank") <= k), path, tag)
    return sinks.bad_submission_lines(result.run.sparkSession.read.text(path))


def learn_to_rank(train: DataFrame, valid: DataFrame, test: DataFrame, features: list[str], scope_: DataFrame | None = None, kind: str = "pairwise") -> dict[str, DataFrame]:
    """Fits on train and predicts all splits, after the scope and self filters; metrics of valid at 5."""
    ranker = models.Ranker(features, kind).fit(train)
    out = {}
    for name, frame in (("train", train), ("valid", valid), ("test", test)):
        scored = ranker.predict(frame).drop("rank_score").withColumnRenamed("pred_score", "rank_score")
        kept = ranking.without_self(scored if scope_ is None else scope.filter_by_scope(scored, scope_, scope.Missing.KEEP))
        out[name] = ranking.rank_by_candidate(kept.drop("pred_rank"), "rank_score", "rank_position")
    relevant = valid.where("label > 0").select("query_id", "candidate_id")
    out["metrics"] = metrics.top_k_metrics(out["valid"], relevant, 5, "rank_position")
    return out


@dataclass(frozen=True)
class CutoffResult:
    evaluated: DataFrame
    best: DataFrame
    setting: cutoff.Setting
    selected: DataFrame
    counters: DataFrame


def cutoff_search(valid: DataFrame, test: DataFrame, scope_: DataFrame, grid: cutoff.Grid | None = None) -> CutoffResult:
    """Legal filter, grid search on valid, and the best setting applied to test.

    Frames: query_id, candidate_id, rank_score, label. The best setting, one row, is read by the driver.
    """
    grid = grid or cutoff.Grid()
    settings = grid.settings()
    kept, _ = scope.legal_filter(valid, scope_, remove_self=grid.remove_self)
    ranked = cutoff.rankings(kept, cutoff.depth_of(settings), queries=valid.select("query_id"))
    evaluated = cutoff.evaluate_settings(ranked, settings)
    best = cutoff.best_settings(evaluated)
    row = cutoff.best_mode(best).first()
    setting = next(s for s in settings if (s.mode, s.params) == (row["mode"], row["params"]))
    applied, counters = scope.legal_filter(test, scope_, remove_self=grid.remove_self)
    return CutoffResult(evaluated, best, setting, cutoff.select_rows(applied, setting), counters)
