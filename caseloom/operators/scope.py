"""The scope relation query -> candidates by year, and the policies for queries without one."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom.operators.ranking import rank_by_candidate

#: Candidates of one part, at most about.
PART = 16_000


class Missing(Enum):
    """What becomes of a query that has no scope."""

    EMPTY = "empty"  # it keeps nothing
    ALL = "all"  # every candidate is in scope, also where the scope is there but empty
    KEEP = "keep"  # its rows stay
    RAISE = "raise"  # it is an error


def build_scope(queries: DataFrame, candidates: DataFrame, slack: int = 1, unknown: str = "all", exclude_self: bool = False) -> DataFrame:
    """(query_id, candidate_id, pos) with candidate.year <= query.year + max(0, slack).

    queries: query_id, year; candidates: candidate_id, year, pos. A query of year 0 (or null) has all candidates, or none;
    a candidate of year 0 is in every scope. Candidates are dealt to parts, as one list for each year and part, and each query meets
    the lists of each part: years are compared once a list, and parts have equal shares of the pairs, whatever years are common.
    """
    if unknown not in ("all", "none"):
        raise ValueError("unknown must be 'all' or 'none'")
    parts = max(4 * queries.sparkSession.sparkContext.defaultParallelism, -(-candidates.count() // PART))
    of_all = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part")
    q = queries.select("query_id", F.coalesce("year", F.lit(0)).alias("_qy"), of_all).repartitionById(parts, "_part")
    c = candidates.select(F.struct("candidate_id", "pos").alias("_c"), F.coalesce("year", F.lit(0)).alias("_cy"), F.pmod(F.xxhash64("candidate_id"), F.lit(parts)).cast("int").alias("_part"))
    lists = c.groupBy("_part", "_cy").agg(F.collect_list("_c").alias("_c")).select("_part", "_cy", F.col("_c.candidate_id").alias("_candidate_id"), F.col("_c.pos").alias("_pos"))
    visible = F.when(F.col("_qy") == 0, F.lit(unknown == "all")).otherwise(F.col("_cy") <= F.col("_qy") + max(0, slack))
    met = q.join(lists.repartitionById(parts, "_part"), "_part").where(visible)
    pairs = met.select("query_id", "_pos", F.posexplode("_candidate_id").alias("_at", "candidate_id")).select("query_id", "candidate_id", F.get("_pos", F.col("_at")).alias("pos"))
    return pairs.where(F.col("query_id") != F.col("candidate_id")) if exclude_self else pairs


def scope_sizes(queries: DataFrame, candidates: DataFrame, slack: int = 1, unknown: str = "all") -> DataFrame:
    """(query_id, candidates): sizes of scopes from counts by year; no pair is made. Self counts."""
    counts = candidates.groupBy(F.coalesce("year", F.lit(0)).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    running = counts.withColumn("upto", F.sum("n").over(Window.orderBy("y").rowsBetween(Window.unboundedPreceding, 0)))  # one row for each year
    steps = running.groupBy().agg(F.sort_array(F.collect_list(F.struct("y", "upto"))).alias("steps"), F.sum("n").alias("total"))
    q = queries.select("query_id", F.coalesce("year", F.lit(0)).alias("qy")).join(F.broadcast(steps))
    within = F.filter("steps", lambda s: s["y"] <= F.col("qy") + max(0, slack))
    known = F.coalesce(F.element_at(F.transform(within, lambda s: s["upto"]), -1), F.lit(0))
    none = F.col("total") if unknown == "all" else F.lit(0)
    return q.select("query_id", F.coalesce(F.when(F.col("qy") == 0, none).otherwise(known), F.lit(0)).cast("long").alias("candidates"))


def scope_stats(sizes: DataFrame, queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: queries, candidates, avg_candidates, unknown_query_years, unknown_candidate_years."""
    unknown = lambda c: F.count_if(F.coalesce(c, F.lit(0)) == 0)
    a = sizes.agg(F.count(F.lit(1)).alias("queries"), F.avg("candidates").alias("avg_candidates"))
    b = queries.agg(unknown(F.col("year")).alias("unknown_query_years"))
    c = candidates.agg(F.count(F.lit(1)).alias("candidates"), unknown(F.col("year")).alias("unknown_candidate_years"))
    return a.join(b).join(c)


def in_scope_by_year(pairs: DataFrame, slack: int = 1, unknown: str = "all") -> DataFrame:
    """Rows of (query_year, doc_year) pairs that a scope by year would hold, without making the scope."""
    qy, cy = F.coalesce("query_year", F.lit(0)), F.coalesce("doc_year", F.lit(0))
    return pairs.where(F.when(qy == 0, F.lit(unknown == "all")).otherwise(cy <= qy + max(0, slack)))


def filter_by_scope(run: DataFrame, scope: DataFrame, missing: Missing) -> DataFrame:
    """Rows of a run whose (query_id, candidate_id) the scope holds; ``missing`` rules queries without any row there."""
    held = scope.select("query_id", "candidate_id").distinct()
    if missing in (Missing.EMPTY, Missing.RAISE):
        if missing is Missing.RAISE and (lost := run.select("query_id").distinct().join(held, "query_id", "left_anti").limit(5).collect()):
            raise ValueError(f"no scope for queries {[r.query_id for r in lost]}")
        return run.join(held, ["query_id", "candidate_id"], "left_semi")
    scoped = held.select("query_id").distinct().withColumn("_scoped", F.lit(True))
    flagged = run.join(held.withColumn("_held", F.lit(True)), ["query_id", "candidate_id"], "left").join(scoped, "query_id", "left")
    return flagged.where(F.col("_scoped").isNull() | F.col("_held").isNotNull()).drop("_scoped", "_held")


def scope_of_queries(queries: DataFrame, scope: DataFrame) -> DataFrame:
    """(query_id, candidate_id, pos) of the given queries: the rows under their own id, else under the id with ``.txt``, else under the
    id without leading zeros. The first of these keys that the scope has at all counts."""
    q = F.col("query_id")
    forms = F.array(q, F.concat(q, F.lit(".txt")), F.ltrim(q, F.lit("0")))
    tried = queries.select("query_id").where(q.isNotNull()).distinct().select("query_id", F.posexplode(forms).alias("_n", "_key"))
    keys = scope.select(F.col("query_id").alias("_key")).distinct()
    best = tried.join(keys, "_key").groupBy("query_id").agg(F.min_by("_key", "_n").alias("_key"))
    return best.join(scope.select(F.col("query_id").alias("_key"), "candidate_id", "pos"), "_key").select("query_id", "candidate_id", "pos")


def missing_queries(run: DataFrame, scope: DataFrame) -> DataFrame:
    return run.select("query_id").distinct().join(scope.select("query_id").distinct(), "query_id", "left_anti")


def scope_or_all(queries: DataFrame, scope: DataFrame, candidates: DataFrame) -> DataFrame:
    """The scope, plus every candidate for queries that have none (policy ALL).

    Its size is that of the scope plus lost queries x candidates, for consumers that need the relation itself; ``filter_by_scope``
    with KEEP gives the same rows of a run without making it.
    """
    lost = queries.select("query_id").join(scope.select("query_id").distinct(), "query_id", "left_anti")
    every = lost.join(candidates.select("candidate_id", "pos"), F.lit(True))
    return scope.select("query_id", "candidate_id", "pos").unionByName(every)


def legal_filter(predictions: DataFrame, scope: DataFrame, score: str = "rank_score", remove_self: bool = True) -> tuple[DataFrame, DataFrame]:
    """Scope filter (policy KEEP), self removal, new ranks; and one row of counters.

    Counters: rows_before, rows_after, removed_by_scope, removed_by_self (of what the scope left), missing_scope_queries,
    empty_queries (that lost every row).
    """
    held = scope.select("query_id", "candidate_id").distinct().withColumn("_held", F.lit(True))
    scoped = scope.select("query_id").distinct().withColumn("_scoped", F.lit(True))
    flags = predictions.join(held, ["query_id", "candidate_id"], "left").join(scoped, "query_id", "left")
    out = F.col("_scoped").isNotNull() & F.col("_held").isNull()
    own = ~out & (F.col("query_id") == F.col("candidate_id")) & F.lit(remove_self)
    flags = flags.withColumns({"_out": out, "_own": own})
    by_query = flags.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_out").alias("out"), F.count_if("_own").alias("own"), F.first("_scoped").alias("scoped")
    )
    counters = by_query.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum(F.col("n") - F.col("out") - F.col("own")), F.lit(0)).alias("rows_after"),
        F.coalesce(F.sum("out"), F.lit(0)).alias("removed_by_scope"),
        F.coalesce(F.sum("own"), F.lit(0)).alias("removed_by_self"),
        F.count_if(F.col("scoped").isNull()).alias("missing_scope_queries"),
        F.count_if(F.col("n") == F.col("out") + F.col("own")).alias("empty_queries"),
    )
    kept = flags.where(~F.col("_out") & ~F.col("_own")).drop("_held", "_scoped", "_out", "_own")
    return rank_by_candidate(kept, score, "rank_position"), counters
