"""How many candidates of each query to keep: fixed, ratio and largest-gap cutoffs, and the search for their parameters.

Every setting needs the first ranks of a query only (its largest h, N or k), so a query becomes one row of short arrays of
scores and running relevance, and the grid is evaluated over these arrays; rankings are never multiplied by settings.
Scores compare in single precision, as they are stored.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.operators.metrics import ideal_dcg, prf, ratio


@dataclass(frozen=True)
class Setting:
    """Parameters of one cutoff; those a mode doesn't have are 0."""

    mode: str
    k: int = 0
    p: float = 0.0
    l: int = 0  # noqa: E741
    h: int = 0
    n: int = 0
    buffer: int = 0

    @property
    def params(self) -> str:
        names = {"fixed_topk": ("k",), "ratio_cutoff": ("h", "l", "p"), "largest_gap_cutoff": ("N", "buffer", "h", "l")}[self.mode]
        values = {"k": self.k, "p": self.p, "l": self.l, "h": self.h, "N": self.n, "buffer": self.buffer}
        return "{" + ", ".join(f'"{name}": {values[name]}' for name in names) + "}"


@dataclass(frozen=True)
class Grid:
    """Values to search. The defaults make 5 + 54 + 81 settings."""

    k: tuple[int, ...] = (1, 3, 5, 7, 10)
    ratio_p: tuple[float, ...] = (0.7, 0.75, 0.8, 0.85, 0.9, 0.95)
    ratio_l: tuple[int, ...] = (1, 2, 3)
    ratio_h: tuple[int, ...] = (5, 7, 10)
    gap_n: tuple[int, ...] = (10, 20, 30)
    gap_buffer: tuple[int, ...] = (0, 1, 2)
    gap_l: tuple[int, ...] = (1, 2, 3)
    gap_h: tuple[int, ...] = (5, 7, 10)
    remove_self: bool = True
    write_submission: bool = True
    submission_run_tag: str = "cutoff"
    extra: dict = field(default_factory=dict)

    def settings(self) -> list[Setting]:
        out = [Setting("fixed_topk", k=k) for k in sorted(set(self.k)) if k > 0]
        out += [Setting("ratio_cutoff", p=p, l=a, h=b) for p, a, b in product(*map(_unique, (self.ratio_p, self.ratio_l, self.ratio_h))) if 0 < a <= b]
        gaps = product(*map(_unique, (self.gap_n, self.gap_buffer, self.gap_l, self.gap_h)))
        return out + [Setting("largest_gap_cutoff", n=n, buffer=b, l=a, h=h) for n, b, a, h in gaps if n > 0 and 0 < a <= h]


def _unique(values: tuple) -> list:
    return sorted(set(values))


def rankings(predictions: DataFrame, depth: int, score: str = "rank_score", label: str = "label", queries: DataFrame | None = None) -> DataFrame:
    """One row for each query: query_id, n, total (relevant), scores and hits (running relevance) of the first ``depth`` ranks.

    Ranks go by score, then candidate. Null labels are 0. Queries without rows have n = 0.
    """
    order = Window.partitionBy("query_id").orderBy(F.col(score).cast("float").desc_nulls_last(), "candidate_id")
    relevant = F.coalesce(F.col(label).cast("long"), F.lit(0))
    # counts come from a plain aggregate; only the first ranks, limited before the shuffle, are sorted, so a hot query costs no more
    counts = predictions.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.sum(relevant).alias("total"))
    ranked = predictions.select("query_id", F.col(score).cast("float").alias("s"), relevant.alias("y"), F.row_number().over(order).alias("r")).where(F.col("r") <= depth)
    listed = ranked.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("r", "s", "y"))).alias("f"))
    nothing = F.array().cast("array<struct<r:int,s:float,y:bigint>>")
    out = counts.join(listed, "query_id", "left").withColumn("f", F.coalesce("f", nothing))
    gains = F.transform("f", lambda x: x["y"])
    hits = F.transform(gains, lambda y, i: F.aggregate(F.slice(gains, F.lit(1), i + 1), F.lit(0).cast("long"), lambda s, v: s + v))
    out = out.select("query_id", "n", "total", F.transform("f", lambda x: x["s"]).alias("scores"), gains.alias("gains"), hits.alias("hits"))
    if queries is None:
        return out
    empty = {"n": F.lit(0).cast("long"), "total": F.lit(0).cast("long"), "scores": F.array().cast("array<float>"), "gains": F.array().cast("array<bigint>"), "hits": F.array().cast("array<bigint>")}
    joined = queries.select("query_id").distinct().join(out, "query_id", "left")
    return joined.withColumns({c: F.coalesce(c, v) for c, v in empty.items()})


def fixed_k(n: Column, k: Column) -> Column:
    return F.greatest(F.lit(0), F.least(k, n)).cast("int")


def ratio_k(scores: Column, n: Column, p: Column, low: Column, high: Column) -> Column:
    """Ranks whose score reaches p times the top one (the top one over p if it is negative), at least l, at most h.

    The threshold is a double rounded to single precision before it is compared. Empty rankings keep 0.
    """
    low = F.greatest(low, F.lit(1))
    high = F.greatest(high, low)
    window = F.slice(scores, F.lit(1), F.least(n, high).cast("int"))
    top = F.get(scores, F.lit(0)).cast("double")
    threshold = F.when(top > 0, p * top).when(top < 0, top / p).otherwise(0.0).cast("float")
    count = F.size(F.filter(window, lambda s: s >= threshold))
    return F.when(n > 0, F.least(F.greatest(count, F.least(low, n)), high, n)).otherwise(0).cast("int")


def gap_k(scores: Column, n: Column, size: Column, buffer: Column, low: Column, high: Column) -> Column:
    """Ranks before the first largest gap between neighbours among the first N, plus a buffer, within l, h and n."""
    low = F.greatest(low, F.lit(1))
    high = F.greatest(high, low)
    window = F.slice(scores, F.lit(1), F.least(n, F.greatest(size, F.lit(1))).cast("int"))
    pairs = F.zip_with(F.slice(window, F.lit(1), F.greatest(F.size(window) - 1, F.lit(0))), F.slice(window, F.lit(2), F.greatest(F.size(window) - 1, F.lit(0))), lambda a, b: a - b)
    at = F.array_position(pairs, F.array_max(pairs))
    base = F.coalesce(F.when(at > 0, at), F.lit(1))  # a window of one score has no gap
    clamped = F.least(F.greatest(base + F.greatest(buffer, F.lit(0)), low), high, n)
    return F.when(n < 2, F.least(n, low)).otherwise(clamped).cast("int")


def cutoff_k(setting: Setting | None = None) -> Column:
    """k of a rankings row under a setting, or under the one in the row's own columns mode, k, p, l, h, gap_n and buffer."""
    if setting is None:
        ratio_, gap = ratio_k(F.col("scores"), F.col("n"), F.col("p"), F.col("l"), F.col("h")), gap_k(F.col("scores"), F.col("n"), F.col("gap_n"), F.col("buffer"), F.col("l"), F.col("h"))
        return F.when(F.col("mode") == "fixed_topk", fixed_k(F.col("n"), F.col("k"))).when(F.col("mode") == "ratio_cutoff", ratio_).otherwise(gap)
    scores, n = F.col("scores"), F.col("n")
    if setting.mode == "fixed_topk":
        return fixed_k(n, F.lit(setting.k))
    if setting.mode == "ratio_cutoff":
        return ratio_k(scores, n, F.lit(setting.p), F.lit(setting.l), F.lit(setting.h))
    return gap_k(scores, n, F.lit(setting.n), F.lit(setting.buffer), F.lit(setting.l), F.lit(setting.h))


def depth_of(settings: list[Setting]) -> int:
    """Ranks that any setting looks at; 10 for nDCG."""
    return max([10, *(max(s.k, s.h, s.n) for s in settings)])


def query_scores(k: Column) -> dict[str, Column]:
    """Sums of one query cut at k, from a rankings row: tp, fp, fn and its P@5, R@5, nDCG@10."""
    at = lambda m: F.coalesce(F.get("hits", F.least(k, F.lit(m), F.col("n")).cast("int") - 1), F.lit(0))
    tp = F.coalesce(F.get("hits", k - 1), F.lit(0))
    shown = F.slice("gains", F.lit(1), F.least(k, F.lit(10)))
    dcg = F.aggregate(F.transform(shown, lambda y, i: y / F.log2(i + 2.0)), F.lit(0.0), lambda s, x: s + x)
    return {
        "tp": tp, "fp": k - tp, "fn": F.col("total") - tp, "p5": at(5) / 5.0, "r5": ratio(at(5), F.col("total")),
        "ndcg": ratio(dcg, ideal_dcg(F.col("total"))), "kept": k,
    }


def evaluate_settings(ranked: DataFrame, settings: list[Setting]) -> DataFrame:
    """Metrics of every setting over all queries of ``ranked`` in one pass: mode, params and its parameters, tp, fp, fn,
    precision, recall, f1, p_at_5, r_at_5, ndcg_at_10, avg_retained, median_retained, min_retained, max_retained, query_count.

    ``total`` counts the relevant rows of the ranking, so positives removed before it are no misses here.
    """
    fields = "array<struct<id int, mode string, params string, k int, p double, l int, h int, gap_n int, buffer int>>"
    names = ("id", "mode", "params", "k", "p", "l", "h", "gap_n", "buffer")
    listed = json.dumps([dict(zip(names, (i, s.mode, s.params, s.k, s.p, s.l, s.h, s.n, s.buffer))) for i, s in enumerate(settings)])
    # one expression for all settings: a literal grid meets each query's short arrays
    grid = ranked.withColumn("_g", F.explode(F.from_json(F.lit(listed), fields))).select("query_id", "n", "total", "scores", "gains", "hits", "_g.*")
    at_k = grid.withColumn("kept", cutoff_k())
    keys = [c for c in names if c != "id"]
    each = at_k.select(*keys, *[c.cast("double").alias(f"_{name}") for name, c in query_scores(F.col("kept")).items()])
    summed = each.groupBy(*keys).agg(
        F.sum("_tp").cast("long").alias("tp"), F.sum("_fp").cast("long").alias("fp"), F.sum("_fn").cast("long").alias("fn"),
        F.avg("_p5").alias("p_at_5"), F.avg("_r5").alias("r_at_5"), F.avg("_ndcg").alias("ndcg_at_10"), F.avg("_kept").alias("avg_retained"),
        F.percentile("_kept", 0.5).alias("median_retained"), F.min("_kept").cast("long").alias("min_retained"), F.max("_kept").cast("long").alias("max_retained"), F.count(F.lit(1)).alias("query_count"),
    )
    return summed.withColumns(prf(F.col("tp"), F.col("fp"), F.col("fn")))


def best_settings(evaluated: DataFrame) -> DataFrame:
    """The best setting of each mode: f1, recall, precision, then the smaller parameters of the mode (fixed k; ratio h, l, p; gap h, buffer, N, l)."""
    tie = [F.when(F.col("mode") == "fixed_topk", F.col("k")).otherwise(F.col("h"))]
    tie += [F.when(F.col("mode") == "ratio_cutoff", F.col("l")).otherwise(F.col("buffer"))]
    tie += [F.when(F.col("mode") == "ratio_cutoff", F.col("p")).otherwise(F.col("gap_n").cast("double")), F.col("l")]
    order = Window.partitionBy("mode").orderBy(F.desc("f1"), F.desc("recall"), F.desc("precision"), *tie, "avg_retained", F.desc("params"))
    return evaluated.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def best_mode(best: DataFrame) -> DataFrame:
    """The best of the modes' best: f1, recall, precision, fewer retained; then the larger mode name and params."""
    order = [F.desc("f1"), F.desc("recall"), F.desc("precision"), "avg_retained", F.desc("mode"), F.desc("params")]
    return best.orderBy(*order).limit(1)


def select_rows(predictions: DataFrame, setting: Setting, score: str = "rank_score", label: str = "label") -> DataFrame:
    """Rows kept under a setting, with cutoff_k and selected_rank."""
    order = Window.partitionBy("query_id").orderBy(F.col(score).cast("float").desc_nulls_last(), "candidate_id")
    depth = depth_of([setting])  # no setting keeps more
    ks = rankings(predictions, depth, score, label).select("query_id", cutoff_k(setting).alias("cutoff_k"))
    ranked = predictions.withColumn("selected_rank", F.row_number().over(order)).where(F.col("selected_rank") <= depth).join(ks, "query_id")
    return ranked.where(F.col("selected_rank") <= F.col("cutoff_k"))


def query_stats(ranked: DataFrame, setting: Setting) -> DataFrame:
    """(query_id, num_candidates, retained_count, retained_ratio, num_relevant, true_positive) under a setting."""
    k = cutoff_k(setting)
    return ranked.select(
        "query_id", F.col("n").alias("num_candidates"), k.alias("retained_count"), ratio(k.cast("double"), F.col("n")).alias("retained_ratio"),
        F.col("total").alias("num_relevant"), F.coalesce(F.get("hits", k - 1), F.lit(0)).alias("true_positive"),
    )
