"""Splits, negatives, packing and checkpoints: the data side of training.

Random choices are orders by md5 of a seed and the keys, so they don't depend on partitions and another engine can repeat
them. Weighted choices without replacement add Gumbel noise from the same hash and take the best: the same distribution
as drawing one after the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.operators.ranking import positions_of
from caseloom.plans.tables import written

PAIR = ["query_id", "candidate_id"]


def seeded(seed: int, *keys: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def seeded_number(seed: int, *keys: str) -> Column:
    """A whole number below 2^52."""
    return F.conv(F.substring(seeded(seed, *keys), 1, 13), 16, 10).cast("long")


def uniform(seed: int, *keys: str) -> Column:
    """In (0, 1)."""
    return (seeded_number(seed, *keys) + 0.5) / float(1 << 52)


def split_queries(queries: DataFrame, train_share: float = 0.8, seed: int = 42, key: str = "query_id") -> DataFrame:
    """(key, split): the first floor(n * share) distinct keys in seeded order are "train", the others "valid"."""
    keys = queries.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_h", seeded(seed, key))
    placed = positions_of(keys, [F.col("_h"), F.col(key)], "_at")
    n = int(placed.count() * train_share)
    return placed.select(key, F.when(F.col("_at") < n, "train").otherwise("valid").alias("split"))


def sample_rows(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """n rows in seeded order of their keys."""
    return df.orderBy(seeded(seed, *keys), *keys).limit(n)


def _per_positive(negatives: DataFrame, positives: DataFrame) -> DataFrame:
    """Negatives of each (query, positive)."""
    pos = positives.select("query_id", F.col("candidate_id").alias("positive_id")).distinct()
    return pos.join(negatives, "query_id")


def hard_negatives(run: DataFrame, positives: DataFrame, top: int = 100, n: int = 15, seed: int | None = None) -> DataFrame:
    """(query_id, positive_id, negative_ids): for each positive, n of the query's first ``top`` ranks that aren't positives.

    The first n by rank, or with a seed n in seeded order, drawn anew for each positive. Positives with fewer than n
    negatives are left out. The query itself isn't excluded.
    """
    pos = positives.select(*PAIR).distinct()
    pool = run.where(F.col("rank") <= top).select(*PAIR, "rank").join(pos, PAIR, "left_anti")
    if seed is None:
        listed = pool.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "candidate_id"))).alias("l"))  # at most ``top`` rows
        out = _per_positive(listed, pos).select("query_id", "positive_id", F.transform("l", lambda x: x["candidate_id"]).alias("l"))
    else:
        each = _per_positive(pool, pos).withColumn("_h", seeded(seed, "query_id", "positive_id", "candidate_id"))
        listed = each.groupBy("query_id", "positive_id").agg(F.sort_array(F.collect_list(F.struct("_h", "candidate_id"))).alias("l"))
        out = listed.select("query_id", "positive_id", F.transform("l", lambda x: x["candidate_id"]).alias("l"))
    return out.where(F.size("l") >= n).select("query_id", "positive_id", F.slice("l", 1, n).alias("negative_ids"))


def random_negatives(pool: DataFrame, positives: DataFrame, n: int = 15, seed: int = 42) -> DataFrame:
    """(query_id, positive_id, negative_ids): n of the query's own candidates that aren't positives, in seeded order.

    A smaller pool is drawn from with replacement; queries with an empty one are left out.
    """
    pos = positives.select(*PAIR).distinct()
    open_ = pool.select(*PAIR).distinct().join(pos, PAIR, "left_anti")
    each = _per_positive(open_, pos).withColumn("_h", seeded(seed, "query_id", "positive_id", "candidate_id"))
    order = Window.partitionBy("query_id", "positive_id").orderBy("_h", "candidate_id")
    first = each.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n)
    listed = first.groupBy("query_id", "positive_id").agg(F.sort_array(F.collect_list(F.struct("_r", "candidate_id"))).alias("l"))
    ids = F.transform("l", lambda x: x["candidate_id"])
    drawn = F.transform(
        F.sequence(F.lit(1), F.lit(n)),
        lambda i: F.get("_ids", F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "query_id", "positive_id", i.cast("string"))), 1, 13), 16, 10).cast("long"), F.size("_ids")).cast("int")),
    )
    out = listed.withColumn("_ids", ids)
    return out.select("query_id", "positive_id", F.when(F.size("_ids") >= n, F.col("_ids")).otherwise(drawn).alias("negative_ids"))


def adaptive_negatives(
    similarities: DataFrame, positives: DataFrame, n: int = 15, temperature: float = 1.0, seed: int = 42, epoch: int = 0, require_positive: bool = False, decimals: int = 9
) -> DataFrame:
    """(query_id, positive_id, negative_ids): n candidates drawn with probability softmax(score / temperature).

    similarities: query_id, candidate_id, score. Positives and the query itself are no candidates. Enough candidates are
    drawn without replacement, fewer with; queries without any are left out. ``require_positive`` leaves out positives
    that have no score of their own.
    """
    pos = positives.select(*PAIR).distinct()
    scored = similarities.where(F.col("score").isNotNull()).select(*PAIR, "score")
    open_ = scored.where("query_id != candidate_id").join(pos, PAIR, "left_anti")
    if require_positive:
        pos = pos.join(scored.select(*PAIR), PAIR, "left_semi")
    u = uniform(seed * 1_000_003 + epoch, "query_id", "positive_id", "candidate_id")
    noisy = _per_positive(open_, pos).withColumn("_g", F.round(F.col("score").cast("double") / temperature - F.log(-F.log(u)), decimals))
    group = Window.partitionBy("query_id", "positive_id")
    best = noisy.withColumn("_r", F.row_number().over(group.orderBy(F.desc("_g"), "candidate_id"))).where(F.col("_r") <= n)
    listed = best.groupBy("query_id", "positive_id").agg(F.sort_array(F.collect_list(F.struct("_r", "candidate_id", "score"))).alias("l"))
    enough = listed.where(F.size("l") >= n).select("query_id", "positive_id", F.transform("l", lambda x: x["candidate_id"]).alias("negative_ids"))
    few = listed.where(F.size("l") < n)
    top = F.array_max(F.transform("l", lambda x: x["score"].cast("double")))
    weights = few.withColumn("_w", F.transform("l", lambda x: F.exp((x["score"].cast("double") - top) / temperature)))
    upto = F.transform("_w", lambda _, i: F.aggregate(F.slice("_w", F.lit(1), i + 1), F.lit(0.0), lambda s, w: s + w))
    weights = weights.withColumn("_c", upto).withColumn("_t", F.element_at("_c", -1))
    turn = lambda i: F.concat_ws("|", F.lit(f"{seed}:{epoch}"), "query_id", "positive_id", i.cast("string"))
    draw = lambda i: (F.conv(F.substring(F.md5(turn(i)), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52) * F.col("_t")
    pick = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.get(F.transform("l", lambda x: x["candidate_id"]), F.size(F.filter("_c", lambda c: c < draw(i)))))
    return enough.unionByName(weights.select("query_id", "positive_id", pick.alias("negative_ids")))


def grouped_sample(positives: DataFrame, negatives: DataFrame, size: int = 8, seed: int = 42) -> DataFrame:
    """(query_id, positive_id, negative_ids): one seeded positive and size - 1 negatives of each query; see ``random_negatives``."""
    order = Window.partitionBy("query_id").orderBy(seeded(seed, "query_id", "candidate_id"), "candidate_id")
    one = positives.select(*PAIR).distinct().withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
    pool = negatives.select(*PAIR).distinct().join(positives.select(*PAIR).distinct(), PAIR, "left_anti")
    return random_negatives(pool, one, size - 1, seed)


def pack_tokens(
    docs: DataFrame, ids: str = "ids", position: str = "pos", max_length: int = 512, cls: int = 101, sep: int = 102, pad: int = 0, drop_remainder: bool = True, min_tokens: int = 1
) -> DataFrame:
    """(seq_id, input_ids, attention_mask, special_tokens_mask): all documents' tokens end to end, cut to max_length - 2.

    Global offsets come in two levels (``prefix_sums``), so no task sees all documents, and a document is cut into the
    pieces of the sequences it touches, never into tokens. A last, shorter sequence is dropped, or kept padded if it has
    ``min_tokens``. Null and empty token lists take no room.
    """
    body = max_length - 2
    sized = docs.where(F.size(ids) > 0).select(position, F.col(ids).alias("_ids"), F.size(ids).cast("long").alias("_n"))
    placed = prefix_sums(sized, [F.col(position)], "_n", "_start")
    first, last = F.expr(f"_start div {body}"), F.expr(f"(_start + _n - 1) div {body}")
    cut = placed.withColumn("seq_id", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.lit(0).cast("long"), F.col("seq_id") * body - F.col("_start"))
    end = F.least(F.col("_n"), (F.col("seq_id") + 1) * body - F.col("_start"))
    part = cut.select("seq_id", (F.col("_start") + begin).alias("_at"), F.slice("_ids", (begin + 1).cast("int"), (end - begin).cast("int")).alias("_part"))
    joined = part.groupBy("seq_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_part"))), lambda x: x["_part"])).alias("_body"))
    full = F.size("_body") == body
    kept = joined.where(full if drop_remainder else full | (F.size("_body") >= min_tokens))
    fill = F.lit(body) - F.size("_body")
    arr = lambda value, n: F.array_repeat(F.lit(value), n.cast("int") if isinstance(n, Column) else n)
    return kept.select(
        "seq_id",
        F.concat(F.array(F.lit(cls)), "_body", F.array(F.lit(sep)), arr(pad, fill)).alias("input_ids"),
        F.concat(arr(1, F.size("_body") + 2), arr(0, fill)).alias("attention_mask"),
        F.concat(F.array(F.lit(1)), arr(0, F.size("_body")), F.array(F.lit(1)), arr(1, fill)).alias("special_tokens_mask"),
    )


def prefix_sums(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows before, in a total order: sums inside range partitions plus those of the partitions before."""
    parted = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id())
    # fixed rows: partition numbers must not change between the two uses below
    parted = written(parted, "ordered")
    inside = Window.partitionBy("_part").orderBy("_seq").rowsBetween(Window.unboundedPreceding, 0)
    sums = parted.groupBy("_part").agg(F.sum(value).alias("_sum"))  # one row for each partition
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = parted.withColumn("_in", F.sum(value).over(inside) - F.col(value)).join(F.broadcast(before.select("_part", "_before")), "_part")
    return out.withColumn(name, F.col("_before") + F.col("_in")).drop("_part", "_seq", "_in", "_before")


def packed_length(lengths: DataFrame, n: str = "n_tokens", max_length: int = 512, drop_remainder: bool = True, min_tokens: int = 1) -> DataFrame:
    """One row: estimated sequences and the mean, median, smallest and largest number of tokens of non-empty documents.

    The estimate multiplies the mean by all documents, empty ones too, as the original does; here lengths are all documents'.
    """
    body = max_length - 2
    some = F.when(F.col(n) > 0, F.col(n))
    stats = lengths.agg(
        F.count(F.lit(1)).alias("docs"), F.count(some).alias("sampled"), F.avg(some).alias("avg_tokens"), F.percentile(some, 0.5).alias("median_tokens"),
        F.min(some).cast("long").alias("min_tokens"), F.max(some).cast("long").alias("max_tokens"),
    )
    total = F.col("avg_tokens") * F.col("docs")
    whole = F.floor(total / body)
    more = F.lit(0) if drop_remainder else F.when(total - whole * body >= min_tokens, 1).otherwise(0)
    return stats.withColumn("estimated_tokens", total).withColumn("estimated_sequences", F.greatest(whole + more, F.lit(1)).cast("long"))


def best_checkpoint(states: DataFrame, metric: str, larger_is_better: bool = True) -> DataFrame:
    """The (path, step, value) whose log entry of its own global step has the best metric; ties go to the smallest path.

    states: path, global_step, log_history (array of string maps). The first entry of the step that has the metric counts.
    """
    each = states.where(F.col("global_step").isNotNull()).select("path", "global_step", F.posexplode("log_history").alias("_i", "_e"))
    value = F.get(F.array(F.try_element_at("_e", F.lit(metric))), F.lit(0)).try_cast("double")
    own = each.where(F.try_element_at("_e", F.lit("step")).try_cast("long") == F.col("global_step")).withColumn("_v", value).where("_v is not null")
    first = own.groupBy("path", "global_step").agg(F.min_by("_v", "_i").alias("value"))
    order = F.desc("value") if larger_is_better else F.asc("value")
    return first.orderBy(order, "path").limit(1).select("path", F.col("global_step").alias("step"), "value")


def latest_numbered(paths: DataFrame, pattern: str = r"checkpoint-(\d+)$", path: str = "path") -> DataFrame:
    """The path with the largest number in it; paths without one are left out."""
    number = F.regexp_extract(path, pattern, 1).try_cast("long")
    return paths.withColumn("number", number).where("number is not null").orderBy(F.desc("number"), path).limit(1).select(path, "number")
