"""Scope pairs by parts of the candidates: right with any years, in equal shares."""

import random

import pytest
from pyspark.sql import functions as F

from caseloom.operators import scope


@pytest.mark.parametrize("unknown", ["all", "none"])
def test_pairs_of_any_years(spark, rows, unknown):
    """Null, zero and negative years, repeated rows and null positions, against the condition itself."""
    rng = random.Random(4)
    year = lambda: rng.choice([None, 0, -3, 1999, 2000, 2001, 2004])
    qs = [(f"{i}", year()) for i in range(20)] + [("3", 2000)]
    cs = [(f"{i}", year(), rng.choice([None, i])) for i in range(60)] + [("7", 1999, 7)]
    got = scope.build_scope(spark.createDataFrame(qs, "query_id string, year int"), spark.createDataFrame(cs, "candidate_id string, year int, pos int"), 1, unknown, exclude_self=True)
    want = [(q, c, p) for q, qy in qs for c, cy, p in cs if q != c and ((unknown == "all") if not qy else (cy or 0) <= qy + 1)]
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert rows(got, "query_id", "candidate_id", "pos") == sorted(want, key=key) and want


def test_shares_are_equal_where_most_have_one_year(spark):
    """Nine tenths of the candidates are of one year; no task has much more than the others."""
    queries = spark.range(50).select(F.col("id").cast("string").alias("query_id"), F.lit(2005).alias("year"))
    candidates = spark.range(8_000).select(F.concat(F.lit("c"), "id").alias("candidate_id"), F.when(F.col("id") % 10 == 0, 1990 + F.col("id") % 7).otherwise(2000).cast("int").alias("year"), F.col("id").alias("pos"))
    sizes = [r.n for r in scope.build_scope(queries, candidates).groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 400_000 and len(sizes) >= 2 * spark.sparkContext.defaultParallelism
    assert max(sizes) < 1.5 * sum(sizes) / len(sizes)
