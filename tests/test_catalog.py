"""Every query of the catalog against its SQL, at the smallest scale, if the tables are there."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from caseloom.plans import catalog, catalog_sources, catalog_steps  # noqa: F401

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def engine():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{round(v, 5) + 0.0:g}"
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, DIR).count() > 0


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_its_sql(spark, engine, name):
    df = catalog.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted([plain(v) for v in r] for r in df.select(columns).collect())
    result = engine.execute(catalog.ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted([plain(r[names.index(c)]) for c in columns] for r in result.fetchall())
    assert got == want


def test_adaptive_negatives_of_small_pools_are_kept(spark, engine):
    """Every labelled pair of a query with a candidate left, also where fewer than 15 are drawn from with replacement."""
    got = catalog.QUERIES["adaptive_neg_all"](spark, DIR).collect()
    few = [r for r in got if len(set(r.negative_ids)) < 15]
    pool = "SELECT query_id FROM pred ANTI JOIN qrels USING (query_id, candidate_id) WHERE NOT isnan(dense_score) AND query_id <> candidate_id"
    want = engine.execute(catalog.sql(f"SELECT query_id, candidate_id FROM qrels WHERE query_id IN ({pool})", "pred", "qrels")).fetchall()
    assert few and all(len(r.negative_ids) == 15 for r in got)
    assert sorted((r.query_id, r.positive_id) for r in got) == sorted(want)


def test_every_order_is_a_case(spark, engine):
    got = catalog.QUERIES["task2_flatten_all"](spark, DIR)
    assert got.select("query_id").distinct().count() == engine.execute("SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_returnflag = 'R'").fetchone()[0]
    assert {r.label for r in got.select("label").distinct().collect()} == {0, 1}


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
