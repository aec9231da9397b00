"""Queries of the training-data problems against their SQL, at the smallest scale, if the tables are there."""

import math
import os

import duckdb
import pytest

from caseloom.llm import registry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{round(v, 5) + 0.0:g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_its_sql(spark, name):
    engine = duckdb.connect()
    for f in os.listdir(DIR):
        engine.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    df = registry.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    result = engine.execute(registry.ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted([plain(r[names.index(c)]) for c in columns] for r in result.fetchall())
    assert sorted([plain(v) for v in r] for r in df.select(columns).collect()) == want
