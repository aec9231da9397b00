"""BM25 of many long queries by parts, against the same scores by joined postings."""

import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from caseloom.operators import lexical, lexical_kernel
from caseloom.plans import catalog, catalog_steps  # noqa: F401 (it registers its queries)


def texts(n: int, seed: int) -> list[tuple[str, str | None]]:
    rng = random.Random(seed)
    out = [(f"{i:06}", " ".join(f"w{int(rng.paretovariate(0.5))}" for _ in range(rng.randrange(1, 60)))) for i in range(n)]
    return [*out, ("copy-1", out[3][1]), ("copy-0", out[3][1]), ("null", None), ("none", " .;"), ("alone", "zebra Zebra ZEBRA")]


@pytest.mark.parametrize("cells, common, k, k1, b, decimals", [(1 << 24, 0.05, 3, 3.0, 1.0, 6), (64 * 3, 0.05, 10, 1.2, 0.75, 1), (0, 0.05, 10, 1.2, 0.75, 1), (1 << 24, 0.0, 1000, 0.9, 0.4, 6)])
def test_parts_give_what_joins_give(spark, rows, monkeypatch, cells, common, k, k1, b, decimals):
    monkeypatch.setattr(lexical_kernel, "CELLS", cells)
    monkeypatch.setattr(lexical_kernel, "COMMON", common)
    monkeypatch.setattr(lexical_kernel, "BLOCK", 7)
    docs = spark.createDataFrame(texts(500, 1), "id string, t string").repartition(3)
    asked = spark.createDataFrame([*texts(30, 2), *texts(500, 1)[:12], ("strange", "never seen, zebra zebra")], "q string, t string").where("q <> 'copy-0'").dropDuplicates(["q"])
    index = lexical.build_index(docs, "id", "t")
    want = lexical.lexical_search(index, lexical.query_terms(asked, "q", "t"), lexical.bm25(index, k1, b), k, decimals)
    got = lexical.bm25_search(docs, "id", "t", asked, "q", "t", k1, b, k, decimals)
    columns = ("query_id", "candidate_id", "score", "rank")
    assert rows(got, *columns) == rows(want, *columns) and want.count() > 30 * min(k, 10)


def test_nothing_to_search(spark):
    none, some = spark.createDataFrame([], "id string, t string"), spark.createDataFrame([("a", "x y")], "id string, t string")
    other = spark.createDataFrame([("b", "z")], "id string, t string")
    for docs, asked in ((none, some), (some, none), (some, other), (none, none)):
        assert lexical.bm25_search(docs, "id", "t", asked, "id", "t", 3.0, 1.0, 5).collect() == []


def test_words_of_one_hash_stay_apart(spark, monkeypatch):
    """A seed under which words fall together is passed over."""
    plain, tried = F.xxhash64, set()

    def clashing(*columns):
        if len(columns) == 1:
            return plain(*columns)
        tried.add(str(columns[0]))
        return F.when(columns[0] < 2, F.lit(7).cast("long")).otherwise(plain(*columns))

    monkeypatch.setattr(lexical, "F", SimpleNamespace(**{n: getattr(F, n) for n in dir(F)} | {"xxhash64": clashing}))
    docs = spark.createDataFrame([("a", "x x"), ("b", "y")], "id string, t string")
    found = lexical.bm25_search(docs, "id", "t", docs, "id", "t", 3.0, 1.0, 5).collect()
    assert sorted((r.query_id, r.candidate_id) for r in found) == [("a", "a"), ("b", "b")] and len(tried) == 3


def test_long_queries_make_no_row_for_each_pair(spark, tmp_path, monkeypatch):
    """Every case shares a word with each query; the rows that are ranked are some of each part's, not all pairs."""
    rng = random.Random(3)
    cases = [(f"{i:06}", "court " + " ".join(f"w{rng.randrange(40)}" for _ in range(30)), None) for i in range(2_000)]
    spark.createDataFrame(cases, "case_id string, clean_text string, loaded_at timestamp").write.parquet(f"{tmp_path}/case_features.parquet")
    ranked, rank = [], lexical.rank_by_candidate
    monkeypatch.setattr(lexical, "rank_by_candidate", lambda df, *a, **b: ranked.append(df) or rank(df, *a, **b))
    assert catalog.QUERIES["bm25_cases_top10"](spark, str(tmp_path)).count() == 1_000
    parts = 2 * spark.sparkContext.defaultParallelism
    assert ranked[0].count() <= 100 * 10 * parts < 100 * 2_000
