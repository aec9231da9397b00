import itertools

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from caseloom.llm.mixing import fit_budget, mix_sources


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 6), min_size=1, max_size=5), st.integers(0, 200), st.sampled_from([1000, 40]))
def test_fit(counts, budget, limit):
    lengths, have = np.array(list(counts)), np.array(list(counts.values()))
    taken = fit_budget(lengths, have, budget, limit)
    assert (taken <= have).all() and (taken >= 0).all() and (taken * lengths).sum() <= budget
    if limit == 1000:
        # what proportion leaves over is solved exactly
        part, total = max(0, budget - limit // 8), int((lengths * have).sum())
        base = [c * part // total for c in have] if budget < total else have
        best = max(int(np.dot(t, lengths)) for t in itertools.product(*(range(b, h + 1) for b, h in zip(base, have))) if np.dot(t, lengths) <= budget)
        assert int((taken * lengths).sum()) == best


def test_mix(spark):
    docs = [(i, s, n, "x") for i, (s, n) in enumerate([("A", 10)] * 50 + [(" a ", 7)] * 20 + [("b", 5)] * 4 + [(None, 100), ("other", 60), ("a", None), ("b", 0)])]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, n bigint, k string")
    weights = spark.createDataFrame([("a", 0.5, 1), ("B ", 0.3, 3), ("c", 0.1, 2), ("d", 0.0, 1), ("e", None, None)], "source string, target_share double, max_repeats int")
    report, mix = mix_sources(df, "doc_id", "source", "n", weights)
    r = {x.source: x for x in report.collect()}
    total = 50 * 10 + 20 * 7 + 20 + 160
    assert r["a"].mixed_size == total // 2 and not r["a"].short and r["a"].left == 0 == r["b"].left
    assert (r["b"].mixed_size, r["b"].rounds, r["b"].short) == (60, 3, True)
    assert r["c"].short and r["c"].mixed_size == 0 and not r["d"].short and not r["e"].short
    assert abs(sum(x.share_reached for x in r.values()) - 1) < 1e-9
    rows = mix.collect()
    sizes = {i: n for i, _, n, _ in docs}
    assert sum(sizes[x.doc_id] * x.repeats for x in rows if x.source == "a") == r["a"].mixed_size
    assert max(x.repeats for x in rows if x.source == "a") == 1 and {x.repeats for x in rows if x.source == "b"} == {3} and {x.source for x in rows} == {"a", "b"}
    again = mix_sources(df.repartition(3), "doc_id", "source", "n", weights)[1].collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
    other = mix_sources(df, "doc_id", "source", "n", weights, seed=8)[1].collect()
    assert sorted(map(tuple, other)) != sorted(map(tuple, rows))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, source string, n bigint")
    weights = spark.createDataFrame([("a", 0.5, 1)], "source string, target_share double, max_repeats int")
    report, mix = mix_sources(df, "doc_id", "source", "n", weights)
    assert [(x.source, x.mixed_size, x.share_reached, x.short) for x in report.collect()] == [("a", 0, 0.0, False)] and mix.count() == 0
    report, mix = mix_sources(df, "doc_id", "source", "n", weights.limit(0))
    assert report.count() == 0 and mix.count() == 0
