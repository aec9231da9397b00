import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caseloom.operators import cutoff, dense, features, lexical, metrics, models, ranking, sampling, scope, statistics
from caseloom.plans import pipelines
from caseloom.plans.tables import current_rows

PAIRS = "query_id string, candidate_id string"


def test_current_rows(spark, rows):
    data = [("1", "old", 1, 0), ("1", "new", 2, 0), ("1", "new", 2, 0), ("2", None, None, 0), ("3", "a", None, 0), ("3", "b", 1, 0), (None, "x", 1, 0)]
    df = spark.createDataFrame(data, "case_id string, text string, loaded_at int, _latest int")
    assert rows(current_rows(df, "case_id", "loaded_at", ["text"])) == [("1", "new"), ("2", None), ("3", "b")]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert current_rows(df, "case_id", "loaded_at", ["text"]).count() == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert current_rows(df.limit(0), "case_id", "loaded_at", ["text"]).count() == 0


def test_ranks(spark, rows):
    df = spark.createDataFrame([("q", "b", 1.0, 0), ("q", "a", 1.0, 1), ("q", "c", 2.0, 2), ("q", "n", None, 3)], PAIRS + ", s double, pos int")
    assert rows(ranking.rank_by_position(df, "s", "pos", k=2), "candidate_id", "rank") == [("b", 2), ("c", 1)]
    assert rows(ranking.rank_by_candidate(df, "s"), "candidate_id", "rank") == [("a", 2), ("b", 3), ("c", 1), ("n", 4)]
    assert rows(ranking.cumulative(df.withColumn("y", F.lit(1)), "y", "pos"), "pos", "cumulative_relevant") == [(0, 1), (1, 2), (2, 3), (3, 4)]
    found, lost = ranking.slice_by_ids(df.withColumnRenamed("candidate_id", "id"), spark.createDataFrame([("b", 0), ("z", 1), ("b", 2)], "id string, pos int"), "id")
    assert rows(found, "id", "pos") == [("b", 0), ("b", 2)] and rows(lost, "id") == [("z",)]
    a, b = (spark.createDataFrame(x, "id string, pos int") for x in ([("x", 0), ("y", 1)], [("y", 0), ("z", 1)]))
    assert rows(ranking.ordered_union(a, b, "id", "pos"), "part", "pos", "id") == [(0, 0, "x"), (0, 1, "y"), (1, 1, "z")]
    numbers = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v"))
    assert [r.pos for r in ranking.positions_of(numbers, [F.col("v")]).orderBy("v").collect()] == list(range(1000))


@pytest.mark.parametrize("slack", [0, 1, -3])
def test_scope(spark, rows, slack):
    q = [("a", 2000), ("b", 0), ("c", 1990), ("d", None)]
    c = [("a", 2000, 0), ("x", 0, 1), ("y", 2001, 2), ("z", 1980, 3)]
    qs, cs = spark.createDataFrame(q, "query_id string, year int"), spark.createDataFrame(c, "candidate_id string, year int, pos int")
    for unknown in ("all", "none"):
        want = sorted((i, k) for i, y in q for k, cy, _ in c if ((unknown == "all") if not y else cy <= y + max(0, slack)))
        assert rows(scope.build_scope(qs, cs, slack, unknown), "query_id", "candidate_id") == want
        assert rows(scope.scope_sizes(qs, cs, slack, unknown)) == sorted((i, sum(p == i for p, _ in want)) for i, _ in q)
    assert ("a", "a") not in rows(scope.build_scope(qs, cs, slack, exclude_self=True), "query_id", "candidate_id")
    with pytest.raises(ValueError):
        scope.build_scope(qs, cs, unknown="some")


def test_scope_policies(spark, rows):
    run = spark.createDataFrame([("q", "a"), ("q", "b"), ("r", "a")], PAIRS)
    held = spark.createDataFrame([("q", "a", 0)], PAIRS + ", pos int")
    assert rows(scope.filter_by_scope(run, held, scope.Missing.EMPTY)) == [("q", "a")]
    assert rows(scope.filter_by_scope(run, held, scope.Missing.KEEP)) == [("q", "a"), ("r", "a")]
    with pytest.raises(ValueError):
        scope.filter_by_scope(run, held, scope.Missing.RAISE)
    every = scope.scope_or_all(run.select("query_id").distinct(), held, spark.createDataFrame([("a", 0), ("b", 1)], "candidate_id string, pos int"))
    assert rows(every, "query_id", "candidate_id") == [("q", "a"), ("r", "a"), ("r", "b")]
    assert rows(scope.missing_queries(run, held)) == [("r",)]


def test_legal_filter_counts_self_after_scope(spark, rows):
    run = spark.createDataFrame([("q", "q", 3.0), ("q", "a", 2.0), ("q", "b", 1.0), ("r", "r", 1.0)], PAIRS + ", rank_score double")
    held = spark.createDataFrame([("q", "a"), ("q", "b")], PAIRS)
    kept, counters = scope.legal_filter(run, held)
    assert rows(kept, "query_id", "candidate_id", "rank_position") == [("q", "a", 1), ("q", "b", 2)]
    assert counters.first().asDict() == {"rows_before": 4, "rows_after": 2, "removed_by_scope": 1, "removed_by_self": 1, "missing_scope_queries": 1, "empty_queries": 1}


def test_micro_metrics(spark):
    labels = spark.createDataFrame([("q", "a"), ("q", "b"), ("r", "c"), ("q", "a")], PAIRS)
    predicted = spark.createDataFrame([("q", "a"), ("q", "a"), ("q", "x"), ("q", "x"), ("s", "c")], PAIRS)
    m = metrics.micro_prf(predicted, labels).first()
    assert (m.tp, m.fp, m.fn) == (1, 3, 2) and math.isclose(m.f1, 2 * 0.25 / 3 / (0.25 + 1 / 3))
    assert metrics.evaluate(predicted, labels).first()["fp"] == 2
    assert metrics.evaluate(predicted, labels, skip_unanswered=True).first()["fn"] == 1
    none = metrics.micro_prf(predicted.limit(0), labels.limit(0)).first()
    assert (none.tp, none.fp, none.fn, none.f1) == (0, 0, 0, 0.0)
    assert metrics.coverage(predicted, labels).first().asDict() == {"expected": 2, "predicted": 2, "missing": 1, "unexpected": 1}
    assert metrics.paragraph_metrics(predicted.withColumn("rank", F.lit(1)), labels, labels).count() == 2


def test_ndcg(spark):
    df = spark.createDataFrame([("q", "c%02d" % i, i, 1 if i in (2, 12) else 0) for i in range(1, 13)] + [("z", "a", 1, 0)], PAIRS + ", rank int, label int")
    got = {r.query_id: r for r in metrics.rank_metrics(df, queries=spark.createDataFrame([("q",), ("z",), ("none",)], "query_id string")).collect()}
    assert math.isclose(got["q"].ndcg_at_10, (1 / math.log2(3)) / (1 + 1 / math.log2(3))) and got["q"].p_at_5 == 0.2 and got["q"].r_at_5 == 0.5
    assert got["z"].ndcg_at_10 == 0 and got["none"].p_at_5 == 0


def test_baseline_and_logits(spark, rows):
    labels = spark.createDataFrame([(f"q{i}", f"d{j}") for i in range(5) for j in range(i, i + 3)] + [("d1", "d2")], PAIRS)
    out = rows(metrics.random_baseline(labels, 4))
    assert len(out) == 24 and len(set(out)) == 24 and all(q != c for q, c in out) and out == rows(metrics.random_baseline(labels.repartition(3), 4))
    m = metrics.logits_metrics(spark.createDataFrame([([2.0, 1.0, 0.0],), ([0.0, 1.0, -1.0],)], "scores array<double>"), (1, 2)).first()
    assert m.acc_at_1 == 0.5 and m.acc_at_2 == 1.0
    assert math.isclose(m.loss, np.mean([-x[0] + math.log(sum(map(math.exp, x))) for x in ([2, 1, 0], [0, 1, -1])]))


def reference_k(setting, scores):
    """Cutoffs in NumPy single precision."""
    s = np.array(scores, np.float32)
    n = len(s)
    if setting.mode == "fixed_topk":
        return min(max(setting.k, 0), n)
    if not n:
        return 0
    low = max(setting.l, 1)
    high = max(setting.h, low)
    if setting.mode == "ratio_cutoff":
        top = float(s[0])
        threshold = np.float32(setting.p * top if top > 0 else top / setting.p if top < 0 else 0.0)
        return min(max(int((s[: min(n, high)] >= threshold).sum()), min(low, n)), high, n)
    if n < 2:
        return min(n, low)
    window = s[: min(max(setting.n, 1), n)]
    base = int(np.argmax(window[:-1] - window[1:])) + 1 if len(window) > 1 else 1
    return min(max(base + max(setting.buffer, 0), low), high, n)


def test_cutoffs_against_numpy(spark):
    rng = random.Random(4)
    grid = cutoff.Grid(k=(0, 1, 5), gap_n=(1, 3, 30), gap_buffer=(0, 5)).settings()
    lists = [[], [0.1, 0.07], [0.0, 0.0], [-1.0, -1.2, -3.0], [5.0]] + [sorted((round(rng.uniform(-2, 5), 1) for _ in range(rng.randint(1, 20))), reverse=True) for _ in range(25)]
    df = spark.createDataFrame([(f"q{i:02}", f"c{j:02}", s, rng.randint(0, 1)) for i, l in enumerate(lists) for j, s in enumerate(l)], PAIRS + ", rank_score double, label int")
    ranked = cutoff.rankings(df, cutoff.depth_of(grid), queries=spark.createDataFrame([(f"q{i:02}",) for i in range(len(lists))], "query_id string"))
    for setting in [*grid[::7], cutoff.Setting("ratio_cutoff", p=0.7, l=1, h=10)]:
        got = [r.k for r in ranked.select("query_id", cutoff.cutoff_k(setting).alias("k")).orderBy("query_id").collect()]
        assert got == [reference_k(setting, s) for s in lists], setting
    evaluated = {(r["mode"], r.params): r for r in cutoff.evaluate_settings(ranked, grid).collect()}
    for setting in grid[::11]:
        r = evaluated[setting.mode, setting.params]
        kept = [reference_k(setting, s) for s in lists]
        assert (r.tp + r.fp, r.query_count, r.max_retained) == (sum(kept), len(lists), max(kept))
    best = cutoff.best_settings(cutoff.evaluate_settings(ranked, grid))
    assert best.count() == 3 and cutoff.best_mode(best).count() == 1
    kept = cutoff.select_rows(df, cutoff.Setting("fixed_topk", k=2))
    assert kept.groupBy("query_id").count().agg(F.max("count")).first()[0] == 2


def test_single_precision_is_visible(spark):
    df = spark.createDataFrame([("q", "a", 0.1), ("q", "b", 0.07)], PAIRS + ", rank_score float").withColumn("label", F.lit(0))
    assert cutoff.rankings(df, 10).select(cutoff.cutoff_k(cutoff.Setting("ratio_cutoff", p=0.7, l=1, h=5))).first()[0] == 2


def test_best_mode_ties_take_the_larger_name(spark):
    df = spark.createDataFrame([(m, "{}", 0.5, 0.5, 0.5, 3.0) for m in ("fixed_topk", "ratio_cutoff", "largest_gap_cutoff")], "mode string, params string, f1 double, recall double, precision double, avg_retained double")
    assert cutoff.best_mode(df).first()["mode"] == "ratio_cutoff"


def test_lexical(spark, rows):
    docs = spark.createDataFrame([("d1", "the cat sat"), ("d2", "the dog"), ("d3", None), ("d4", "cat cat")], "id string, t string")
    index = lexical.build_index(docs, "id", "t")
    assert (index.docs, index.total_tokens) == (4, 7)
    terms = lexical.query_terms(spark.createDataFrame([("q", "Cat, cat THE"), ("e", "")], "query_id string, text string"), "query_id", "text")
    got = {r.candidate_id: r.score for r in lexical.lexical_search(index, terms, lexical.bm25(index, 1.2, 0.75), 10).collect()}
    idf = math.log(1 + (4 - 2 + 0.5) / 2.5)
    assert math.isclose(got["d4"], 2 * idf * 2 / (2 + 1.2 * (0.25 + 0.75 * 2 / 1.75)))
    assert set(got) == {"d1", "d2", "d4"}
    pairs = spark.createDataFrame([("q", "d1"), ("q", "d9")], PAIRS)
    assert [r.s for r in lexical.pair_scores(pairs, lexical.lexical_scores(index, terms, lexical.dirichlet(index, 1000.0)), "s").orderBy("candidate_id").collect()][1] == 0.0
    assert rows(lexical.build_index(docs, "id", "t", 2).terms, "term") == [("cat cat",), ("cat sat",), ("the cat",), ("the dog",)]


@pytest.mark.parametrize("metric", ["dot", "cos"])
def test_dense_paths_agree(spark, rows, metric, monkeypatch):
    rng = np.random.default_rng(5)
    data = [(f"{i:03}", rng.normal(size=8).round(2).tolist()) for i in range(200)] + [("zero", [0.0] * 8)]
    q = spark.createDataFrame(data[:40], "query_id string, embedding array<double>")
    c = spark.createDataFrame([*data, ("null", None), ("short", [1.0])], "candidate_id string, embedding array<double>")
    blocks = rows(dense.top_similar(q, c, 5, metric), "query_id", "candidate_id", "rank")
    pairs = q.select("query_id").crossJoin(c.where("embedding is not null and size(embedding) = 8").select("candidate_id")).where("query_id != candidate_id")
    scored = dense.pair_similarity(pairs, q, c, metric).withColumn("score", F.round("score", 9))
    assert blocks == rows(ranking.rank_by_position(scored, "score", "candidate_id", k=5), "query_id", "candidate_id", "rank")
    monkeypatch.setattr(dense, "BLOCK", 7)
    assert rows(dense.top_similar(q, c, 5, metric), "query_id", "candidate_id", "rank") == blocks
    assert dense.top_similar(q.limit(0), c, 5).count() == 0
    with pytest.raises(ValueError):
        dense.top_similar(q, c, 5, "l2")


def test_chunk_similarity(spark):
    q = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("b", [0.0, 1.0])], "query_id string, embedding array<double>")
    d = spark.createDataFrame([("x", [0.5, 0.1]), ("y", [1.0, 2.0]), ("y", [3.0, 0.0])], "candidate_id string, embedding array<double>")
    out = {(r.query_id, r.candidate_id): tuple(r)[2:] for r in dense.chunk_similarities(spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "x")], PAIRS), q, d).collect()}
    assert out == {("a", "x"): (0.5, 0.5, 0.5), ("b", "y"): (3.0, 1.5, 2.5), ("c", "x"): (0.0, 0.0, 0.0)}


def test_features(spark):
    cases = spark.createDataFrame([("1", "Date: 2001\nCITATION_SUPPRESSED x", None), ("2", "no", "two words")], "case_id string, raw_text string, clean_text string")
    f = {r.case_id: r for r in features.case_features(cases).collect()}
    assert (f["1"].year, f["1"].citation_num, f["1"].clean_text, f["2"].length, f["2"].year) == (2001, 1, "Date: 2001 x", 2, -1)
    pairs = spark.createDataFrame([("1", "2", None, 0.0, 0.0, float("nan")), ("1", "9", 1.0, 0.0, 0.0, 2.0)], PAIRS + ", bm25_score float, qld_score float, bm25_ngram_score float, dense_score float")
    out = {r.candidate_id: r for r in features.feature_frame(pairs, features.case_features(cases)).collect()}
    assert (out["2"].year_diff, out["2"].dense_score, out["2"].bm25_rank, out["2"].dense_rank, out["2"].len_ratio) == (0, 0.0, 2, 2, 1.5)
    assert (out["9"].doc_length, out["9"].doc_year, out["9"].len_ratio) == (0, -1, 3.0)
    assert [r.label for r in features.with_labels(pairs, spark.createDataFrame([("1", "9")], PAIRS)).orderBy("candidate_id").collect()] == [0, 1]


def test_negatives(spark):
    run = spark.createDataFrame([("q", f"c{i:02}", i) for i in range(1, 20)] + [("r", f"c{i:02}", i) for i in range(1, 10)], PAIRS + ", rank int")
    pos = spark.createDataFrame([("q", "c02"), ("q", "c99"), ("r", "c01")], PAIRS)
    first = {r.positive_id: r.negative_ids for r in sampling.hard_negatives(run, pos).collect()}
    assert set(first) == {"c02", "c99"} and first["c02"] == first["c99"] == ["c01"] + [f"c{i:02}" for i in range(3, 17)]
    drawn = {r.positive_id: r.negative_ids for r in sampling.hard_negatives(run, pos, seed=289).collect()}
    assert drawn["c02"] != drawn["c99"] and len(set(drawn["c02"])) == 15 and "c02" not in drawn["c02"]
    some = {(r.query_id, r.positive_id): r.negative_ids for r in sampling.random_negatives(run, pos).collect()}
    assert all(len(v) == 15 for v in some.values()) and len(set(some["q", "c02"])) == 15 and set(some["r", "c01"]) <= {f"c{i:02}" for i in range(2, 10)}
    sims = run.withColumn("score", -F.col("rank") / 5.0).union(spark.createDataFrame([("q", "q", 0, 9.0)], PAIRS + ", rank int, score double"))
    for require in (False, True):
        got = {(r.query_id, r.positive_id): r.negative_ids for r in sampling.adaptive_negatives(sims, pos, require_positive=require).collect()}
        assert ("q", "c99") in got or require
        assert len(set(got["q", "c02"])) == 15 and "q" not in got["q", "c02"] and len(got["r", "c01"]) == 15
    groups = sampling.grouped_sample(pos, run, 4).collect()
    assert len(groups) == 2 and all(len(g.negative_ids) == 3 for g in groups)


def test_gumbel_marginals(spark):
    """First draws follow the softmax."""
    sims = spark.createDataFrame([("q", "a", math.log(6.0)), ("q", "b", math.log(3.0)), ("q", "c", 0.0)], PAIRS + ", score double")
    pos = spark.createDataFrame([("q", f"p{i}") for i in range(3000)], PAIRS)
    first = sampling.adaptive_negatives(sims, pos, n=1).groupBy(F.get("negative_ids", F.lit(0)).alias("x")).count().collect()
    share = {r.x: r["count"] / 3000 for r in first}
    assert abs(share["a"] - 0.6) < 0.04 and abs(share["b"] - 0.3) < 0.04


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 17), min_size=1, max_size=12), st.booleans(), st.integers(1, 6))
def test_packing(spark, sizes, drop, least):
    ids = iter(range(1, 1000))
    docs = [(i, [next(ids) for _ in range(n)]) for i, n in enumerate(sizes)]
    df = spark.createDataFrame([*docs, (99, None)], "pos int, ids array<int>")
    out = sorted(sampling.pack_tokens(df, max_length=8, cls=-1, sep=-2, pad=0, drop_remainder=drop, min_tokens=least).collect(), key=lambda r: r.seq_id)
    flat = [t for _, d in docs for t in d]
    want = [flat[i : i + 6] for i in range(0, len(flat), 6)]
    want = [w for w in want if len(w) == 6 or not drop and len(w) >= least]
    assert [r.input_ids for r in out] == [[-1, *w, -2] + [0] * (6 - len(w)) for w in want]
    assert all(r.attention_mask == [1] * (len(w) + 2) + [0] * (6 - len(w)) and r.special_tokens_mask == [1] + [0] * len(w) + [1] * (7 - len(w)) for r, w in zip(out, want))


def test_checkpoints(spark):
    log = lambda *entries: [{k: str(v) for k, v in e.items()} for e in entries]
    states = [("b", 10, log({"step": 5, "f1": 0.9}, {"step": 10, "f1": 0.5})), ("a", 20, log({"step": 20, "f1": 0.5})), ("c", None, log({"step": 1, "f1": 1})), ("d", 3, log({"step": 3, "loss": 1}))]
    df = spark.createDataFrame(states, "path string, global_step long, log_history array<map<string,string>>")
    assert tuple(sampling.best_checkpoint(df, "f1").first()) == ("a", 20, 0.5)
    assert sampling.best_checkpoint(df, "none").count() == 0
    paths = spark.createDataFrame([("x/checkpoint-9",), ("x/checkpoint-10",), ("x/other",)], "path string")
    assert sampling.latest_numbered(paths).first().number == 10


def test_split(spark, rows):
    q = spark.createDataFrame([(f"q{i}",) for i in range(11)], "query_id string")
    out = rows(sampling.split_queries(q.union(q)))
    assert sum(s == "train" for _, s in out) == 8 and len(out) == 11 and out == rows(sampling.split_queries(q.repartition(5)))


def test_statistics(spark, rows):
    labels = spark.createDataFrame([("a", "x", 0), ("b", "x", 1), ("b", "y", 1), ("c", "z", 2), ("c", "w", 2)], PAIRS + ", pos int")
    s = statistics.label_statistics(labels).first()
    assert (s.queries, s.pairs, s.most_query, s.fewest_query) == (3, 5, "b", "a")
    lengths = spark.createDataFrame([(0,), (512,), (513,), (9999,), (10_001,)], "n int")
    h = {r.bin: r["count"] for r in statistics.histogram(lengths, "n").collect()}
    assert (h[0], h[1], h[19], h[5], len(h)) == (2, 1, 1, 0, 20)
    t = {r.threshold: r.over for r in statistics.token_thresholds(lengths, "n").collect()}
    assert (t[0], t[8192], t[12288]) == (4, 2, 0)
    cases = spark.createDataFrame([("1", "t"), ("2", " "), ("3", "t"), ("5", "t")], "query_id string, text string")
    pars = spark.createDataFrame([("1", "1"), ("1", "2.txt"), ("2", "1"), ("5", "9")], "query_id string, par_id string")
    want = spark.createDataFrame([("001", "2"), ("1", "7"), ("2", "1"), ("3", "1"), ("4", "1"), ("5", "1")], "query_id string, par_id string")
    samples, counts = statistics.flatten_paragraphs(cases, pars, want)
    assert rows(samples) == [("001", "001001", 0), ("001", "001002", 1)]
    assert rows(counts) == [("blank_case", 1), ("missing_case", 1), ("no_paragraphs", 1), ("no_positive_left", 1), ("used", 1)]


def test_models(spark):
    rng = random.Random(6)
    data = [(f"q{i % 20}", f"c{i}", int(i % 7 == 0), rng.gauss(i % 7 == 0, 0.3), rng.random()) for i in range(400)]
    df = spark.createDataFrame(data, PAIRS + ", label int, a double, b double")
    for kind in ("pairwise", "trees"):
        out = models.Ranker(["a", "b"], kind, trees=5).fit(df).predict(df)
        top = out.where("pred_rank <= 2").agg(F.avg("label")).first()[0]
        assert top > 0.7, kind
    texts = spark.createDataFrame([("1", "abc"), ("2", None)], "id string, t string")
    enc = models.encode_texts(texts, "id", "t", lambda: lambda ts: np.array([[len(t), 1.0] for t in ts]))
    assert {r.id: r.embedding for r in enc.collect()} == {"1": [3.0, 1.0], "2": [0.0, 1.0]}
    fused = models.fuse_chunks(enc.withColumn("id", F.lit("x")), "id").first().embedding
    assert math.isclose(sum(v * v for v in fused), 1.0, rel_tol=1e-6)
    scored = models.score_pairs(spark.createDataFrame([("q", "short"), ("q", "a b c d e f g h i j k l")], "q string, p string"), "q", "p", lambda: lambda ps: [len(p) for _, p in ps], short=F.lit("none"))
    assert sorted(r.score for r in scored.collect()) == [4.0, 23.0]


def test_pipelines(spark, tmp_path):
    docs = spark.createDataFrame([("1", "cat dog"), ("2", "cat"), ("3", "dog bird"), ("4", "fish")], "case_id string, text string")
    queries = spark.createDataFrame([("1", "cat dog"), ("4", "")], "query_id string, text string")
    out = pipelines.lexical_retrieval(docs, queries)
    assert [r.candidate_id for r in out.run.orderBy("rank").collect()] == ["2", "3"] and [r.query_id for r in out.missing_queries.collect()] == ["4"]
    assert pipelines.write_submission(out, str(tmp_path / "s"), "tag").first().asDict() == {"lines": 2, "bad": 0}
    text = pipelines.text_retrieval(docs, queries, lambda: lambda ts: np.array([[len(t), 1.0] for t in ts]), k=1)
    assert text.run.count() == 2
    rng = random.Random(8)
    frame = spark.createDataFrame([(f"q{i % 6}", f"c{i}", rng.random(), int(i % 7 == 0)) for i in range(120)], PAIRS + ", rank_score double, label int")
    nothing = spark.createDataFrame([], PAIRS)
    result = pipelines.cutoff_search(frame, frame, nothing)
    assert result.evaluated.count() == 140 and result.selected.count() > 0
    ltr = pipelines.learn_to_rank(frame, frame, frame, ["rank_score"])
    assert ltr["metrics"].first().tp >= 0 and ltr["test"].count() == 120


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_positions_of_wide_rows(spark, adaptive):
    """Positions are exact whatever columns travel along, in many partitions, with and without adaptive plans."""
    df = spark.range(0, 60_000, 1, 8).select(F.md5(F.col("id").cast("string")).alias("h"), F.repeat(F.lit("x"), 60).alias("payload"), "id")
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        out = ranking.positions_of(df, [F.col("h")])
        row = out.agg(F.count("payload").alias("n"), F.countDistinct("pos").alias("d"), F.min("pos").alias("a"), F.max("pos").alias("b")).first()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert (row.n, row.d, row.a, row.b) == (60_000, 60_000, 0, 59_999)


def test_ids_of_several_sources(spark, rows):
    one = lambda *v: spark.createDataFrame([(x,) for x in v], "query_id string")
    assert rows(ranking.sorted_union(one("b", None, "a"), one("c", "a"), "query_id")) == [(0, "a"), (1, "b"), (2, "c")]
    assert rows(ranking.split_selection(one("a", "b"), one("b", "x"))) == [("b",)]
    assert rows(ranking.split_selection(one("a", "b"), one("b").limit(0))) == rows(ranking.split_selection(one("a", "b"), None)) == [("a",), ("b",)]
    held = spark.createDataFrame([("7", "x", 0), ("000008.txt", "y", 0), ("9", "z", 0), ("000009", "w", 0)], "query_id string, candidate_id string, pos int")
    assert rows(scope.scope_of_queries(one("000007", "000008", "000009", "5", None), held)) == [("000007", "x", 0), ("000008", "y", 0), ("000009", "w", 0)]
    existing = spark.createDataFrame([("x",), ("z",)], "candidate_id string")
    assert rows(ranking.candidate_override(held, one("7", "9", "000009"), existing)) == [(0, "x"), (1, "z")]


@pytest.mark.parametrize("metric", ["dot", "cos"])
def test_many_queries_in_blocks(spark, rows, monkeypatch, metric):
    """Blocks of queries against parts of candidates give what one block does, copies and ties included."""
    rng = np.random.default_rng(8)
    v = np.round(rng.normal(size=(90, 4)), 1)
    v[5] = v[6] = v[7]
    df = spark.createDataFrame([(f"{i:02}", x.tolist()) for i, x in enumerate(v)] + [("n", None), ("w", [1.0])], "query_id string, embedding array<double>")
    theirs = df.withColumnRenamed("query_id", "candidate_id")
    one = rows(dense.top_similar(df, theirs, 3, metric))
    monkeypatch.setattr(dense, "BLOCK", 20)
    monkeypatch.setattr(dense, "PART", 25)
    assert rows(dense.top_similar(df, theirs, 3, metric)) == one and len(one) == 270


def test_written_tables_can_be_discarded(spark):
    from caseloom.plans.tables import discard, written, written_paths

    before = len(written_paths())
    table = written(spark.range(3), "x")
    assert table.count() == 3
    discard(spark, before)
    assert len(written_paths()) == before
    with pytest.raises(Exception):
        spark.read.parquet(table.inputFiles()[0]).count()
