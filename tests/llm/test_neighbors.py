import numpy as np

from caseloom.llm.neighbors import Forest, most_similar, rounded, unit_vectors


def exact(vectors, k, least=-1.0):
    keys = sorted(vectors)
    x = np.array([vectors[q] for q in keys], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 6)
    return {q: [keys[j] for j in sorted((j for j in range(len(keys)) if j != i and s[i, j] >= least), key=lambda j: (-s[i, j], keys[j]))[:k]] for i, q in enumerate(keys)}


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r.case_id, []).append(r.neighbor)
    return out


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(150, 16))
    data = {f"{i:05}": (centres[i % 150] + rng.normal(size=16) * 0.25).astype(np.float32).tolist() for i in range(3000)}
    df = spark.createDataFrame(list(data.items()), "case_id string, embedding array<float>")
    got, want = found(most_similar(df, "case_id", "embedding", 10, sample=1000)), exact(data, 10)
    recall = np.mean([len(set(got.get(q, ())) & set(w)) / len(w) for q, w in want.items()])
    assert recall >= 0.95


def test_dirty_vectors(spark):
    v = [1.0, 0.0, 0.0]
    data = [("a", v), ("a", v), ("b", [2.0, 0.0, 0.0]), ("c", [0.9, 0.1, 0.0]), ("z", [0.0, 0.0, 0.0]), ("n", None), ("m", [None, 1.0, 0.0]), ("w", [1.0, 2.0]), ("x", [float("nan"), 0.0, 1.0]), (None, v), ("d", [0.0, 0.0, 1.0])]
    df = spark.createDataFrame([(k, e, 1, "y") for k, e in data], "case_id string, embedding array<float>, k int, rep string")
    assert found(most_similar(df, "case_id", "embedding", 2, 0.5)) == {"a": ["b", "c"], "b": ["a", "c"], "c": ["a", "b"]}
    assert most_similar(df.limit(0), "case_id", "embedding").count() == 0
    assert most_similar(df.where("case_id = 'd'"), "case_id", "embedding").count() == 0


def test_copies_rank_by_key(spark):
    """Of more copies than k, the smallest keys are the neighbours, of their own group and of others."""
    data = {f"{i:02}": [1.0, 1.0] for i in range(9)} | {"50": [1.0, 0.9], "60": [-1.0, 0.2]}
    df = spark.createDataFrame(list(data.items()), "case_id string, embedding array<float>")
    assert found(most_similar(df, "case_id", "embedding", 3)) == exact(data, 3)


def test_unit_vectors():
    kept, x = unit_vectors([[3.0, 4.0], None, [0.0, 0.0], [1.0]], 2)
    assert kept.tolist() == [0] and np.allclose(x, [[0.6, 0.8]])


def test_leaves_split_by_their_own_members(spark):
    """A sample of 64 leaves 8 leaves a tree for 4,000 vectors, each then split by a tree of its own."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(200, 16))
    data = {f"{i:05}": (centres[i % 200] + rng.normal(size=16) * 0.25).astype(np.float32).tolist() for i in range(4000)}
    df = spark.createDataFrame(list(data.items()), "case_id string, embedding array<float>")
    got, want = found(most_similar(df, "case_id", "embedding", 5, sample=64, leaf=40, probes=16)), exact(data, 5)
    assert np.mean([len(set(got.get(q, ())) & set(w)) / len(w) for q, w in want.items()]) >= 0.9


def test_queue_pops_the_foremost_leaves():
    """The queue gives the leaves of the highest priority that evaluating every plane gives."""
    x = np.random.default_rng(1).normal(size=(500, 8)).astype(np.float32)
    forest = Forest(x, 3, 4, 2)
    home, away = forest.leaves(x, 9)
    for i, v in enumerate(x):
        priority = {}
        for tree in range(3):
            level = {0: np.inf}
            for _ in range(4):
                margin = {n: float(v @ forest.normals[tree, n] - forest.offsets[tree, n]) for n in level}
                level = {2 * n + 1 + side: min(p, m if side else -m) for n, p in level.items() for side, m in ((0, margin[n]), (1, margin[n]))}
            priority |= {tree * 16 + n - 15: p for n, p in level.items()}
        rest = sorted((p for leaf, p in priority.items() if leaf not in home[i]), reverse=True)
        assert all(priority[leaf] > -1e-5 for leaf in home[i]) and np.allclose(sorted((priority[leaf] for leaf in away[i]), reverse=True), rest[:6], atol=1e-5)


def test_bounds_of_rounded_vectors():
    x = np.random.default_rng(2).normal(size=(200, 32))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    q, step, rest = rounded(x)
    exact_, approx = x.astype(np.float64) @ x.T.astype(np.float64), (q * step[:, None].astype(np.float64)) @ (q * step[:, None].astype(np.float64)).T
    assert (np.abs(exact_ - approx) <= rest[:, None] + rest[None] + 3 * rest[:, None] * rest[None]).all()
