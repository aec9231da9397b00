import random
from collections import defaultdict

import numpy as np
import pytest

from caseloom.llm import spans
from caseloom.llm.spans import shared_shares, shared_spans
from caseloom.llm.spans_kernel import merge, sliding_argmin


def brute(texts, length):
    seen = defaultdict(set)
    for k, t in texts.items():
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]].add(k)
    out = []
    for k, t in texts.items():
        run = None
        for i in range(len(t) - length + 1):
            if len(seen[t[i : i + length]]) > 1:
                if run and i <= run[1]:
                    run[1] = i + length
                else:
                    out.append(run := [i, i + length, k])
    return sorted((k, a, b) for a, b, k in out)


def corpus(seed, n=30, alphabet="abc "):
    rng = random.Random(seed)
    pool = ["".join(rng.choice(alphabet) for _ in range(rng.randint(20, 90))) for _ in range(12)]
    return {f"{i:03}": "".join(rng.choice([*pool, "".join(rng.choice(alphabet + "é漢") for _ in range(rng.randint(1, 60)))]) for _ in range(rng.randint(0, 6))) for i in range(n)}


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, rows, seed):
    texts = corpus(seed)
    df = spark.createDataFrame(list(texts.items()), "case_id string, raw_text string")
    assert rows(shared_spans(df, "case_id", "raw_text", 40)) == brute(texts, 40)


def test_wide_owners_give_the_same(spark, rows, monkeypatch):
    texts = corpus(7)
    monkeypatch.setattr(spans, "WIDE", 1)
    monkeypatch.setattr(spans, "GROUP_CHARS", 100)
    df = spark.createDataFrame(list(texts.items()), "case_id string, raw_text string")
    assert rows(shared_spans(df, "case_id", "raw_text", 40)) == brute(texts, 40)


@pytest.mark.parametrize("wide", [300, 10_000_000])
def test_one_owner_in_most_records(spark, rows, monkeypatch, wide):
    """A sentence that most records hold, each in other surroundings: one owner holds most of the pieces."""
    monkeypatch.setattr(spans, "WIDE", wide)
    monkeypatch.setattr(spans, "GROUP_CHARS", 2_000)
    rng = random.Random(3)
    shared = "the same sentence stands in most of the records"
    texts = {f"{i:03}": "".join(rng.choice("abcdef ") for _ in range(rng.randint(0, 60))) + (shared if i % 5 else "") + "".join(rng.choice("abcdef ") for _ in range(rng.randint(0, 60))) for i in range(150)}
    df = spark.createDataFrame(list(texts.items()), "case_id string, raw_text string")
    assert rows(shared_spans(df, "case_id", "raw_text", 40)) == brute(texts, 40)


def test_monotonous_texts_and_copies(spark, rows):
    texts = {"a": "x" * 500, "b": "x" * 90, "c": "ab" * 100, "d": "ab" * 100, "e": "own " * 3, "f": "tick" * 40 + "unique"}
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in texts.items()] + [("g", None, 1, 2), ("h", "", 1, 2), (None, "x" * 500, 1, 2)], "case_id string, raw_text string, k int, a int")
    assert rows(shared_spans(df, "case_id", "raw_text", 40)) == brute(texts, 40)
    shares = {r.case_id: r for r in shared_shares(df.where("case_id is not null"), "case_id", "raw_text", 40).collect()}
    assert shares["b"].shared_share == 1.0 and shares["f"].shared_chars == 0 and shares["g"].n_chars == 0 and shares["h"].shared_share == 0.0
    assert shared_spans(df.limit(0), "case_id", "raw_text", 40).count() == 0


def test_a_repeat_inside_one_text_is_not_shared(spark):
    df = spark.createDataFrame([("a", "abcdefghij" * 30), ("b", "klmnopqrst" * 30)], "case_id string, raw_text string")
    assert shared_spans(df, "case_id", "raw_text", 40).count() == 0


def test_kernels():
    rng = np.random.default_rng(1)
    for high in (3, 1 << 60):
        x = rng.integers(0, high, 500).astype(np.uint64)
        for w in (1, 2, 37, 500):
            assert sliding_argmin(x, w).tolist() == [i + int(np.argmin(x[i : i + w])) for i in range(len(x) - w + 1)]
    assert [v.tolist() for v in merge(np.array([5, 0, 3, 20]), np.array([9, 3, 4, 30]))] == [[0, 5, 20], [4, 9, 30]]
