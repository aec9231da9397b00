import random

from pathlib import Path

from caseloom.llm.topn import cluster, latest_scores, read_top, row_groups, top_items, top_of_files

NAN = float("nan")
SCHEMA = "query_id string, candidate_id string, dense_score float, scored_at timestamp, g int, s string"


def frame(spark, rows):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    return spark.createDataFrame([(q, c, s, None if t is None else t0 + timedelta(seconds=t), 1, "x") for q, c, s, t in rows], SCHEMA)


def brute(data, n):
    last = {}
    for q, c, s, t in data:
        if q is not None and c is not None:
            key = (-1 if t is None else t, float("-inf") if s is None or s != s else s)
            last[q, c] = max(last.get((q, c), key), key)
    out = []
    for q in {q for q, _ in last}:
        own = sorted((-s, c) for (p, c), (_, s) in last.items() if p == q and c != q and s != float("-inf"))
        out += [(q, c) for _, c in own[:n]]
    return sorted(out)


def test_dirty_rows(spark, rows):
    data = [("q", "a", 1.0, 1), ("q", "a", 0.5, 2), ("q", "b", 0.5, 1), ("q", "c", None, 1), ("q", "d", NAN, 1), ("q", "q", 9.0, 1), ("q", "e", 2.0, 1), ("q", "e", None, 2)]
    data += [("q", "f", 0.5, None), ("q", "f", 0.7, None), ("r", "a", -1.0, 1), ("r", "a", -1.0, 1), (None, "a", 1.0, 1), ("r", None, 1.0, 1)]
    df = frame(spark, data)
    for n in (1, 2, 10):
        assert rows(top_items(df, "query_id", "candidate_id", "dense_score", "scored_at", n), "query_id", "candidate_id") == brute(data, n)
    assert top_items(df.limit(0), "query_id", "candidate_id", "dense_score", "scored_at").count() == 0


def test_hot_group_over_many_files_with_ties(spark, rows, tmp_path):
    rng = random.Random(2)
    data = [("hot" if rng.random() < 0.5 else f"q{rng.randint(0, 40)}", f"c{rng.randint(0, 5000)}", round(rng.random(), 2), rng.randint(0, 3)) for _ in range(20_000)]
    # of rows with the same pair and time the highest score counts
    df = frame(spark, data)
    path = f"file://{tmp_path}/clustered"
    cluster(latest_scores(df, "query_id", "candidate_id", "dense_score", "scored_at"), path, row_group_bytes=4096, file_rows=3000)
    import numpy as np

    single = [(q, c, float(np.float32(s)), t) for q, c, s, t in data]
    assert rows(top_of_files(df, path, 10), "g", "c") == brute(single, 10)
    files = spark.read.parquet(path).inputFiles()
    read = [read_top(f, 10)[1:] for f in files]
    skipped, opened = sum(s for _, s in read), sum(r for r, _ in read)
    assert len(files) > 3 and skipped > 0.3 * (skipped + opened)  # the hot half of the rows is mostly passed over
    counted = row_groups(df, path, 10).first()
    assert (counted.files, counted.read, counted.skipped) == (len(files), opened, skipped)
    assert read_top(Path(files[0].removeprefix("file://")).read_bytes(), 10) == read_top(files[0], 10)


def test_a_million_equal_scores_in_one_group(spark, rows, tmp_path):
    """One group of one score is split into files of like size, and its first items by name come out."""
    from pyspark.sql import functions as F

    scores = spark.range(1_000_000).select(F.lit("hot").alias("g"), F.format_string("c%07d", "id").alias("c"), F.lit(0.5).alias("s"))
    path = f"file://{tmp_path}/equal"
    cluster(scores, path, file_rows=100_000)
    sizes = [r["count"] for r in spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 250_000
    assert rows(top_of_files(scores, path, 5), "c") == [(f"c{i:07}",) for i in range(5)]
