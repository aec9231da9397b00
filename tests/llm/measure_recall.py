"""Recall of problem 3 against brute force: python tests/llm/measure_recall.py [DIR] [SAMPLE...]

For each sample (the forest's planes are fitted to it; a small one leaves oversized leaves to trees of their own): recall
of pairs of a cosine of 0.9 or more among the ten nearest, and of the ten nearest of ids divisible by 20.
"""

import sys
import time
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from caseloom.llm.neighbors import SAMPLE, most_similar, unit_vectors  # noqa: E402
from caseloom.llm.queries_vectors import COSINE, NEIGHBORS, p3_neighbors  # noqa: E402


def brute(path):
    rows = {r["case_id"]: r["embedding"] for r in pq.read_table(path).to_pylist() if r["case_id"] is not None}
    keys = sorted(rows)
    kept, x = unit_vectors([rows[k] for k in keys], 64)
    keys = np.array(keys, object)[kept]
    out = {}
    for a in range(0, len(x), 2000):
        near = x[a : a + 2000] @ x.T
        near[np.arange(len(near)), np.arange(a, a + len(near))] = -2
        top = np.argpartition(-near, NEIGHBORS - 1, axis=1)[:, :NEIGHBORS]
        for i, t in enumerate(top):
            out[keys[a + i]] = [(keys[j], near[i, j]) for j in t]
    return out


if __name__ == "__main__":
    folder, *samples = sys.argv[1:] or ["/root/testdata/check_l"]
    spark = SparkSession.builder.master("local[8]").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    want = brute(f"{folder}/case_vectors.parquet")
    close = {(k, n) for k, near in want.items() for n, s in near if s >= COSINE}
    asked = {(k, n) for k, near in want.items() for n, _ in near if int(k) % 20 == 0}
    df = spark.read.parquet(f"{folder}/case_vectors.parquet")
    for sample in map(int, samples or [SAMPLE]):
        t = time.time()
        found = {(r.case_id, r.neighbor) for r in most_similar(df, "case_id", "embedding", NEIGHBORS, COSINE, sample=sample).collect()}
        print(f"sample {sample}: {len(want)} vectors, p3_found recall {len(found & close) / len(close):.4f}, {time.time() - t:.0f} s", flush=True)
    t = time.time()
    found = {(r.case_id, r.neighbor) for r in p3_neighbors(spark, folder).collect()}
    print(f"p3_neighbors recall {len(found & asked) / len(asked):.4f}, {time.time() - t:.0f} s")
