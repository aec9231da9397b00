"""Top N items within every group by statistics-guided skipping (problem 5).

The latest rows are clustered by group into files of small row groups, each sorted by group and descending score. A task
takes a file's row groups in descending order of the highest score in their statistics. A row group is passed over when
that score lies strictly below the N-th score that every group in it already has; which groups it holds is in its
statistics, or, where these name several, in the group column alone. What is left of a file are at most N rows a group;
these few are ranked across files. A group of millions of rows spans many files, so no task has it whole.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom.plans.tables import new_path, written

#: Bytes of a row group before encoding: small, so that skipping is fine-grained.
ROW_GROUP_BYTES = 1 << 18
#: Rows of a clustered file, at least and at most, about; between them there are four files for each core.
FILE_ROWS = 50_000, 1_000_000


def latest_scores(df: DataFrame, group: str, item: str, score: str, version: str) -> DataFrame:
    """(g, c, s): score of the latest row of each (group, item), both not null and different; null and NaN scores are left out.

    A null version is the earliest. Of different rows with the same latest version the highest score counts.
    """
    s = F.col(score).cast("double")
    usable = F.when(~F.isnan(s), s)
    rows = df.where(F.col(group).isNotNull() & F.col(item).isNotNull()).select(F.col(group).alias("g"), F.col(item).alias("c"), F.struct(F.col(version).alias("t"), usable.alias("s")).alias("r"))
    last = rows.groupBy("g", "c").agg(F.max("r").alias("r")).select("g", "c", F.col("r.s").alias("s"))
    return last.where(F.col("s").isNotNull() & (F.col("g") != F.col("c")))


def cluster(scores: DataFrame, path: str, row_group_bytes: int = ROW_GROUP_BYTES, file_rows: int | None = None) -> None:
    """Writes (g, c, s) to files that each hold a range of (group, score, item), sorted by group, score descending and item.

    The item is part of the range, so a group of one repeated score is split like any other.
    """
    scores = written(scores, "scores")
    n = scores.count()
    file_rows = file_rows or min(max(n // (4 * scores.sparkSession.sparkContext.defaultParallelism), FILE_ROWS[0]), FILE_ROWS[1])
    files = max(1, -(-n // file_rows))
    ranged = scores.repartitionByRange(files, F.col("g"), F.desc("s"), F.col("c")).sortWithinPartitions("g", F.desc("s"), "c")
    ranged.write.option("parquet.block.size", row_group_bytes).option("parquet.page.size", row_group_bytes // 4).option("compression", "zstd").parquet(path)


def read_top(source: str | bytes, n: int) -> tuple[dict[str, list[tuple[float, str]]], int, int]:
    """Best n (score, item) of each group of a clustered file, given by its path or content; row groups read and passed over."""
    best: dict[str, list[tuple[float, _Last]]] = {}
    read = skipped = 0
    if isinstance(source, bytes):
        opened = pa.BufferReader(source)
    else:
        system, path = fs.FileSystem.from_uri(source)
        opened = system.open_input_file(path)
    with opened as source:
        file = pq.ParquetFile(source)
        meta, names = file.metadata, file.schema_arrow.names
        stats = [(meta.row_group(i).column(names.index("s")).statistics, meta.row_group(i).column(names.index("g")).statistics) for i in range(meta.num_row_groups)]
        top = [s.max if s is not None and s.has_min_max else np.inf for s, _ in stats]
        for i in sorted(range(len(stats)), key=lambda i: (-top[i], i)):
            groups = stats[i][1]
            one = groups is not None and groups.has_min_max and groups.min == groups.max
            held = [groups.min] if one else pc.unique(file.read_row_group(i, ["g"]).column("g")).to_pylist()
            if all(len(known := best.get(g, ())) >= n and top[i] < known[0][0] for g in held):
                skipped += 1
                continue
            read += 1
            rows = file.read_row_group(i, ["g", "c", "s"])
            codes = rows.column("g").combine_chunks().dictionary_encode()
            code = codes.indices.to_numpy()
            # groups stand in runs, best first: only the first n rows of a run can count
            first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            place = np.arange(len(code)) - np.repeat(first, np.diff(np.r_[first, len(code)]))
            kept = pa.array(np.flatnonzero(place < n))
            for g, c, s in zip(*(rows.column(x).take(kept).to_pylist() for x in ("g", "c", "s"))):
                heap = best.setdefault(g, [])
                if len(heap) < n:
                    heapq.heappush(heap, (s, _Last(c)))
                elif heap[0] < (s, _Last(c)):
                    heapq.heapreplace(heap, (s, _Last(c)))
    return {g: [(s, c.value) for s, c in heap] for g, heap in best.items()}, read, skipped


class _Last:
    """Compares items in reverse, so that of equal scores the larger item is the worse; by code points, as Spark does."""

    __slots__ = ("value",)

    def __init__(self, value: str) -> None:
        self.value = value

    def __lt__(self, other: _Last) -> bool:
        return self.value > other.value

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Last) and self.value == other.value


def _each_file(df: DataFrame, path: str, n: int) -> DataFrame:
    """(g, c, s, read, skipped): the best rows of each clustered file, and one row for each file of its row groups read and passed over.

    Files of file systems that Arrow knows are opened on the executors, where only the row groups needed are read. Others come as bytes
    through Spark's own reader and its credentials; there skipping saves decoding.
    """
    spark = df.sparkSession
    files = spark.read.parquet(path).inputFiles()
    if not files:
        return spark.createDataFrame([], "g string, c string, s double, read int, skipped int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column(0).to_pylist():
                found, read, skipped = read_top(source, n)
                rows = [(g, c, s, None, None) for g, heap in found.items() for s, c in heap] + [(None, None, None, read, skipped)]
                types = pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32()
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], ["g", "c", "s", "read", "skipped"])

    if files[0].startswith(("file:", "hdfs:")):
        sources = spark.createDataFrame([(f,) for f in files], "path string").repartition(min(len(files), 4 * spark.sparkContext.defaultParallelism))
    else:
        sources = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("content")
    return sources.mapInArrow(run, "g string, c string, s double, read int, skipped int")


def top_of_files(df: DataFrame, path: str, n: int) -> DataFrame:
    """(g, c, s, rank) from clustered files."""
    best = Window.partitionBy("g").orderBy(F.desc("s"), "c")
    ranked = _each_file(df, path, n).where("read is null").select("g", "c", "s").withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= n)


def row_groups(df: DataFrame, path: str, n: int) -> DataFrame:
    """One row: files of a clustered path, and row groups read and passed over for the best n."""
    return _each_file(df, path, n).where("read is not null").agg(F.count(F.lit(1)).alias("files"), F.sum("read").alias("read"), F.sum("skipped").alias("skipped"))


def top_items(df: DataFrame, group: str, item: str, score: str, version: str, n: int = 10) -> DataFrame:
    """(group, item, score, rank): for each group the n items of the highest latest score, ties by item ascending.

    Groups with fewer usable items give all they have; see ``latest_scores`` for what is usable.
    """
    return top_of_files(df, _clustered(df, group, item, score, version), n).select(F.col("g").alias(group), F.col("c").alias(item), F.col("s").alias(score), "rank")


def skipping(df: DataFrame, group: str, item: str, score: str, version: str, n: int = 10) -> DataFrame:
    """(files, read, skipped): what ``top_items`` reads and passes over of its row groups."""
    return row_groups(df, _clustered(df, group, item, score, version), n)


def _clustered(df: DataFrame, group: str, item: str, score: str, version: str) -> str:
    path = new_path(df.sparkSession, "clustered")
    cluster(latest_scores(df.withColumns({c: F.col(c).cast("string") for c in (group, item)}), group, item, score, version), path)
    return path
