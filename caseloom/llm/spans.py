"""Long exact spans shared between records (problem 4).

Every fixed-length window of a text has a Rabin-Karp hash. Counting each window would ship eight bytes and more for
each character, so windows are counted by *runs*: all windows with the same owner (the smallest anchor hash in the
window) are counted through the owner. The windows of an owner that one record alone has can't repeat; where the whole
run repeats, one row stands for all its windows; only runs whose owner repeats in other surroundings are counted
window by window. Nothing is sampled: each window has an owner, and the result is exact up to 128-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm import spans_kernel as K
from caseloom.plans.tables import small, spread, written

#: Owners of more characters than this are counted window by window in the JVM, so no task gets them whole.
WIDE = 2_000_000
#: Characters of a group of owners, about; the number of groups follows from those counted.
GROUP_CHARS = 1_000_000


def shared_spans(df: DataFrame, key: str, text: str, length: int = 200, anchor: int | None = None) -> DataFrame:
    """(key, char_start, char_end): maximal runs of characters that lie in ``length`` characters found in another key's text.

    df has one row for each key. Null and empty texts, texts shorter than ``length`` and null keys share nothing. A span
    that repeats only inside its own text isn't shared. Positions count Unicode code points, ends are exclusive.
    ``anchor`` (half of ``length`` unless given) sets the width of the owners' hashes; it changes cost, not results.
    """
    anchor = anchor or max(1, length // 2)
    docs = df.where(F.col(key).isNotNull() & (F.length(text) >= length)).select(F.col(key).alias("k"), F.col(text).alias("t"))
    docs = spread(written(docs, "texts"))
    runs = written(docs.mapInArrow(_emit_runs(length, anchor), "k string, a long, c long, i int, n int"), "runs")
    doc = F.xxhash64("k")
    owners = (
        runs.groupBy("a")
        .agg(F.min(doc).alias("d1"), F.max(doc).alias("d2"), F.min("c").alias("c1"), F.max("c").alias("c2"))
        .where("d1 != d2")
        .select("a", (F.col("c1") == F.col("c2")).alias("whole"))
    )
    alive = written(runs.join(owners, "a"), "alive")
    contexts = alive.where("not whole").groupBy("a", "c").agg(F.min(doc).alias("d1"), F.max(doc).alias("d2"))
    full = alive.where("whole").select("k", "i", "n")
    # of a run that repeats as a whole two records are enough for the others to be compared with
    needed = (doc == F.col("d1")) | (doc == F.col("d2"))
    mixed = alive.where("not whole").join(contexts, ["a", "c"])
    mixed = written(mixed.select("k", "a", "i", "n", (F.col("d1") != F.col("d2")).alias("known"), needed.alias("needed")), "mixed")
    repeated, pieces = mixed.where("known").select("k", "i", "n"), mixed.where("needed").select("k", "a", "i", "n", "known")
    sizes = written(pieces.groupBy("a").agg(F.sum(F.col("n").cast("long") + (length - 1)).alias("chars")), "sizes")
    wide = sizes.where(F.col("chars") > WIDE).select("a")
    chars, n_wide = sizes.agg(F.coalesce(F.sum("chars"), F.lit(0)), F.count_if(F.col("chars") > WIDE)).first()
    wanted = pieces.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("i", "n", "a", "known"))).alias("p"))
    cut = docs.join(wanted, "k").mapInArrow(_cut(length), "k string, a long, i int, n int, known boolean, s string")
    if n_wide:
        cut = written(cut, "pieces")
        by_window = cut.join(small(wide, n_wide, 8), "a", "left_semi").mapInArrow(_explode(length), "k string, w long, v long, i int")
        twice = by_window.groupBy("w", "v").agg(F.min(doc).alias("d1"), F.max(doc).alias("d2")).where("d1 != d2").select("w", "v")
        more = by_window.join(twice, ["w", "v"]).select("k", "i", F.lit(1).alias("n"))
        cut = cut.join(small(wide, n_wide, 8), "a", "left_anti")
    groups = max(16, -(-chars // GROUP_CHARS))
    found = cut.groupBy(F.pmod(F.col("a"), F.lit(groups)).alias("b")).applyInArrow(_count(length), "k string, i int, n int")
    intervals = full.unionByName(repeated).unionByName(found)
    if n_wide:
        intervals = intervals.unionByName(more)
    return merged(intervals.select("k", F.col("i").alias("s"), (F.col("i") + F.col("n") - 1 + length).alias("e")), key)


def merged(intervals: DataFrame, key: str) -> DataFrame:
    """Maximal intervals (char_start, char_end) of (k, s, e); those that overlap or touch are one."""
    w = Window.partitionBy("k").orderBy("s", "e")
    before = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(before >= F.col("s"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (
        intervals.distinct()
        .withColumn("g", island)
        .groupBy("k", "g")
        .agg(F.min("s").cast("int").alias("char_start"), F.max("e").cast("int").alias("char_end"))
        .select(F.col("k").alias(key), "char_start", "char_end")
    )


def shared_shares(df: DataFrame, key: str, text: str, length: int = 200) -> DataFrame:
    """(key, n_chars, shared_chars, shared_share) of every row: how much of each text stands in other texts; 0 for null and empty ones."""
    spans = shared_spans(df, key, text, length).groupBy(key).agg(F.sum(F.col("char_end") - F.col("char_start")).alias("shared_chars"))
    n = F.coalesce(F.length(text), F.lit(0))
    shared = F.coalesce(F.col("shared_chars"), F.lit(0)).cast("long")
    return df.select(key, n.alias("n_chars")).join(spans, key, "left").select(
        key, "n_chars", shared.alias("shared_chars"), F.when(F.col("n_chars") > 0, F.round(shared / F.col("n_chars"), 6)).otherwise(0.0).alias("shared_share")
    )


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _emit_runs(length: int, anchor: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, parts = batch.column(0), []
            for row, text in enumerate(batch.column(1).to_pylist()):
                if (r := K.runs(text, length, anchor)) is not None:
                    parts.append((np.full(len(r[0]), row), *r))
            if parts:
                row, a, c, i, n = (np.concatenate(x) for x in zip(*parts))
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(row)), _signed(a), _signed(c), pa.array(i.astype(np.int32)), pa.array(n.astype(np.int32))], ["k", "a", "c", "i", "n"]
                )

    return emit


def _cut(length: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for k, text, wanted in zip(*(batch.column(x).to_pylist() for x in ("k", "t", "p"))):
                out += [(k, p["a"], p["i"], p["n"], p["known"], text[p["i"] : p["i"] + p["n"] - 1 + length]) for p in wanted]
            if out:
                types = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], ["k", "a", "i", "n", "known", "s"])

    return cut


def _windows(text: str, length: int) -> tuple[np.ndarray, np.ndarray]:
    return K.Rolling(text).all(length), K.Rolling(text, 1).all(length)


def _explode(length: int):
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, i, s in zip(*(batch.column(x).to_pylist() for x in ("k", "i", "s"))):
                w, v = _windows(s, length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * len(w), pa.string()), _signed(w), _signed(v), pa.array(np.arange(i, i + len(w), dtype=np.int32))], ["k", "w", "v", "i"]
                )

    return explode


def _count(length: int):
    def count(rows: pa.Table) -> pa.Table:
        """Runs of windows that stand in two records at least, for all pieces of some owners."""
        keys = rows.column("k").combine_chunks().dictionary_encode()
        doc = keys.indices.to_numpy()
        hashes, owner, start = [], [], rows.column("i").to_numpy()
        for row, s in enumerate(rows.column("s").to_pylist()):
            w, v = _windows(s, length)
            hashes.append(w ^ K.mix(v))
            owner.append(np.full(len(w), row))
        w, row = np.concatenate(hashes), np.concatenate(owner)
        at = np.concatenate([np.arange(len(x)) for x in hashes]) + start[row]
        order = np.lexsort((doc[row], w))
        ws, ds = w[order], doc[row][order]
        first = np.flatnonzero(np.r_[True, ws[1:] != ws[:-1]])
        last = np.r_[first[1:], len(ws)] - 1
        several = np.repeat(ds[first] != ds[last], last - first + 1)
        hit = np.sort(order[several])
        hit = hit[~rows.column("known").to_numpy()[row[hit]]]  # pieces known to repeat as a whole have their intervals
        row, at = row[hit], at[hit]
        head = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)]) if len(hit) else np.zeros(0, int)
        n = np.diff(np.r_[head, len(hit)])
        return pa.table({"k": keys.dictionary.take(pa.array(doc[row[head]])), "i": pa.array(at[head].astype(np.int32)), "n": pa.array(n.astype(np.int32))})

    return count
