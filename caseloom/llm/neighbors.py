"""Most similar vectors for every vector (problem 3): a forest of random-projection trees.

Trees are complete binary trees; a node splits at the median along the direction between two centres of its part of a
bounded sample, so parts stay even however dense a region is. Every vector is in one leaf of each tree. A query descends
to its own leaf in all trees; the branches it leaves aside go into one queue for all trees, by the least signed margin on
the way to them, and the foremost is popped and descended until PROBES leaves are found. The queues of a batch of queries
advance together, so a step is one gather and one product for the nodes that are visited, and no other plane is evaluated.

Vectors travel to leaves as bytes with a bound on what rounding changes. A leaf that holds more than twice LEAF, as the sample can't tell leaves
of millions of vectors apart, gets a tree of its own members, and queries descend that one too: the work for a
query follows the depth and not the number of vectors. Each leaf keeps what can still be among a query's k best by these
bounds, and these few are ranked by the exact cosine in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.plans.tables import small, spread, written

TREES, PROBES, LEAF = 6, 10, 256
#: Leaves of an oversized leaf's own tree that a query takes.
INNER = 4
#: Vectors to which the forest's planes are fitted, at most; all vectors are indexed.
SAMPLE = 40_000
#: Copies of vectors that a task compares, about.
TASK_ROWS = 60_000


def unit_vectors(rows: list[list[float] | None], width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the usable rows (of the width, finite, not all zero) and their unit vectors."""
    kept = [i for i, r in enumerate(rows) if r is not None and len(r) == (width or len(r)) and None not in r]
    if not kept:
        return np.zeros(0, int), np.zeros((0, width or 0), np.float32)
    x = np.array([rows[i] for i in kept], np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        norm = np.sqrt((x * x).sum(axis=1))
    good = np.isfinite(norm) & (norm > 0)
    return np.array(kept)[good], (x[good] / norm[good, None]).astype(np.float32)


class Forest:
    """``normals`` (trees, nodes, width) and ``offsets`` (trees, nodes), nodes in heap order."""

    def __init__(self, x: np.ndarray, trees: int, depth: int, seed: int) -> None:
        self.depth = depth
        nodes, width = (1 << depth) - 1, x.shape[1]
        self.normals, self.offsets = np.zeros((trees, nodes, width), np.float32), np.zeros((trees, nodes), np.float32)
        for tree in range(trees):
            rng = np.random.default_rng((seed, tree))
            parts = [np.arange(len(x))]
            for node in range(nodes):
                own = parts[node]
                normal = self._direction(x[own], rng)
                along = x[own] @ normal
                middle = float(np.median(along)) if len(own) else 0.0
                self.normals[tree, node], self.offsets[tree, node] = normal, middle
                order = np.argsort(along, kind="stable")
                parts += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]
                parts[node] = own[:0]

    @staticmethod
    def _direction(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """From one of two centres to the other; a random direction where the part has no two different vectors."""
        width = x.shape[1]
        if len(x) > 1:
            part = x[rng.choice(len(x), min(len(x), 200), replace=False)]
            a, b = part[rng.choice(len(part), 2, replace=False)]
            for _ in range(3):
                nearer = part @ (a - b) > (a @ a - b @ b) / 2
                if nearer.all() or not nearer.any():
                    break
                a, b = part[nearer].mean(axis=0), part[~nearer].mean(axis=0)
            if (norm := np.linalg.norm(b - a)) > 1e-6:
                return ((b - a) / norm).astype(np.float32)
        direction = rng.normal(size=width)
        return (direction / np.linalg.norm(direction)).astype(np.float32)

    def leaves(self, x: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """For each vector: the numbers (tree * leaves + leaf) of its own leaves, and of the other leaves it probes, -1 for none."""
        trees, n, rows = len(self.normals), 1 << self.depth, np.arange(len(x))
        more = min(max(0, probes - trees), trees * (n - 1))
        queue = _Queues(len(x), (trees + more) * self.depth)
        home = np.empty((len(x), trees), np.int64)
        for tree in range(trees):
            home[:, tree] = self._descend(x, rows, np.full(len(x), tree), np.zeros(len(x), np.int64), np.full(len(x), np.inf, np.float32), queue)
        away = np.full((len(x), more), -1, np.int64)
        for i in range(more):
            row, tree, node, bound = queue.pop()
            away[row, i] = self._descend(x, row, tree, node, bound, queue)
        return home, away

    def _descend(self, x: np.ndarray, row: np.ndarray, tree: np.ndarray, node: np.ndarray, bound: np.ndarray, queue: _Queues) -> np.ndarray:
        """Leaves below the nodes, on the nearer side of each plane; the other sides are queued."""
        inner, leaf = (1 << self.depth) - 1, np.empty(len(row), np.int64)
        at = np.arange(len(row))
        while True:
            done = node >= inner
            if done.any():
                leaf[at[done]] = tree[done] * (inner + 1) + node[done] - inner
                row, tree, node, bound, at = (v[~done] for v in (row, tree, node, bound, at))
            if not len(row):
                return leaf
            margin = np.einsum("ij,ij->i", x[row], self.normals[tree, node]) - self.offsets[tree, node]
            right = margin > 0
            queue.push(row, tree, 2 * node + 2 - right, np.minimum(bound, -np.abs(margin)))
            node = 2 * node + 1 + right


class _Queues:
    """A priority queue of (tree, node) for each of some queries, each of them shared by all trees."""

    def __init__(self, queries: int, room: int) -> None:
        self.key = np.full((queries, max(1, room)), -np.inf, np.float32)
        self.tree, self.node = np.zeros(self.key.shape, np.int32), np.zeros(self.key.shape, np.int32)
        self.size = np.zeros(queries, np.int64)

    def push(self, row: np.ndarray, tree: np.ndarray, node: np.ndarray, key: np.ndarray) -> None:
        """One entry for each of some different queries."""
        at = self.size[row]
        self.key[row, at], self.tree[row, at], self.node[row, at] = key, tree, node
        self.size[row] += 1

    def pop(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Queries whose queue isn't empty, and the tree, node and priority of each one's foremost entry."""
        at = self.key.argmax(axis=1)
        row = np.flatnonzero(self.key[np.arange(len(at)), at] > -np.inf)
        at = at[row]
        found = row, self.tree[row, at].astype(np.int64), self.node[row, at].astype(np.int64), self.key[row, at]
        self.key[row, at] = -np.inf
        return found


def rounded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors as bytes, the step of each, and the length of what rounding took away."""
    step = np.maximum(np.abs(x).max(axis=1), 1e-12) / 127
    q = np.rint(x / step[:, None]).astype(np.int8)
    rest = x.astype(np.float64) - q * step[:, None].astype(np.float64)
    return q, step.astype(np.float32), (np.sqrt((rest * rest).sum(axis=1)) * (1 + 1e-6) + 1e-6).astype(np.float32)


def most_similar(
    df: DataFrame, key: str, vector: str, k: int = 10, least: float = -1.0, trees: int = TREES, probes: int = PROBES, leaf: int = LEAF, sample: int = SAMPLE, seed: int = 11,
    only: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """(key, neighbor, similarity, rank): for each key up to k other keys of the highest cosine that is at least ``least``.

    Null vectors, those with a null, NaN or infinite element, all-zero ones, those of another width than most, and null
    keys take no part. Of several rows of a key the one with the smallest hash counts (equal rows are one). Ties go to the
    smaller key. Equal vectors are searched for once: of a group of copies the k + 1 smallest keys stand for all.
    ``only`` says by key which rows are queries (all are without it); every row is indexed and found in either case.
    ``sample`` bounds the vectors that planes are fitted to; what these leave together is split by its own members.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(vector).cast("array<float>").alias("v"))

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1).to_pylist()
            for w in {len(v) for v in lists}:
                of = [i for i, v in enumerate(lists) if len(v) == w]
                kept, x = unit_vectors([lists[i] for i in of], w)
                at = pa.array(np.array(of, np.int64)[kept])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([w] * len(x), pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], ["k", "w", "x"])

    # only keys of several rows are shuffled: of their usable vectors the one of the smallest hash is kept
    many = written(rows.groupBy("k").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("k"), "many-rows")
    side = small(many, many.count(), 40)
    fine = F.forall("v", lambda e: e.isNotNull() & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0)
    chosen = rows.join(side, "k", "left_semi").where(fine).groupBy("k").agg(F.min_by("v", F.xxhash64("v")).alias("v"))
    one_each = rows.join(side, "k", "left_anti").unionByName(chosen)
    units = written(spread(one_each).mapInArrow(unit, "k string, w int, x binary").withColumn("id", F.monotonically_increasing_id()), "units")
    widths = units.groupBy("w").count().orderBy(F.desc("count"), F.desc("w")).limit(1).collect()
    width = widths[0].w if widths else 0
    units = units.where(F.col("w") == width)
    # copies: the k + 1 smallest keys of each class of equal vectors
    keyed = units.withColumn("c", F.md5("x"))
    classes = keyed.groupBy("c").agg(F.min("k").alias("rep"), F.count(F.lit(1)).alias("m"))
    several = written(classes.where("m > 1").select("c", "rep"), "copies")
    members = written(keyed.join(several, "c").select("rep", "k"), "members")
    singles = units.join(members.where("rep != k").select("k"), "k", "left_anti")
    searched = F.lit(True) if only is None else F.coalesce(only(F.col("k")), F.lit(False)) | F.col("_rep").isNotNull()
    singles = singles.join(members.select(F.col("rep").alias("_rep")).distinct(), F.col("k") == F.col("_rep"), "left").select("id", "k", "x", searched.alias("q"))
    n = singles.count()
    fit = singles.orderBy(F.xxhash64(F.lit(seed), "k"), "k").limit(sample).select("x").collect() if n else []
    if n > 1:
        x = np.frombuffer(b"".join(r.x for r in fit), np.float32).reshape(len(fit), width)
        depth = max(0, min(math.ceil(math.log2(max(1.0, n / leaf))), int(math.log2(max(1.0, len(fit) / 8)))))
        # at most trees * sample / 8 planes, whatever the number of vectors
        forest = df.sparkSession.sparkContext.broadcast(Forest(x, trees, depth, seed))
        tasks = max(16, math.ceil(n * (trees if only else probes) / TASK_ROWS))
        routed = spread(singles.select("id", "x", "q")).mapInArrow(_route(forest, width, probes, tasks), "task int, rows binary")
        # from the leaves of each task a query has what may be among the k best there; of these, what may be among the k best of all stays
        near = routed.groupBy("task").applyInArrow(_compare(width, k, least, leaf, seed, tasks), "bucket int, pairs binary")
        pairs = near.groupBy("bucket").applyInArrow(_gathered(k), "a long, b long")
        exact = singles.select("id", "k", "x")
        both = pairs.join(exact.select(F.col("id").alias("a"), F.col("k").alias("ka"), F.col("x").alias("xa")), "a")
        both = both.join(exact.select(F.col("id").alias("b"), F.col("k").alias("kb"), F.col("x").alias("xb")), "b")
        near = both.select("ka", "xa", "kb", "xb").mapInArrow(_exact(width, least), "k string, neighbor string, similarity double")
    else:
        near = df.sparkSession.createDataFrame([], "k string, neighbor string, similarity double")
    out = _with_copies(written(near, "near"), members, k, least)
    out = out if only is None else out.where(only(F.col("k")))
    return out.select(F.col("k").alias(key), "neighbor", "similarity", F.col("r").alias("rank"))


def _with_copies(near: DataFrame, members: DataFrame, k: int, least: float) -> DataFrame:
    """near between first members of classes, spread to all members: no more than k + 1 of a class as neighbours."""
    place = F.row_number().over(Window.partitionBy("rep").orderBy("k"))
    heads = written(members.withColumn("p", place).where(F.col("p") <= k + 1).select("rep", F.col("k").alias("head")), "heads")
    theirs = near.join(heads, near.neighbor == heads.rep, "left").select("k", F.coalesce("head", "neighbor").alias("neighbor"), "similarity")
    own = heads.select(F.col("rep").alias("k"), F.col("head").alias("neighbor"), F.lit(1.0).alias("similarity")).where(F.lit(1.0 >= least))
    best = Window.partitionBy("k").orderBy(F.desc("similarity"), "neighbor")
    listed = theirs.union(own).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    each = listed.join(members.withColumnRenamed("k", "member"), listed.k == members.rep, "left")
    each = each.select(F.coalesce("member", listed.k).alias("k"), "neighbor", "similarity").where("k != neighbor")
    return each.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)


def _route(forest, width: int, probes: int, tasks: int):
    """The vectors of each task: leaves, whether each is a member there and whether it asks, ids, bytes."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = forest.value
        for whole in batches:
            for begin in range(0, whole.num_rows, 2048):
                batch = whole.slice(begin, 2048)
                ids, asks = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
                x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, width)
                home, _ = f.leaves(x[~asks], 0)
                own, away = f.leaves(x[asks], probes)
                query = np.flatnonzero(asks)
                row = np.concatenate([np.repeat(np.flatnonzero(~asks), home.shape[1]), np.repeat(query, own.shape[1]), np.repeat(query, away.shape[1])])
                leaf = np.concatenate([home.ravel(), own.ravel(), away.ravel()])
                member = np.arange(len(leaf)) < home.size + own.size
                row, leaf, member = row[leaf >= 0], leaf[leaf >= 0], member[leaf >= 0]
                task = leaf % tasks
                order = np.lexsort((leaf, task))
                row, leaf, member, task = row[order], leaf[order], member[order], task[order]
                q, step, rest = rounded(x)
                flags = member.astype(np.uint8) | asks[row].astype(np.uint8) << 1
                first = np.flatnonzero(np.r_[True, task[1:] != task[:-1]]) if len(task) else np.zeros(0, int)
                out = []
                for a, b in zip(first, np.r_[first[1:], len(task)]):
                    r = row[a:b]
                    parts = leaf[a:b].astype(np.int32), ids[r], step[r], rest[r], flags[a:b], q[r]
                    out.append(b"".join([np.int64(b - a).tobytes(), *(p.tobytes() for p in parts)]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(task[first].astype(np.int32)), pa.array(out, pa.binary())], ["task", "rows"])

    return route


def _unpacked(blobs: list[bytes], width: int) -> list[np.ndarray]:
    parts = []
    for blob in blobs:
        n, at, part = int(np.frombuffer(blob, np.int64, 1)[0]), 8, []
        for kind, wide in ((np.int32, 1), (np.int64, 1), (np.float32, 1), (np.float32, 1), (np.uint8, 1), (np.int8, width)):
            part.append(np.frombuffer(blob, kind, n * wide, at))
            at += part[-1].nbytes
        parts.append(part)
    *columns, q = (np.concatenate(p) for p in zip(*parts))
    return [*columns, q.reshape(-1, width)]


_PAIR = (np.int64, np.int64, np.float32, np.float32)


def _pruned(a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Each (query, member) once, without those whose greatest cosine lies below the k-th least cosine of the query."""
    order = np.lexsort((b, a))
    a, b, low, high = a[order], b[order], low[order], high[order]
    fresh = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
    a, b, low, high = a[fresh], b[fresh], low[fresh], high[fresh]
    order = np.lexsort((-low, a))
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, int)
    many = np.diff(np.r_[first, len(a)])
    kth = np.where(many >= k, low[order[np.minimum(first + k - 1, max(0, len(a) - 1))]], -np.inf) if len(a) else np.zeros(0)
    kept = high >= np.repeat(kth, many)
    return a[kept], b[kept], low[kept], high[kept]


def _gathered(k: int):
    def gather(rows: pa.Table) -> pa.Table:
        parts = []
        for blob in rows.column("pairs").to_pylist():
            n, at, part = len(blob) // 24, 0, []
            for kind in _PAIR:
                part.append(np.frombuffer(blob, kind, n, at))
                at += part[-1].nbytes
            parts.append(part)
        a, b, _, _ = _pruned(*(np.concatenate(c) for c in zip(*parts)), k)
        return pa.table({"a": a, "b": b})

    return gather


def _compare(width: int, k: int, least: float, size: int, seed: int, buckets: int):
    def compare(rows: pa.Table) -> pa.Table:
        """For each query in each of the task's leaves: the members that may be among its k best there, packed by bucket of the query."""
        leaf, ids, step, rest, flags, q = _unpacked(rows.column("rows").to_pylist(), width)
        order = np.argsort(leaf, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(leaf[order]) != 0])
        out: list[tuple[np.ndarray, ...]] = []
        for a, b in zip(first, np.r_[first[1:], len(order)]):
            at = order[a:b]
            member, asks = at[flags[at] & 1 == 1], at[flags[at] & 2 == 2]
            if not len(member) or not len(asks):
                continue
            if len(member) <= 2 * size:
                out.append(_best(ids, step, rest, q, asks, member, k, least))
                continue
            vectors = q[at].astype(np.float32) * step[at, None]
            place = np.flatnonzero(flags[at] & 1 == 1)
            part = place if len(place) <= SAMPLE else place[np.argsort(ids[at[place]] * 0x5851F42D4C957F2D, kind="stable")[:SAMPLE]]
            own = Forest(vectors[part], 1, math.ceil(math.log2(len(member) / size)), seed + int(leaf[at[0]]))
            home = np.concatenate([own.leaves(vectors[place[i : i + 4096]], 0)[0] for i in range(0, len(place), 4096)])[:, 0]
            asking = np.flatnonzero(flags[at] & 2 == 2)
            for i in range(0, len(asking), 4096):
                some = asking[i : i + 4096]
                chosen = np.concatenate(own.leaves(vectors[some], INNER), axis=1)
                for inner in np.unique(chosen[chosen >= 0]):
                    out.append(_best(ids, step, rest, q, at[some[(chosen == inner).any(axis=1)]], at[place[home == inner]], k, least))
        found = _pruned(*(np.concatenate(c).astype(kind) for c, kind in zip(zip(*out), _PAIR)), k) if out else tuple(np.zeros(0, kind) for kind in _PAIR)
        bucket = found[0] % buckets
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0]) if len(order) else np.zeros(0, int)
        groups = [order[a:b] for a, b in zip(cuts, np.r_[cuts[1:], len(order)])]
        blobs = [b"".join(c[g].tobytes() for c in found) for g in groups]
        return pa.table({"bucket": pa.array([int(bucket[g[0]]) for g in groups], pa.int32()), "pairs": pa.array(blobs, pa.binary())})

    return compare


def _best(ids: np.ndarray, step: np.ndarray, rest: np.ndarray, q: np.ndarray, asks: np.ndarray, member: np.ndarray, k: int, least: float) -> tuple[np.ndarray, ...]:
    """Queries and their members that may be among the k best and reach ``least``, with the least and greatest cosine of each."""
    found = []
    own = q[member].astype(np.float32).T
    for i in range(0, len(asks), 1024):
        some = asks[i : i + 1024]
        # whole numbers below 2^24, so products are exact and the same in every leaf
        dots = (q[some].astype(np.float32) @ own) * (step[some, None] * step[None, member])
        slack = rest[some, None] + rest[None, member] + 3 * rest[some, None] * rest[None, member] + np.float32(1e-6)
        dots[ids[some][:, None] == ids[member][None, :]] = -4
        low = dots - slack
        floor = -np.partition(-low, k - 1, axis=1)[:, k - 1 : k] if len(member) > k else np.float32(-3)
        r, c = np.nonzero((dots + slack >= np.maximum(floor, np.float32(least - 1e-6))) & (dots > -3))
        found.append((some[r], ids[member[c]], low[r, c], (dots + slack)[r, c]))
    asked, b, low, high = (np.concatenate(f) for f in zip(*found))
    return ids[asked], b, low, high


def _exact(width: int, least: float):
    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.float32).reshape(-1, width).astype(np.float64) for c in (1, 3))
            cosine = np.round(np.einsum("ij,ij->i", x, y), 9)
            kept = pa.array(np.flatnonzero(cosine >= least))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(2).take(kept), pa.array(cosine).take(kept)], ["k", "neighbor", "similarity"])

    return exact
