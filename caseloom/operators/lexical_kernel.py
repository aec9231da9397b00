"""Scores of many long queries over one part of the documents: matrix products for common terms, postings for the others."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Kinds of rows, in the order in which a part gets them.
TERMS, DOCS, QUERIES = 0, 1, 2
#: Queries in one matrix product.
BLOCK = 128
#: A term in more than this share of a part's documents is a row of the matrix, which has so many cells at most.
COMMON, CELLS = 0.05, 1 << 24
#: Documents whose greatest score is looked at together.
LANE = 64


def _lists(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a column of lists."""
    lists = batch.column(batch.schema.get_field_index(column))
    return lists.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def _runs(values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, value, count) of lists that are sorted each."""
    if not len(values):
        return np.zeros(0, np.int32), values, np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    first = np.flatnonzero(np.r_[True, (values[1:] != values[:-1]) | (row[1:] != row[:-1])])
    return row[first], values[first], np.diff(np.r_[first, len(values)])


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of wanted in the sorted keys, and which of them are there."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Part:
    """Documents in the order of their ids, with weights idf * tf / (tf + k1 * (1 - b + b * dl / average)) by term."""

    def __init__(self, terms: np.ndarray, idf: np.ndarray, ids: list[str], values: np.ndarray, lengths: np.ndarray, k1: float, b: float, average: float):
        order = np.argsort(terms)
        self.terms, idf = terms[order], idf[order]
        by_id = sorted(range(len(ids)), key=ids.__getitem__)
        self.ids = pa.array([ids[i] for i in by_id], pa.string())
        self.width = -(-len(ids) // LANE) * LANE
        place = np.empty(len(ids), np.int32)
        place[by_id] = np.arange(len(ids), dtype=np.int32)
        row, value, tf = _runs(values, lengths)
        at, there = _find(self.terms, value)
        row, at, tf = row[there], at[there].astype(np.int32), tf[there]
        weight = idf[at] * tf / (tf + k1 * (1 - b + b * lengths[row] / average))
        order = np.argsort(at, kind="stable")
        self.docs, self.weights = place[row[order]], weight[order]
        self.sizes = np.bincount(at, minlength=len(self.terms))
        self.starts = np.cumsum(self.sizes) - self.sizes
        common = np.flatnonzero(self.sizes > COMMON * len(ids))
        common = common[np.argsort(-self.sizes[common], kind="stable")][: CELLS // self.width]
        self.column = np.full(len(self.terms), -1)
        self.column[common] = np.arange(len(common))
        self.matrix = np.zeros((len(common), self.width))
        for c, t in enumerate(common):
            own = slice(self.starts[t], self.starts[t] + self.sizes[t])
            self.matrix[c, self.docs[own]] = self.weights[own]

    def scores(self, values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Of each query (its sorted terms, repeated as they occur) for each document; 0 without a common term."""
        row, value, tf = _runs(values, lengths)
        at, there = _find(self.terms, value)
        row, at, tf = row[there], at[there], tf[there]
        column = self.column[at]
        asked = np.zeros((len(lengths), len(self.matrix)))
        asked[row[column >= 0], column[column >= 0]] = tf[column >= 0]
        out = asked @ self.matrix
        row, at, tf = row[column < 0], at[column < 0], tf[column < 0]
        sizes = self.sizes[at]
        posting = np.arange(sizes.sum()) + np.repeat(self.starts[at] - (np.cumsum(sizes) - sizes), sizes)
        np.add.at(out.reshape(-1), np.repeat(row.astype(np.int64) * self.width, sizes) + self.docs[posting], np.repeat(tf, sizes) * self.weights[posting])
        return out

    def best(self, values: np.ndarray, lengths: np.ndarray, k: int, decimals: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, document, score) of the k best documents of each query: single precision of the rounded score, then the id.

        The k-th greatest of the lanes' maxima is no more than the k-th score. What may be ranked with it once it is rounded is kept, then cut to k.
        """
        s = self.scores(values, lengths)
        tops = s.reshape(len(s), -1, LANE).max(axis=2)
        least = np.partition(tops, -k, axis=1)[:, -k] if tops.shape[1] >= k else np.zeros(len(s))
        least = least - (0 if decimals is None else 10.0**-decimals) - least * 2.0**-22
        q, d = np.nonzero(s >= np.maximum(least, np.nextafter(0, 1))[:, None])
        score = s[q, d]
        key = (score if decimals is None else np.round(score, decimals)).astype(np.float32)
        order = np.lexsort((d, -key, q))
        order = order[np.arange(len(q)) - np.searchsorted(q, q) < k]  # q is in order before and after
        return q[order], d[order], score[order]


def part_scores(k: int, k1: float, b: float, average: float, decimals: int | None):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(kind, id, terms, idf) by kind: the terms and documents of one part are held, its queries pass by."""
        seen: dict[int, list] = {TERMS: [], DOCS: []}
        ids: list[str] = []
        part = None
        for batch in batches:
            bounds = np.searchsorted(batch.column(0).to_numpy(), [TERMS, DOCS, QUERIES, QUERIES + 1])
            terms, docs, queries = (batch.slice(a, z - a) for a, z in zip(bounds, bounds[1:]))
            if terms.num_rows:
                seen[TERMS].append((_lists(terms, "terms")[0], terms.column(3).to_numpy()))
            if docs.num_rows:
                ids += docs.column(1).to_pylist()
                seen[DOCS].append(_lists(docs, "terms"))
            if not queries.num_rows or not ids or not seen[TERMS]:
                continue
            if part is None:
                part = Part(*map(np.concatenate, zip(*seen[TERMS])), ids, *map(np.concatenate, zip(*seen[DOCS])), k1, b, average)
                seen[DOCS].clear()
            for at in range(0, queries.num_rows, BLOCK):
                block = queries.slice(at, BLOCK)
                q, d, s = part.best(*_lists(block, "terms"), k, decimals)
                yield pa.RecordBatch.from_arrays([block.column(1).take(pa.array(q)), part.ids.take(pa.array(d)), pa.array(s)], ["query_id", "candidate_id", "score"])

    return score
