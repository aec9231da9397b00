"""Splitting oversized texts at natural boundaries (problem 1).

The cut list of a text is the solution of a dynamic program over its cut positions. A state is the start s of a piece; an
edge cuts at a position e with ``min_len < e - s <= max_len`` and leads to the start ``e - overlap``. All positions in reach
are edges: boundaries, word gaps and positions inside words. Starts are taken in rising order, so each is final when it
is expanded. What an edge costs, and how costs compare, is the objective's:

* ``FromFront``: costs are lists of (kind of the cut, unused length), one pair for each cut, compared from the front. The optimum
  is the stated rule of ``p1_found``. Of the edges of one start only the least can be on it: their pairs differ, and
  the first pair that differs decides. The others are left out (``every`` keeps them: the same list, more work).
* ``Summed``: penalties by kind and squared imbalance add up. Penalties alone are solved first, backward over all
  positions; edges that lie on no list of least penalty can only win by less imbalance, so they come into play where the
  imbalance of the best list without them is large enough to pay for one.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.plans.tables import spread

# Fixed values of the boundary rule.
SPACE = " \t\r\n\u00a0\u2028"
HARD = frozenset("\r\n\u2028")
TERMINATORS = ".!?;"
CLOSERS = "\"'”’»)]"
WORD_STARTS = SPACE + "([“\"'"
ABBREVIATIONS = frozenset("v. no. para. paras. art. sec. mr. mrs. dr. e.g. i.e. inc. ltd.".split())

_RUN = re.compile(f"[{SPACE}]+")
#: Penalties of a cut at a boundary, at a word gap and inside a word, against a squared imbalance of at most 1.
PENALTIES = (0.0, 4.0, 16.0)


def is_boundary(text: str, a: int, b: int) -> bool:
    """Whether the white-space run text[a:b] ends a line or a sentence."""
    if not HARD.isdisjoint(text[a:b]):
        return True
    j = a
    while j and text[j - 1] in CLOSERS:
        j -= 1
    if not j or text[j - 1] not in TERMINATORS:
        return False
    i = a
    while i and text[i - 1] not in WORD_STARTS:
        i -= 1
    return text[i:a].lower() not in ABBREVIATIONS


def cuts_between(text: str, low: int, high: int) -> list[tuple[int, int]]:
    """(start, end) of the white-space runs that end in (low, high] and neither begin nor end the text."""
    begin = len(text[:low].rstrip(SPACE)) if low and text[low - 1] in SPACE else low  # a run that reaches into the range counts whole
    runs = ((m.start(), m.end()) for m in _RUN.finditer(text, begin, min(high + 1, len(text))))
    return [(a, b) for a, b in runs if a and low < b <= high and b < len(text)]


class FromFront:
    """Cost lists of (kind, unused length), compared from the front."""

    def __init__(self, text: str, max_len: int, min_len: int, overlap: int, every: bool = False) -> None:
        self.text, self.max_len, self.min_len, self.overlap, self.every = text, max_len, min_len, overlap, every
        self.cost: dict[int, tuple] = {0: ()}

    def close(self, start: int) -> tuple:
        return self.cost[start]

    def relax(self, start: int) -> list[int]:
        edges = self._edges(start) if self.every else [next(self._edges(start))]
        lower = []
        for kind, end in edges:
            to, cost = end - self.overlap, (*self.cost[start], (kind, start + self.max_len - end))
            if to not in self.cost or cost < self.cost[to]:
                self.cost[to] = cost
                lower.append(to)
        return lower

    def _edges(self, start: int) -> Iterator[tuple[int, int]]:
        """(kind, end) by rising cost."""
        low, high = start + self.min_len, start + self.max_len
        runs = cuts_between(self.text, low, high)
        yield from ((0, b) for a, b in reversed(runs) if is_boundary(self.text, a, b))
        yield from ((1, b) for _, b in reversed(runs))
        yield from ((2, e) for e in range(high, low, -1))


class Summed:
    """Penalties and squared imbalance, added; ``close`` and ``cost`` are without the least sum of penalties, which all lists have."""

    def __init__(self, text: str, max_len: int, min_len: int, overlap: int, spare: float = 0.0) -> None:
        n = len(text)
        self.n, self.max_len, self.min_len, self.overlap, self.spare = n, max_len, min_len, overlap, spare
        runs = cuts_between(text, 0, n)
        kinds = [b for a, b in runs if is_boundary(text, a, b)], [b for _, b in runs]
        self.kinds = [(at, np.array(at, np.int64)) for at in kinds]
        self.imbalance = ((max_len - np.arange(max_len + 1)) / max_len) ** 2  # by length
        self.rest = self._rest()
        self.cost = np.full(n, np.inf)
        self.cost[0] = 0.0

    def _rest(self) -> np.ndarray:
        """Least penalties of the cuts after a start: 0 where the text ends in reach, else the least in a sliding window of cuts."""
        n, low, high = self.n, self.min_len + 1, self.max_len
        penalty = np.full(n, PENALTIES[2], np.float32)
        for kind in (1, 0):
            penalty[self.kinds[kind][1]] = PENALTIES[kind]
        rest = np.zeros(n, np.float32)
        width, step, top = high - low + 1, low - self.overlap, n - high
        while top > 0:  # starts of one block lead to starts beyond it, which are known
            begin = max(0, top - step)
            after = penalty[begin + low : top + high] + rest[begin + low - self.overlap : top + high - self.overlap]
            rest[begin:top] = _sliding_min(after, width)[: top - begin]
            top = begin
        return rest

    def close(self, start: int) -> float:
        return self.cost[start] + self.imbalance[self.n - start]

    def relax(self, start: int) -> list[np.ndarray]:
        low, high, cost, bound = start + self.min_len, start + self.max_len, self.cost[start], self.rest[start] + self.spare
        lower = []
        for kind, (at, ends) in enumerate(self.kinds):
            if PENALTIES[kind] <= bound:
                lower.append(self._cheaper(start, cost, ends[bisect_right(at, low) : bisect_right(at, high)], PENALTIES[kind], bound))
        if PENALTIES[2] <= bound:
            lower.append(self._cheaper(start, cost, np.arange(low + 1, high + 1), PENALTIES[2], bound))
        return lower

    def _cheaper(self, start: int, cost: float, ends: np.ndarray, penalty: float, bound: float) -> np.ndarray:
        to = ends - self.overlap
        more = penalty + self.rest[to] - self.rest[start]
        kept = more <= bound - self.rest[start]
        to, new = to[kept], cost + more[kept] + self.imbalance[ends[kept] - start]
        less = new < self.cost[to]
        self.cost[to[less]] = new[less]
        return to[less]


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values, from running minima inside blocks of that width."""
    m, blocks = len(x) - width + 1, -(-len(x) // width)
    grid = np.full((blocks, width), np.inf, x.dtype)
    grid.ravel()[: len(x)] = x
    ahead = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()[:m]
    return np.minimum(ahead, np.minimum.accumulate(grid, axis=1).ravel()[width - 1 : width - 1 + m])


def optimal_pieces(n: int, overlap: int, max_len: int, objective: FromFront | Summed) -> tuple[list[tuple[int, int]], tuple | float]:
    """(start, end) of the pieces of the cheapest cut list of a text of n characters, and its cost."""
    if n <= max_len:
        return [(0, n)], objective.close(0)
    before, reached = {0: -1}, bytearray(n)
    start, final = 0, None
    while start >= 0:  # all ways to a start come from smaller ones
        if n - start <= max_len:
            total = objective.close(start)
            if final is None or total < final[0]:
                final = total, start
        else:
            for to in objective.relax(start):
                for t in (to,) if isinstance(to, int) else to.tolist():
                    before[t], reached[t] = start, 1
        start = reached.find(1, start + 1)
    starts = [final[1]]
    while (start := before[starts[-1]]) >= 0:
        starts.append(start)
    starts.reverse()
    return [(a, b + overlap) for a, b in zip(starts, starts[1:])] + [(starts[-1], n)], final[0]


def split_front(text: str, max_len: int, min_len: int, overlap: int, every: bool = False) -> list[tuple[int, int]]:
    """The cut list that is cheapest when costs compare from the front."""
    return optimal_pieces(len(text), overlap, max_len, FromFront(text, max_len, min_len, overlap, every))[0]


def split_balanced(text: str, max_len: int, min_len: int, overlap: int) -> list[tuple[int, int]]:
    """The cut list with the least sum of penalties and squared imbalance over all boundaries, word gaps and other positions."""
    n = len(text)
    if n <= max_len:
        return [(0, n)]
    pieces, imbalance = optimal_pieces(n, overlap, max_len, Summed(text, max_len, min_len, overlap))
    if imbalance >= PENALTIES[1] - PENALTIES[0]:  # the least that a list of higher penalties pays more
        pieces, _ = optimal_pieces(n, overlap, max_len, Summed(text, max_len, min_len, overlap, spare=imbalance))
    return pieces


def split_oversized(
    df: DataFrame, keys: list[str], text: str, max_len: int = 3000, min_len: int = 1500, overlap: int = 300, objective: str = "front", whole: bool = False
) -> DataFrame:
    """(keys, piece_no, char_start, char_end): the pieces of each row's text, cut where it is longer than ``max_len`` code points.

    Rows with shorter texts give nothing, or one piece with ``whole``; null texts never give any, empty ones only with
    ``whole``. Repeated rows give repeated pieces. ``overlap <= min_len < max_len`` makes sure that pieces advance.
    """
    if not 0 <= overlap <= min_len < max_len:
        raise ValueError("needs 0 <= overlap <= min_len < max_len")
    split = {"front": split_front, "balanced": split_balanced}[objective]
    rows = df.where(F.col(text).isNotNull() if whole else F.length(text) > max_len).select(*keys, F.col(text).alias("_text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, numbers, starts, ends = [], [], [], []
            for row, value in enumerate(batch.column(len(keys)).to_pylist()):
                for number, (a, b) in enumerate(split(value, max_len, min_len, overlap), 1):
                    source.append(row)
                    numbers.append(number)
                    starts.append(a)
                    ends.append(b)
            at = pa.array(source, pa.int64())
            columns = [batch.column(i).take(at) for i in range(len(keys))] + [pa.array(x, pa.int32()) for x in (numbers, starts, ends)]
            yield pa.RecordBatch.from_arrays(columns, [*keys, "piece_no", "char_start", "char_end"])

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return spread(rows).mapInArrow(cut, f"{kinds}, piece_no int, char_start int, char_end int")
