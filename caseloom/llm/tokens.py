"""Byte-level BPE encoding of a corpus with a public tokenizer (problem 6).

The distinct words of a batch lie end to end in one array. An index maps the rank of each mergeable pair to all places
where such a pair stands; active ranks are taken in ascending order, each merges all its places at once (from the left,
so that overlapping pairs resolve as they do in a single text), and only the lists of the neighbouring pairs change.
A word's length costs n log n, so a text without any space is no trap.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.plans.tables import spread

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words a task remembers, and texts it indexes together.
REMEMBERED, TOGETHER = 400_000, 2_000


@cache
def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file of lines "base64-token rank"."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PairIndex:
    """Encodes words by rank-ordered merges over the occurrences of pairs."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[tuple[int, int], int] = {}

    def merged(self, a: int, b: int) -> int:
        """Rank of the token that a and b make, or -1."""
        if (found := self.pairs.get((a, b))) is None:
            found = self.pairs[a, b] = self.ranks.get(self.bytes_of[a] + self.bytes_of[b], -1)
        return found

    def encode(self, words: list[bytes]) -> list[list[int]]:
        if len(self.pairs) > REMEMBERED:
            self.pairs.clear()
        symbol: list[int] = []
        starts = []
        after: list[int] = []
        single, merged = self.single, self.merged
        places: dict[int, list[int]] = {}
        for word in words:
            at = len(symbol)
            starts.append(at)
            if not word:
                continue
            ids = [single[b] for b in word]
            symbol += ids
            after += range(at + 1, at + len(ids))
            after.append(-1)
            for i in range(len(ids) - 1):
                if (rank := merged(ids[i], ids[i + 1])) >= 0:
                    places.setdefault(rank, []).append(at + i)
        before = list(range(-1, len(symbol) - 1))
        for at, word in zip(starts, words):
            if word:
                before[at] = -1
        active = list(places)
        heapq.heapify(active)

        def note(rank: int, at: int) -> None:
            if (known := places.get(rank)) is None:
                places[rank] = [at]
                heapq.heappush(active, rank)
            else:
                known.append(at)

        while active:
            rank = heapq.heappop(active)
            found = places.pop(rank)
            found.sort()
            for i in found:
                # an entry may be stale: its pair was merged with other neighbours before
                if (a := symbol[i]) < 0 or (j := after[i]) < 0 or merged(a, symbol[j]) != rank:
                    continue
                symbol[i], symbol[j] = rank, -1
                after[i] = n = after[j]
                if n >= 0:
                    before[n] = i
                    if (next_ := merged(rank, symbol[n])) >= 0:
                        note(next_, i)
                if (p := before[i]) >= 0 and (last := merged(symbol[p], rank)) >= 0:
                    note(last, p)
        return [[s for s in symbol[a:b] if s >= 0] for a, b in zip(starts, [*starts[1:], len(symbol)])]


class Encoder:
    """Encodes texts; what it knows of words outlives a batch."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.index, self.known = PairIndex(ranks), {}
        self.split = regex.compile(PATTERN).findall

    def texts(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For every so many texts: number of ids of each, and all ids."""
        for at in range(0, len(texts), TOGETHER):
            words = [self.split(t) if t else [] for t in texts[at : at + TOGETHER]]
            if len(self.known) > REMEMBERED:
                self.known.clear()
            known = self.known
            new = [w for w in dict.fromkeys(chain.from_iterable(words)) if w not in known]
            known.update(zip(new, self.index.encode([w.encode("utf-8", "surrogatepass") for w in new])))
            ids = [list(chain.from_iterable(map(known.__getitem__, w))) for w in words]
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            yield counts, np.fromiter(chain.from_iterable(ids), np.int32, int(counts.sum()))


def _per_text(df: DataFrame, keys: list[str], text: str, tokenizer: str, name: str, kind: str, column) -> DataFrame:
    # a tokenizer's file doesn't grow with the data: some 50,000 tokens, about 1 MB
    shared = df.sparkSession.sparkContext.broadcast(load_ranks(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            at = 0
            for counts, ids in encoder.texts(batch.column(len(keys)).to_pylist()):
                part = batch.slice(at, len(counts))
                at += len(counts)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keys))), column(counts, ids)], [*keys, name])

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return spread(df.select(*keys, F.col(text).alias("_text"))).mapInArrow(run, f"{kinds}, {name} {kind}")


def encode_corpus(df: DataFrame, keys: list[str], text: str, tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(keys, ids): token ids of each row's text without special tokens; strings that look like special tokens are text.

    Every row gives one row, repeated ones too. A null or empty text has the empty list.
    """

    def lists(counts: np.ndarray, ids: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(ids))

    return _per_text(df, keys, text, tokenizer, "ids", "array<int>", lists)


def count_tokens(df: DataFrame, keys: list[str], text: str, tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(keys, n_tokens): how many ids each row's text has; 0 for a null or empty one."""
    return _per_text(df, keys, text, tokenizer, "n_tokens", "bigint", lambda counts, ids: pa.array(counts))


def decode(ids: list[int], ranks: dict[bytes, int]) -> str:
    tokens = {rank: token for token, rank in ranks.items()}
    return b"".join(tokens[i] for i in ids).decode("utf-8", "surrogatepass")
