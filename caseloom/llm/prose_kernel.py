"""Statistics of one text: how its words, sentences and lines compare with running prose.

A line *reads on* if the next one begins with a letter that is no capital (in a text without small letters, all count as
small), so wrapped prose reads as the unwrapped does, while items of a list and rows of a table stand alone.
"""

from __future__ import annotations

import math
from collections import Counter

import regex

STATISTICS = ("log_words", "word_length", "symbols", "digits", "ending", "common", "sentence_words", "line_words")
#: Those that don't depend on the words of a language.
SHAPE = ("symbols", "digits", "ending", "sentence_words", "line_words")

# Line ends, words, invisible characters, sentence ends.
_LINES = regex.compile("\\r\\n|[\\n\\r\\v\\f\\x1c-\\x1e\\x85\\u2028\\u2029]")
_WORD = regex.compile(r"\p{Han}|[\p{L}\p{M}]+|\p{N}+")
_INVISIBLE = regex.compile("[​-‏⁠﻿­]")
_CLOSERS = "\"'”’»)]」』"
_TERMINATORS = frozenset(".!?…。！？؟।")
_END = regex.compile("[.!?…。！？؟।]+[\"'”’»)\\]」』]*(?=\\s|$)|[。！？]")
_PUNCTUATION = ".,;:!?'\"()[]-“”‘’«»…。，；：！？、"


def words(text: str) -> list[str]:
    """Runs of letters or of digits, in small letters; each Han character is a word."""
    return _WORD.findall(text.lower())


def vocabulary(text: str) -> set[str]:
    """The different words of a text that may be common ones: no numbers, and no single letters but Han characters."""
    return {w for w in set(words(_INVISIBLE.sub("", text))) if (len(w) > 1 or w > "⺀") and not w[0].isnumeric()}


def _solid(text: str) -> int:
    """Characters that aren't white space."""
    return sum(map(len, text.split()))


def statistics(text: str, speaking: dict[str, tuple[str, ...]]) -> tuple[str, list[float]] | None:
    """Language and STATISTICS of a text; None for one without any visible character.

    ``speaking`` says of each common word in which languages it is one. The language is the one with most of them, "" if there are none.
    log_words: log of 1 + number of words; word_length: mean, of words that are no numbers; symbols: share of non-blank
    characters that are neither letters, digits nor common punctuation; digits: share of words that are numbers; ending:
    share of non-blank characters that stand before the last sentence end of their line, or in a line that reads on (what follows
    the last sentence end of the last line may be cut off and doesn't count);
    common: share of common words; sentence_words and line_words: log of the words for each sentence end, and for each line
    (lines that read on counted as one).
    """
    text = _INVISIBLE.sub("", text)
    lines = [bare for line in _LINES.split(text) if (bare := line.strip())]
    if not lines:
        return None
    found = words(text)
    n = len(found) or 1
    votes: dict[str, int] = {}
    tally = Counter(found)
    common = 0
    for w in tally.keys() & speaking.keys():
        common += tally[w]
        for lang in speaking[w]:
            votes[lang] = votes.get(lang, 0) + tally[w]
    sizes = [_solid(line) for line in lines]
    total = sum(sizes)
    numbers = [(len(w), c) for w, c in tally.items() if w[0].isnumeric()]
    letters, counted = sum(map(len, found)), sum(c for _, c in numbers)
    named = len(found) - counted
    small = lines if any(map(str.islower, text)) else [line.lower() for line in lines]
    on = [line[0].isalpha() and not line[0].isupper() for line in small[1:]] + [False]
    ended, alone, tail = 0, 0, 0
    for line, size, more in zip(lines, sizes, on):
        bare = line.rstrip(_CLOSERS + " ")
        if more or bare[-1:] in _TERMINATORS and bare:
            ended += size
            alone += not more or bare[-1:] in _TERMINATORS
            continue
        alone += 1
        last = None
        for last in _END.finditer(line):
            pass
        done = 0 if last is None else _solid(line[: last.end()])
        ended, tail = ended + done, size - done
    tail = 0 if bare[-1:] in _TERMINATORS else tail  # of the last line
    return max(sorted(votes), key=votes.__getitem__) if votes else "", [
        math.log1p(n),
        (letters - sum(n * c for n, c in numbers)) / max(1, named),
        max(0, total - letters - sum(map(text.count, _PUNCTUATION))) / total,
        counted / n,
        ended / max(1, total - tail),
        common / n,
        math.log(n / (len(_END.findall(text)) + 1)),
        math.log(n / max(1, alone)),
    ]
