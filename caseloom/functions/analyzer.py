"""The English analyzer of lexical indexes: words, possessives dropped, small letters, stop words dropped, Porter stems.

Stems need rules that no column expression has; they run in Arrow batches, each word once for a task.
"""

from __future__ import annotations

import re

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

# Stop words, and the suffixes of the stemmer's second, third and fourth steps.
STOP_WORDS = frozenset("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())
SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
    "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()

_WORD = regex.compile(r"\p{Han}|[\p{Hiragana}]|(?:[\p{L}\p{M}\p{N}_]|(?<=\p{L})['’.:·](?=\p{L})|(?<=\p{N})['’.,;](?=\p{N}))+")
_POSSESSIVE = re.compile("['’＇][sS]$")
_ASCII = re.compile("[a-z]+")


def _shape(word: str) -> str:
    """v for vowels and c for consonants; y is a vowel after a consonant."""
    out = ""
    for letter in word:
        out += "v" if letter in "aeiou" or letter == "y" and out[-1:] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    """How often a vowel is followed by a consonant."""
    return _shape(stem).count("vc")


def _short_end(stem: str) -> bool:
    """Whether it ends in consonant, vowel, consonant, the last being no w, x or y."""
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _plural_and_past(word: str) -> str:
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) else word
    ending = _longest(word, ("ed", "ing"))
    if ending is None or "v" not in _shape(stem := word[: -len(ending)]):
        return word
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if stem[-2:-1] == stem[-1] and _shape(stem)[-1] == "c":
        return stem if stem[-1] in "lsz" else stem[:-1]
    return stem + "e" if _measure(stem) == 1 and _short_end(stem) else stem


def stem(word: str) -> str:
    """The Porter stem of a word of small letters; words of one or two letters, and others than a to z, stay."""
    if len(word) < 3 or not _ASCII.fullmatch(word):
        return word
    word = _plural_and_past(word)
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for suffixes in (SECOND, THIRD):
        ending = _longest(word, suffixes)
        if ending and _measure(word[: -len(ending)]):
            word = word[: -len(ending)] + suffixes[ending]
    ending = _longest(word, FOURTH)
    if ending and _measure(kept := word[: -len(ending)]) > 1 and (ending != "ion" or kept[-1] in "st"):
        word = kept
    if word.endswith("e") and (_measure(word[:-1]) > 1 or _measure(word[:-1]) == 1 and not _short_end(word[:-1])):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


class Stems(dict):
    """Stem of each word, by word; forgets all when it grows too large."""

    def __missing__(self, word: str) -> str:
        if len(self) > 500_000:
            self.clear()
        self[word] = found = stem(word)
        return found


_STEMS = Stems()


def analyzed(text: str | None) -> list[str]:
    words = (_POSSESSIVE.sub("", w).lower() for w in _WORD.findall(text or ""))
    return [_STEMS[w] for w in words if w and w not in STOP_WORDS]


@F.pandas_udf(ArrayType(StringType()))
def _tokens(texts: pd.Series) -> pd.Series:
    return texts.map(analyzed, na_action=None)


@F.pandas_udf(IntegerType())
def _length(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: len(analyzed(t)), na_action=None).astype("int32")


def english_tokens(c: Column) -> Column:
    """The analyzed words of a text in order; none for null."""
    return _tokens(F.coalesce(c, F.lit("")))


def english_length(c: Column) -> Column:
    return _length(F.coalesce(c, F.lit("")))
