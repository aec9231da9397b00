"""Case-id normalizers. Joins lose rows silently under the wrong one, so each has its own name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseloom.functions.text import stripped


def trimmed(c: Column) -> Column:
    """Without leading and trailing white space of any kind (``trim`` knows only U+0020)."""
    return stripped(c.cast("string"))


def zero_filled(c: Column, width: int) -> Column:
    """Zero-padded on the left; unlike ``lpad`` it never shortens."""
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def plain_id(c: Column) -> Column:
    """N1: trimmed, one trailing ``.txt`` dropped, zeros kept."""
    return F.regexp_replace(trimmed(c), r"\.txt$", "")


def padded_id(c: Column, width: int = 6) -> Column:
    """N2 and N3: N1, then zero-filled if all digits; a width of 0 pads nothing."""
    base = plain_id(c)
    return F.when(base.rlike("^[0-9]+$"), zero_filled(base, width)).otherwise(base)


def run_id(c: Column) -> Column:
    """N4 for ids of a run: zero-filled to 6 whatever they are made of."""
    return zero_filled(c.cast("string"), 6)


def label_id(c: Column) -> Column:
    """N4 for ids of labels: every ``.txt`` removed."""
    return F.regexp_replace(c.cast("string"), r"\.txt", "")


def numeric_id(c: Column) -> Column:
    """N5: the part before the first dot as a number; null if it is none."""
    return trimmed(F.substring_index(c.cast("string"), ".", 1)).try_cast("bigint")


def paragraph_id(c: Column) -> Column:
    """N6: the stem as a three-digit number; null where the stem isn't all digits."""
    stem = F.regexp_replace(trimmed(c), r"\.[^.]*$", "")
    return F.when(stem.rlike("^[0-9]+$"), zero_filled(stem.cast("bigint").cast("string"), 3))


def composed_id(case: Column, paragraph: Column) -> Column:
    """Task-2 candidate id: three digits of the case, three of the paragraph."""
    return F.concat(paragraph_id(case), paragraph_id(paragraph))
