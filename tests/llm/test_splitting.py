import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from caseloom.llm import splitting
from caseloom.llm.splitting import ABBREVIATIONS, CLOSERS, PENALTIES, SPACE, is_boundary, split_balanced, split_front, split_oversized


def brute(text, max_len, min_len, overlap):
    """The rule as it is stated, position by position."""
    n = len(text)
    runs = [m.span() for m in re.finditer(f"[{SPACE}]+", text) if m.start() and m.end() < n]

    def boundary(a, b):
        if set(text[a:b]) & set("\r\n "):
            return True
        if not re.search(r"[.!?;]$", text[:a].rstrip(CLOSERS)):
            return False
        return re.split(f"[{SPACE}(\\[“\"']", text[:a])[-1].lower() not in ABBREVIATIONS

    out, start = [], 0
    while n - start > max_len:
        reach = [(a, b) for a, b in runs if start + min_len < b <= start + max_len]
        ends = [b for a, b in reach if boundary(a, b)] or [b for _, b in reach] or [start + max_len]
        out.append((start, ends[-1]))
        start = ends[-1] - overlap
    return [*out, (start, n)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab. \n  \t!)\"v(1", max_size=300))
def test_front_is_the_stated_rule(text):
    assert split_front(text, 40, 20, 10) == brute(text, 40, 20, 10)


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="ab. \n  \t!)\"v(1", max_size=150))
def test_front_with_every_edge(text):
    """The program over all edges of all starts, not only those that can win, gives the same list."""
    assert split_front(text, 40, 20, 10, every=True) == brute(text, 40, 20, 10)


@pytest.mark.parametrize("objective", [split_front, split_balanced])
def test_pieces_cover_and_overlap(objective):
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) + rng.choice(["", "", "."]) for _ in range(900))
    pieces = objective(text, 300, 150, 30)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(b[0] == a[1] - 30 for a, b in zip(pieces, pieces[1:]))
    assert all(150 < b - a <= 300 for a, b in pieces[:-1]) and pieces[-1][1] - pieces[-1][0] <= 300


def exhaustive(text, max_len, min_len, overlap):
    """Least cost of all cut lists, and the cost of a given one: all kinds of cuts compete."""
    n = len(text)
    runs = [m.span() for m in re.finditer(f"[{SPACE}]+", text) if m.start() and m.end() < n]
    kind = {b: 0 if is_boundary(text, a, b) else 1 for a, b in runs}

    def piece(start, end):
        return ((max_len - end + start) / max_len) ** 2 + (PENALTIES[kind.get(end, 2)] if end < n else 0)

    least = {}
    for start in range(n, -1, -1):
        least[start] = piece(start, n) if n - start <= max_len else min(piece(start, e) + least[e - overlap] for e in range(start + min_len + 1, start + max_len + 1))
    return least[0], lambda pieces: sum(piece(a, b) for a, b in pieces)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aaaabc. \n!", max_size=160), st.sampled_from([(14, 5, 2), (20, 8, 8), (12, 3, 0), (9, 7, 1)]))
def test_balanced_is_optimal(text, sizes):
    least, cost = exhaustive(text, *sizes)
    assert cost(split_balanced(text, *sizes)) == pytest.approx(least)


@pytest.mark.parametrize("text", ["aaa bb cccc d eee ff ggggg hh i jjj kk llll m", "x" * 43, "aa. bbbbbbbbbbbbbbbbbbbbbbbbbbbbb cc dd eeee ff g. hh", "aaaa bbb cc " + "y" * 31])
def test_balanced_is_optimal_where_imbalance_can_pay(text, monkeypatch):
    """With penalties so low that imbalance may outweigh them."""
    monkeypatch.setattr(splitting, "PENALTIES", (0.0, 0.02, 0.05))
    monkeypatch.setitem(globals(), "PENALTIES", (0.0, 0.02, 0.05))
    for repeats in (1, 3):
        least, cost = exhaustive(text * repeats, 14, 5, 2)
        assert cost(split_balanced(text * repeats, 14, 5, 2)) == pytest.approx(least)


def test_boundaries():
    def at(text):
        a = text.index("|")
        return is_boundary(text.replace("|", ""), a, a + 1)

    assert at("end.| Next") and at("end.”)| Next") and at("so;| next") and at("line|\nnext")
    assert not at("Smith v.| Jones") and not at("(No.| 5") and not at("comma,| next") and not at("“Mr.| X")


def test_operator(spark, rows):
    long = "word " * 2000
    df = spark.createDataFrame([("1", long, 1), ("2", "short", 2), ("3", None, 3), ("4", "", 4), ("1", long, 1), (None, "x" * 7000, 5)], "id string, body string, _text int")
    out = rows(split_oversized(df, ["id"], "body"))
    assert len([r for r in out if r[0] == "1"]) == 2 * len(split_front(long, 3000, 1500, 300))
    assert [r[1:] for r in out if r[0] is None] == [(1, 0, 3000), (2, 2700, 5700), (3, 5400, 7000)]
    assert {r[0] for r in out} == {"1", None}
    assert split_oversized(df.limit(0), ["id"], "body").count() == 0
    assert rows(split_oversized(df, ["id"], "body", whole=True).where("id in ('2', '4')")) == [("2", 1, 0, 5), ("4", 1, 0, 0)]
    with pytest.raises(ValueError):
        split_oversized(df, ["id"], "body", max_len=100, min_len=10, overlap=50)


def test_very_long_text_without_space():
    assert len(split_front("x" * 1_000_000, 3000, 1500, 300)) == 371
    assert split_front(" " * 10_000, 3000, 1500, 300)[0] == (0, 3000)
