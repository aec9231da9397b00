import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from caseloom.llm.tokens import TOKENIZERS, Encoder, PairIndex, count_tokens, decode, encode_corpus, load_ranks

BYTE_BPE = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(BYTE_BPE), reason="no vocabulary files")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def encode(texts, path=BYTE_BPE):
    out = []
    for counts, ids in Encoder(load_ranks(path)).texts(texts):
        at = 0
        for n in counts:
            out.append(ids[at : at + n].tolist())
            at += n
    return out


ODD = ["", "a", " ", "\n\n \t x", "a" * 5000, " " * 3000 + "x", "aaaaaaa bbbbbb abababab", "İSTANBUL 'S 's don't", "<|endoftext|> hi", "𐐀 ½ ²³ ٣٤ Ⅷ 漢字かな", "﻿x​y z\x85", "ȩ́", "\x00\x1c\x1d"]


def test_like_the_library(library):
    assert encode(ODD) == [library(t) for t in ODD]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=120))
def test_like_the_library_on_any_text(library, text):
    assert encode([text]) == [library(text)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_round_trip(texts):
    for path in (BYTE_BPE, f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken"):
        ranks = load_ranks(path)
        assert [decode(ids, ranks) for ids in encode(texts, path)] == texts


def test_overlapping_pairs_merge_from_the_left():
    ranks = {bytes([b]): b for b in range(256)} | {b"aa": 256, b"aab": 257, b"ab": 258}
    assert PairIndex(ranks).encode([b"aaab", b"aab", b"ab", b""]) == [[256, 258], [257], [258], []]


def test_operator(spark, library):
    data = [(1, "Some text. Some text"), (2, None), (3, ""), (4, "x" * 200_000), (1, "Some text. Some text"), (None, " é")]
    df = spark.createDataFrame([(i, t, 7) for i, t in data], "doc_id bigint, text string, ids int")
    out = encode_corpus(df, ["doc_id"], "text")
    assert out.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    assert sorted((r.doc_id or -1, r.ids) for r in out.collect()) == sorted((i or -1, library(t or "")) for i, t in data)
    assert sorted((r.doc_id or -1, r.n_tokens) for r in count_tokens(df, ["doc_id"], "text").collect()) == sorted((i or -1, len(library(t or ""))) for i, t in data)
    assert encode_corpus(df.limit(0), ["doc_id"], "text").count() == 0
