import random

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from versoflow.llm import tokenizer as tk

T = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
T.encode_special_tokens = True


def reference(text):
    return T.encode(text, add_special_tokens=False).ids


ODD = ["", " ", "\n\n\n", "<|endoftext|>", "naïve café", "龍喚士の記 " * 5, "a" * 3000, " " * 700 + "x", "=" * 999, "\x00\x01", "'ll's'd", "😀😀‍👩", "１２３", "é", "ab​cd", "﻿", "नमस्ते", " x"]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    assert tk.encoder().encode(text) == reference(text)


@given(st.text(max_size=80))
@settings(max_examples=400, deadline=None)
def test_any_text(text):
    assert tk.encoder().encode(text) == reference(text)


@given(st.lists(st.sampled_from(["re", "in", "ing", "er", "tion", "é", "の", "ー", "鳥", "th", "́", "0", "-"]), max_size=40))
@settings(max_examples=400, deadline=None)
def test_long_pieces_of_tokens(parts):
    assert tk.encoder().encode("".join(parts)) == reference("".join(parts))


def test_every_vocabulary_token_round_trips():
    enc = tk.encoder()
    rnd = random.Random(1)
    for i in rnd.sample(sorted(enc.tokens), 3000):
        assert b"".join(enc.tokens[k] for k in enc._walk(enc.tokens[i] * 3)) == enc.tokens[i] * 3


def test_documents_null_empty_repeated_and_extra_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "a b", "x"), (3, "a b", "x"), (None, "q", "x")], "doc_id bigint, text string, ids string")
    got = sorted([(r.doc_id or 0, list(r.ids)) for r in tk.encode_documents(df).collect()])
    assert got == sorted([(1, []), (2, []), (3, reference("a b")), (3, reference("a b")), (0, reference("q"))])
    assert tk.encode_documents(df.where("false")).count() == 0
    assert {r.doc_id: r.n_tokens for r in tk.count_tokens(df.where("doc_id < 3")).collect()} == {1: 0, 2: 0}
