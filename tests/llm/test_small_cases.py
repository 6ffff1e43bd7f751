"""Cases that earlier versions got wrong, and encodings held against the named library."""

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from numweave.llm import packing, tokens

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_token_counts_of_int_ids(spark):
    docs = spark.createDataFrame([(1, "one two"), (None, "x")], "doc_id int, text string")
    assert {(r.doc_id, r.n_words) for r in tokens.count_tokens(docs, PIECES).collect()} == {(1, 2), (None, 1)}


HOSTILE = st.one_of(
    st.text(max_size=40),
    st.lists(st.sampled_from(["<|endoftext|>", " ", "  ", "\n", "\r\n", "\t", "'s", "'LL", "é", "é", " ", " ", "\u0000", "123", "4567", "\U0001f600", "﻿", "漢字", "a" * 30, "!!", "<|", "|>"]), max_size=20).map("".join),
)


def test_ids_are_those_of_the_named_library():
    from tokenizers import Tokenizer

    tokenizer, encode = Tokenizer.from_file(BPE), packing.encoder(BPE)

    @given(HOSTILE)
    @settings(max_examples=3000, deadline=None)
    def same(text):
        assert list(encode(text)) == tokenizer.encode(text, add_special_tokens=False).ids

    same()
