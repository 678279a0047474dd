"""Commas, stops and line breaks are parts of their own, and only the ends of rows move."""

from __future__ import annotations

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from periodica.llm import packing

VOCABULARY = packing.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))

WORDS = st.sampled_from(
    ["and", "École", "it's", "漢字", "é", "x²", "7", "\"so\"", "...", ",", ".", "!", "_", "﻿", "ſ"]
)
BETWEEN = st.sampled_from([" ", "\n", ", ", ". ", ",\n", ".\n", "., ", "  ", "\n\n", "\t", " \n", "\xa0", "", "? "])
TEXT = st.lists(st.tuples(WORDS, BETWEEN), max_size=12).map(lambda x: "".join(a + b for a, b in x))


@settings(max_examples=500, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_parts_are_encoded_like_the_whole(texts):
    encoder = packing.Encoder(VOCABULARY)
    got = [ids.tolist() for ids in encoder.encode(texts)]
    assert got == [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_words_with_signs_are_known_once():
    encoder = packing.Encoder(VOCABULARY)
    encoder.encode(["a word, a word. a word\nword, word.\nword word"])
    assert [w for w in encoder.number if isinstance(w, str) and w.strip() == "word"] == ["word", "\n\nword"]
    assert len(encoder.number) == 6  # the first "a" as bytes, "word", ",", "a", ".", and the two below
    assert packing.parts_of('so "it", is') == ["so", '"it",', "is"]


@pytest.mark.parametrize("width, row", [(7, 50), (16, 64), (1, 3), (40, 9), (64, 64)])
def test_only_the_ends_of_rows_move(spark, make_docs, width, row):
    docs = make_docs([(i, "some words of prose, " * (i % 7)) for i in range(40)]).repartition(2)
    rows = packing.stored(packing._tokens(docs, VOCABULARY, 1, row, "doc_id", "text"), "rows")
    placed = rows.withColumn("place", F.col("before") + 5 * F.col("part")).select("place", "n", "tokens", "pieces")
    for r in packing._outer(placed, width).collect():
        kept = r["n"] - r["skip"]
        assert 0 < kept <= 2 * (width - 1) or r["skip"] == 0
        assert len(r["tokens"]) == 2 * kept and r["skip"] % width == 0
