from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from periodica.llm import packing

VOCABULARY = packing.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def whole():
    tokenizer = Tokenizer.from_buffer(VOCABULARY)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def verified(sequences, rows, whole, width):
    """Every token of every row stands in one piece, and windows are full but for the last."""
    expected = sorted(
        ((i is None, i or 0), np.array([*whole(t), 1], "<u4").tobytes()) for i, t in rows
    )
    by_window: dict = {}
    parts: dict = {}
    for r in packing.pieces(sequences).collect():
        by_window.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        key = (r["doc_id"] is None, r["doc_id"] or 0)
        parts.setdefault(key, []).append((r["start"], r["doc_tokens"], bytes(r["ids"])))
        assert len(r["ids"]) == 4 * r["length"]
    total = sum(len(t) // 4 for _, t in expected)
    assert sorted(by_window) == list(range(-(-total // width)))
    for window, spans in by_window.items():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == min(width, total - window * width)
    for key in {k for k, _ in expected}:
        own = [t for k, t in expected if k == key]
        if len(own) == 1:
            got = sorted(parts[key])
            assert b"".join(p[2] for p in got) == own[0]
            assert {p[1] for p in got} == {len(own[0]) // 4}
        else:
            assert sum(len(p[2]) for p in parts[key]) == sum(map(len, own))
    return total


def test_whole_table(documents, texts, whole):
    sequences = packing.pack(documents.repartition(5), VOCABULARY, row=5000)
    verified(sequences, texts.items(), whole, 2048)


@pytest.mark.parametrize("width, row", [(7, 5), (16, 64), (1, 3)])
def test_odd_texts(make_docs, whole, width, row):
    rows = [
        (1, None),
        (2, ""),
        (3, " "),
        (4, " lead, trail \n\n x y  z\t q "),
        (5, "it's <|endoftext|> twice <|endoftext|>"),
        (None, "no id"),
        (7, "same row"),
        (7, "same row"),
        (8, "漢字かな交じり文 без пробелов"),
    ]
    docs = make_docs(rows).repartition(3)
    total = verified(packing.pack(docs, VOCABULARY, width, row=row), rows, whole, width)
    again = packing.pack(docs, VOCABULARY, width, pad_id=9, row=row).collect()
    for r in again:
        n = len(r["tokens"]) // 4
        assert n == width or (n == r["n_tokens"] and n & (n - 1) == 0)
        assert bytes(r["tokens"])[4 * r["n_tokens"] :] == (9).to_bytes(4, "little") * (
            n - r["n_tokens"]
        )
    assert sum(r["n_tokens"] for r in again) == total


def test_a_long_text_goes_in_pieces(make_docs, whole, monkeypatch):
    rows = [(1, "some words of prose, " * 60_000), (2, "x" * 50_000), (3, "tail")]
    verified(packing.pack(make_docs(rows), VOCABULARY), rows, whole, 2048)
    pieces = list(packing._pieces(rows[0][1], 1000))
    assert "".join(pieces) == rows[0][1]
    assert max(map(len, pieces)) < 1100


def test_a_last_window_of_a_power_of_two_is_not_padded(make_docs):
    # an empty text is one token
    for n, size in ((4, 4), (5, 8), (8, 8), (9, 8)):
        found = packing.pack(make_docs([(i, "") for i in range(n)]), VOCABULARY, 8)
        last = found.orderBy(F.desc("sequence_id")).first()
        assert len(last["tokens"]) // 4 == (1 if n == 9 else size)


def test_empty_table(make_docs):
    assert packing.pack(make_docs([]), VOCABULARY).collect() == []


TEXT = st.text(st.sampled_from("ab'sé漢 1 \n\t  \x1c.,-  "), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_stretches_are_encoded_like_the_whole(texts):
    encoder = packing._encoder(VOCABULARY)
    got = [ids.tolist() for ids in encoder.encode(texts)]
    expected = [
        e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    ]
    assert got == expected
    assert [" ".join(packing.stretches(t)) for t in texts] == texts


def test_a_worker_forgets(whole):
    encoder = packing.Encoder(VOCABULARY)
    texts = [f"word{i} and {i * 7} more" for i in range(50)]
    first = [x.tolist() for x in encoder.encode(texts)]
    encoder.chars = packing.REMEMBERED_CHARS + 1
    assert [x.tolist() for x in encoder.encode(texts)] == first == [whole(t) for t in texts]
    assert encoder.chars < packing.REMEMBERED_CHARS
