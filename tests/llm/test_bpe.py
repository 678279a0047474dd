from __future__ import annotations

import random

import public_tokenizers
import pytest
import tiktoken

from periodica.llm import bpe


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding(
        "test",
        pat_str=public_tokenizers.PATTERN,
        mergeable_ranks=bpe.parse_ranks(vocabulary),
        special_tokens={},
    )


ODD = [
    (1, None),
    (2, ""),
    (3, "<|endoftext|> it's     x\n\n\n y\t"),
    (4, "日本語 😀😀 é \x1c\x85 ١٢٣ Ⅷ"),
    (5, "a" * 200_000 + " " + "xyz" * 30_000),
    (6, " " * 5000),
    (7, "same"),
    (7, "same"),
    (None, "no id"),
]


@pytest.mark.parametrize("block", [bpe.BLOCK, 300])
def test_ids_are_the_librarys(spark, make_docs, documents, vocabulary, library, block):
    rows = ODD + [tuple(r) for r in documents.select("doc_id", "text").where("doc_id < 60").collect()]
    rows = [(i, t) for i, t in rows if block == bpe.BLOCK or i != 5]
    found = bpe.encode(
        make_docs(rows), vocabulary, public_tokenizers.PATTERN, block_chars=block, buckets=5
    )
    expected = sorted(((i, library.encode_ordinary(t or "")) for i, t in rows), key=str)
    assert sorted(((r["doc_id"], list(r["ids"])) for r in found.collect()), key=str) == expected


def test_round_trip(make_docs, vocabulary):
    docs = make_docs(ODD)
    decoded = bpe.decode(bpe.encode(docs, vocabulary, public_tokenizers.PATTERN), vocabulary)
    found = sorted(((r["doc_id"], bytes(r["decoded"]).decode()) for r in decoded.collect()), key=str)
    assert found == sorted(((i, t or "") for i, t in ODD), key=str)


def test_long_words_merge_like_short_ones(vocabulary, library):
    ranks = bpe.parse_ranks(vocabulary)
    rng = random.Random(9)
    for n in (1, 2, 7, 47, 48, 49, 50, 300):
        for _ in range(40):
            word = "".join(rng.choice("abetheing isé") for _ in range(n)).encode()
            expected = library._core_bpe.encode_single_piece(word)
            assert bpe.encode_word(word, ranks) == expected
            if word not in ranks:
                assert bpe._encode_long(word, ranks) == expected


@pytest.mark.parametrize("remembered", [1, 2000, bpe.REMEMBERED])
def test_a_bucket_is_streamed(vocabulary, library, remembered, monkeypatch):
    """Many blocks' words in batches: as much is remembered as was asked for, the ids are the same."""
    import numpy as np
    import pyarrow as pa

    class Shared:
        value = vocabulary

    encoded, merge = [], bpe.encode_word
    monkeypatch.setattr(bpe, "encode_word", lambda w, ranks: encoded.append(w) or merge(w, ranks))
    monkeypatch.setattr(bpe, "_AT_ONCE", 200)
    words = [f"word{i}".encode() for i in range(50)]
    given = 0

    def batches():
        nonlocal given
        for block in range(0, 80, 4):
            rows = []
            for b in range(block, block + 4):
                rows += list(bpe._word_rows(pa.int64(), b, words, 1).to_pylist())
            given += 1
            table = pa.Table.from_pylist(rows).select(["block", "bucket", "words", "lengths", "numbers"])
            yield from table.combine_chunks().to_batches()

    blocks = []
    for part in bpe._encoder(Shared, remembered)(batches()):
        # results come while the bucket is still being read
        assert given <= 1 + len(blocks) // 4 + 1
        for row in part.to_pylist():
            blocks.append(row["block"])
            own = np.cumsum(bpe._unpack(row["numbers"])).tolist()
            ids, ends = bpe._unpack(row["word_ids"]).tolist(), bpe._ends(bpe._unpack(row["lengths"]))
            for number, a, b in zip(own, ends, ends[1:]):
                assert ids[a:b] == library._core_bpe.encode_single_piece(words[number])
    assert blocks == list(range(80))
    if remembered == bpe.REMEMBERED:
        assert sorted(encoded) == sorted(words)


def test_one_word_in_a_third_of_all_texts(make_docs, vocabulary, library):
    rows = [(i, "hot " * 300 if i % 3 == 0 else f"text{i} of its own") for i in range(90)]
    found = bpe.encode(make_docs(rows), vocabulary, public_tokenizers.PATTERN, block_chars=500)
    assert {r["doc_id"]: list(r["ids"]) for r in found.collect()} == {
        i: library.encode_ordinary(t) for i, t in rows
    }


def test_packing():
    import numpy as np

    for numbers in ([], [0], [1, 300, 70_000, 4_000_000_000]):
        assert bpe._unpack(bpe._pack(np.array(numbers, np.uint32))).tolist() == numbers


def test_empty_tables(spark, make_docs, vocabulary):
    encoded = bpe.encode(make_docs([]), vocabulary, public_tokenizers.PATTERN)
    assert encoded.collect() == []
    nulls = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert bytes(bpe.decode(nulls, vocabulary).first()["decoded"]) == b""
