from __future__ import annotations

import random
import zlib

import pytest

from periodica.llm import shards


@pytest.mark.parametrize("n", [3, 7])
def test_law_and_slots(make_docs, n):
    rng = random.Random(n)
    rows = [(i, "é" * rng.randint(0, 300)) for i in range(300)]
    rows += [(1000 + i, "the same text") for i in range(150)]
    rows += [(2000, None), (2001, ""), (None, "the same text"), (7, rows[7][1]), (7, rows[7][1])]
    found = shards.shard(make_docs(rows), n).collect()
    assert len(found) == len(rows)
    total, largest = {}, 0
    for r in found:
        total[r["shard"]] = total.get(r["shard"], 0) + r["size"]
        largest = max(largest, r["size"])
    mean = sum(total.values()) / n
    assert set(total) == set(range(n))
    assert all(abs(t - mean) <= largest for t in total.values())
    for s in range(n):
        slots = sorted(r["slot"] for r in found if r["shard"] == s)
        assert slots == list(range(len(slots)))
    expected = sorted(
        (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in rows
    )
    assert sorted((r["size"], r["text_crc32"]) for r in found) == expected


def test_equal_texts_are_neighbours(make_docs):
    rows = [(i, f"text {i % 20}") for i in range(200)]
    found = sorted(shards.shard(make_docs(rows), 4).collect(), key=lambda r: (r["shard"], r["slot"]))
    texts = [r["text_crc32"] for r in found]
    assert sum(a != b for a, b in zip(texts, texts[1:])) == 19


def test_against_a_plain_prefix_sum(make_docs):
    rows = [(i, "x" * (i * 37 % 101)) for i in range(120)]
    found = sorted(shards.shard(make_docs(rows), 5).collect(), key=lambda r: (r["shard"], r["slot"]))
    total, before = sum(r["size"] for r in found), 0
    for r in found:
        assert r["shard"] == min(4, int((before + r["size"] / 2) * 5 / total))
        before += r["size"]


def test_one_huge_text_and_empty_tables(make_docs):
    found = shards.shard(make_docs([(1, "x" * 3_000_000), (2, "y")]), 4).collect()
    assert len(found) == 2
    assert shards.shard(make_docs([]), 4).collect() == []
