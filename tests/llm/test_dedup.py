from __future__ import annotations

import hashlib
import random

import pytest

from periodica.llm import dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault((text or "").translate(LOWER), []).append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max(ids, key=lambda i: (i is not None, i))
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, keep, len(ids), digest) for i in ids]
    return sorted(out, key=str)


def rows_of(found):
    return sorted(
        ((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found), key=str
    )


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    long = [" ".join(rng.choice(("alpha", "Beta", "é", "x.")) for _ in range(900)) for _ in range(12)]
    out = [(i, long[i % 12]) for i in range(60)]
    out += [(100 + i, long[0][: 400 * i]) for i in range(12)]
    out += [(200, None), (201, ""), (202, "É"), (203, "é"), (204, "Ab"), (205, "aB"), (None, "ab")]
    out += [(206, long[1] + "\n"), (207, "y" * 100_000), (208, "Y" * 100_000), (209, "y" * 99_999)]
    return out + [(3, long[3])] * 5


def test_groups(make_docs, rows):
    found = dedup.copies(make_docs(rows)).collect()
    assert rows_of(found) == plain(rows)
    kept = [r for r in found if r["kept"]]
    assert all(r["doc_id"] == r["keep_id"] for r in kept)
    assert len({r["text_sha256"] for r in kept}) == len(kept) == len({r[3] for r in plain(rows)})


@pytest.mark.parametrize("bits", [1, 4])
def test_colliding_hashes_are_told_apart(make_docs, rows, bits):
    found = dedup.copies(make_docs(rows), least=64, most=256, hash_bits=bits).collect()
    assert rows_of(found) == plain(rows)


def test_chunks_are_the_text(make_docs, rows):
    part = dedup.chunks(dedup.normalised("text"), 64, 256).alias("parts")
    for r in make_docs(rows).select(dedup.normalised("text").alias("t"), part).collect():
        assert "".join(r["parts"]) == r["t"]
        assert all(len(p) >= 64 for p in r["parts"][:-1]) and all(len(p) <= 257 for p in r["parts"])


def test_distinct_returns_whole_rows(make_docs, rows):
    docs = make_docs(rows)
    kept = dedup.distinct(docs)
    assert kept.schema == docs.schema
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted(
        {r[3]: r[1] for r in plain(rows)}.values(), key=str
    )


def test_empty_tables(make_docs):
    assert dedup.copies(make_docs([])).collect() == []
    assert dedup.distinct(make_docs([])).collect() == []
