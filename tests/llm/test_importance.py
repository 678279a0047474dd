from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from periodica.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, longest, buckets):
    words = WORD.findall((text or "").translate(LOWER))
    grams = [
        " ".join(words[i : i + n])
        for n in range(1, longest + 1)
        for i in range(len(words) - n + 1)
    ]
    return len(words), [zlib.crc32(g.encode()) % buckets for g in grams]


def plain(docs, target, percent=25, min_words=20, longest=2, buckets=10_000, seed=7):
    """(id, n_features, weight, score, rank) of every row, by the definition."""
    found = [(i, *features(t, longest, buckets)) for i, t in docs]
    s = Counter(b for _, _, f in found for b in f)
    t = Counter(b for text in target for b in features(text, longest, buckets)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [
        math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets))))
        for b in range(buckets)
    ]
    rows = []
    for i, n, f in found:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        key = f"{seed}:{'' if i is None else i}"
        h = int(hashlib.sha256(key.encode()).hexdigest()[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((i, n, len(f), weight, weight + noise))
    able = sorted(
        (r for r in rows if r[1] >= min_words),
        key=lambda r: (-r[4], r[0] is None, r[0] or 0, -r[3], -r[2]),
    )
    place = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return [(r[0], *r[2:], place.get(id(r))) for r in rows]


def listed(df):
    names = ("doc_id", "n_features", "weight", "score", "rank")
    return Counter(tuple(r[n] for n in names) for r in df.collect())


def test_whole_table(spark, documents, texts):
    target = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    expected = plain(texts.items(), [r["text"] for r in target.collect()])
    assert listed(importance.resample(documents, target)) == Counter(expected)


@pytest.mark.parametrize("longest, buckets", [(1, 50), (3, 97), (2, 70_000)])
def test_odd_texts(make_docs, longest, buckets):
    rows = [
        (1, None),
        (2, ""),
        (3, " \t--__!! "),
        (4, "A-b_c  É é 7\x7f8 ß İ"),
        (5, "a " * 30),
        (5, "a " * 30),
        (5, "b " * 30),
        (None, "word " * 25),
        (7, "long tail " * 40_000 + "x" * 300_000),
        (8, "\x00solid"),
        *[(100 + i, f"the same text {'of many words ' * 8}") for i in range(40)],
    ]
    target = [(1, "a b c"), (2, None), (3, "word word")]
    got = importance.resample(
        make_docs(rows), make_docs(target), 60, 20, longest, buckets, seed=3
    )
    assert listed(got) == Counter(
        plain(rows, [t for _, t in target], 60, 20, longest, buckets, seed=3)
    )


def test_empty_tables(make_docs):
    assert importance.resample(make_docs([]), make_docs([(1, "a b")])).collect() == []
    rows = [(i, f"some {i} words " * 10) for i in range(8)]
    got = importance.resample(make_docs(rows), make_docs([]))
    assert listed(got) == Counter(plain(rows, []))


def test_spans_stand_at_word_boundaries():
    words = importance.spaced("A--b  cdé_E".encode())
    assert words == " a b cdé e ".encode()
    spans = [[m[1].decode() for m in p.finditer(words, overlapped=True)]
             for p in importance.patterns(3)]
    assert spans == [["a", "b", "cdé", "e"], ["a b", "b cdé", "cdé e"],
                     ["a b cdé", "b cdé e"]]


def test_ranks_of_tied_scores(spark):
    rows = [(i, 30, 5, 0, i // 10, True) for i in range(100)]
    scored = spark.createDataFrame(
        rows, "id long, n_words long, n_features long, weight long, score long, able boolean"
    )
    got = {r["id"]: r["rank"] for r in importance.ranked(scored, 33).collect()}
    order = sorted(range(100), key=lambda i: (-(i // 10), i))
    assert got == {i: k + 1 if k < 33 else None for k, i in enumerate(order)}
