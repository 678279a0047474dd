from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from periodica.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return Counter(TERM.findall((text or "").translate(LOWER)))


def plain(docs, items, k=10):
    """(item, rank, id, score) by the definition."""
    rows = [(i, c) for i, c in ((i, terms(t)) for i, t in docs) if c]
    n = len(rows)
    total = sum(sum(c.values()) for _, c in rows)
    df = Counter(t for _, c in rows for t in c)
    asked: dict = {}
    for item, text in items:
        asked.setdefault(item, Counter()).update(terms(text))
    out = []
    for item, own in asked.items():
        scores = []
        for i, c in rows:
            m = 100 - 75 + 75 * sum(c.values()) * n // total
            score = 0
            for t, times in own.items():
                if t in c:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += times * w * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, i is None, i))
        scores.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(scores[:k])]
    return Counter(out)


def found(docs, items, **options):
    got = lexical.search(lexical.index(docs), items, item_col="doc_id", id_col="doc", **options)
    return Counter((r["doc_id"], r["rank"], r["doc"], r["score"]) for r in got.collect())


@pytest.fixture
def corpus():
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(30_000)]
    rows = []
    for i in range(300):
        size = rng.choice([0, 1, 3, 10, 40, 200])
        a = rng.randrange(len(words) - 200)
        rows.append((i, " ".join(words[a : a + size])))
    rows += [(1000 + i, "w1 w2 copied text w77") for i in range(60)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 4, 20])))) for i in range(25)]
    return rows, [*items, (100, "copied"), (101, "W1 w1, w1!")]


@pytest.mark.parametrize("k, entries", [(10, 1 << 16), (1, 1 << 16), (10, 40)])
def test_against_all_scores(make_docs, corpus, k, entries):
    rows, items = corpus
    got = found(make_docs(rows).repartition(4), make_docs(items), k=k, entries=entries)
    assert got == plain(rows, items, k)


def test_filters_full_of_false_positives(make_docs, corpus, monkeypatch):
    """With one bit an entry nearly every bitmap is wrong; results are not."""
    monkeypatch.setattr(lexical, "BITS_PER_ENTRY", 1)
    monkeypatch.setattr(lexical, "SIDE_BY_SIDE", 8)
    monkeypatch.setattr(lexical, "KEY_BITS", 64)
    rows, items = corpus
    block = lexical._Block()
    for i, text in rows:
        block.add(i, text.encode())
    sides, _ = block.done()
    assert max(len(s["keys"]) for s in sides) == 8
    assert found(make_docs(rows), make_docs(items)) == plain(rows, items)


def test_bounds_are_never_below_scores(corpus):
    rows, items = corpus
    block = lexical._Block()
    for i, text in rows:
        block.add(i, text.encode())
    sides, holding = block.done()
    n = sum(len(s["keys"]) for s in sides)
    weighted = [
        {"item": item, "term": t.encode(), "weight": 3 * times}
        for item, text in items
        for t, times in terms(text).items()
        if t.encode() in block.number
    ]
    queries = lexical.Round(weighted, n, sum(sum(s["lengths"]) for s in sides))
    texts = dict(rows)
    exact = pairs = 0
    for side in sides:
        for i, bound in queries.bounds(side):
            for key, most in zip(side["keys"], bound.tolist(), strict=True):
                score = queries.scores(texts[key].encode(), [i])[0]
                assert score <= most
                exact += score == most
                pairs += 1
    assert exact > 0.8 * pairs  # counts up to 8 are told apart, so bounds are mostly tight
    assert holding.sum() == sum(len(terms(t)) for _, t in rows)


def test_odd_texts(make_docs):
    rows = [
        (1, None),
        (2, ""),
        (3, "-- ++"),
        (4, "Ärger ärger ÄRGER a_b"),
        (5, "term " * 400_000 + "rare"),
        (6, "x" * 3_000_000 + " rare"),
        (7, "same same"),
        (7, "same same"),
        (None, "same rare"),
        (9, " term "),
    ]
    items = [(1, "rare"), (2, None), (3, "term"), (None, "same"), (5, "ä Ärger"), (6, "nowhere"),
             (7, "same"), (7, "rare"), (8, "x" * 3_000_000)]
    assert found(make_docs(rows), make_docs(items)) == plain(rows, items)


def test_empty_tables(make_docs):
    docs = make_docs([(1, "a b"), (2, "a")])
    assert not found(make_docs([]), docs)
    assert not found(docs, make_docs([]))
    assert not found(make_docs([(1, None)]), docs)


def test_only_wanted_rows_are_joined(spark):
    rows = spark.range(1000).selectExpr("id * 7919 - 3000000 as key")
    asked = rows.where("key % 10 = 0")
    got = {r["key"] for r in lexical._wanted(rows, asked).collect()}
    assert {r["key"] for r in asked.collect()} <= got
    assert len(got) < 110


def test_steps_bound_counts():
    assert lexical.STEPS[:12].tolist() == [1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16]
    assert (np.diff(lexical.STEPS) > 0).all()
